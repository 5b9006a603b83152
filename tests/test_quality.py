from pyspark.sql import functions as F

from domain_rows import rows_of
from shopfloor.functions import rules as R
from shopfloor.operators import profile as PF
from shopfloor.operators import quality as Q



def test_duplicates_keep_first_null_keys_equal(orders_small):
    marked = Q.mark_duplicates(orders_small)
    assert {r.order_id for r in marked.filter("is_duplicate").collect()} == {2, 10}
    assert orders_small.count() == marked.count()
    assert Q.drop_duplicates_keep_first(orders_small).count() == 8
    rep = Q.duplicate_report(orders_small).first()
    assert (rep.total_records, rep.duplicates_found, rep.errors, rep.warnings) == (10, 2, 0, 2)
    assert [r.order_id for r in Q.duplicate_examples(orders_small).collect()] == [2, 10]


def test_repeated_ids_and_identical_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "REPEATS", 2)                  # a row's copies are written out by several tasks
    rows = [(1, "a", "x")] * 5 + [(1, "a", "w"), (2, "a", "x"), (None, "a", "x"), (3, "b", "x"), (None, None, "x"),
                                  (None, None, "x"), (4, "c", None), (4, "c", None)]
    df = spark.createDataFrame(rows, "order_id long, customer_name string, status string")
    marked = Q.mark_duplicates(df, keys=["customer_name"])
    kept = sorted(map(tuple, marked.filter("NOT is_duplicate").drop("is_duplicate").collect()), key=str)
    assert kept == sorted([(1, "a", "w"), (3, "b", "x"), (None, None, "x"), (4, "c", None)], key=str)
    assert sorted(map(tuple, marked.drop("is_duplicate").collect()), key=str) == sorted(rows, key=str)
    assert marked.filter("is_duplicate").count() == Q.duplicate_report(df, keys=["customer_name"]).first().duplicates_found
    assert sorted(map(tuple, Q.drop_duplicates_keep_first(df, keys=["customer_name"]).collect()), key=str) == kept
    assert Q.mark_duplicates(df.limit(0), keys=["customer_name"]).count() == 0


def test_incomplete_counts(orders_small):
    rep = Q.incomplete_report(orders_small).first()
    assert (rep.total_records, rep.cleaned_records, rep.errors, rep.warnings) == (10, 6, 5, 10)
    hits = {r.rule: r.hits for r in Q.incomplete_rule_hits(orders_small).collect()}
    assert sum(v for k, v in hits.items() if k.startswith("null_")) == 9
    assert sum(v for k, v in hits.items() if k.startswith("empty_")) == 1
    assert hits["tax_rate_over_100pct"] == 1
    assert [r.order_id for r in Q.incomplete_ids(orders_small).collect()] == [4, 6, 7, 8, 9, 10]


def test_validation_rules(orders_small):
    flagged = R.with_flags(orders_small, R.validation_rules(orders_small.schema))
    ids = lambda c: {r.order_id for r in flagged.filter(F.col(c)).collect()}
    assert ids("invalid_status") == {1, 2, 7, 9}
    assert ids("extreme_quantity") == {4, 5}
    assert ids("extreme_subtotal_amount") == {4}
    assert ids("extreme_shipping_cost") == {4}
    assert ids("invalid_order_date") == {7}
    assert ids("non_numeric_quantity") == {7}


def test_validation_on_raw_strings(spark):
    rows = [("1", "pending", "A", "2020-01-01", "3", "10.5", "0.1", "1", "c", "s"),
            ("2", "pending", "A", "not a date", "x", "abc", "0.1", "1", "c", "s")]
    from shopfloor import schemas as S
    df = spark.createDataFrame(rows, S.ORDERS_RAW)
    flagged = R.with_flags(df, R.validation_rules(df.schema))
    bad = flagged.filter("order_id = '2'").first()
    assert bad.non_numeric_quantity and bad.non_numeric_subtotal_amount and bad.invalid_order_date
    good = flagged.filter("order_id = '1'").first()
    assert not (good.non_numeric_quantity or good.invalid_order_date)


def test_profile_and_overview(orders_small):
    prof = {r.column: r for r in Q.column_profile(orders_small).collect()}
    assert prof["status"].null_count == 1 and float(prof["status"].completeness_pct) == 90.0
    assert prof["quantity"].min == -1.0 and prof["quantity"].max == 1001.0
    assert prof["customer_name"].mean is None
    ov = {r.metric: r.value for r in Q.quality_overview(orders_small).collect()}
    assert ov["total_records"] == 10 and ov["duplicates"] == 2 and ov["incomplete"] == 6
    assert ov["unique_records"] == 8 and ov["column_count"] == 10 and ov["duplicate_rows"] == 0


def test_guide_counts(spark):
    """FIXTURES.md section 3: 5,499 rows with the published marginals give
    2 duplicates, 0 incomplete and 15,455 validation warnings."""
    base = F.col("id") % 5497            # ids 5497, 5498 repeat rows 0 and 1
    df = spark.range(5499).select(
        (F.col("id") + 1).alias("order_id"),
        F.when(F.col("id") < 4924, "Order Finished").when(F.col("id") < 5496, "Order Returned")
         .otherwise("Order Cancelled").alias("status"),
        F.concat(F.lit("c"), base).alias("customer_name"),
        F.expr("date_add(DATE'2009-01-01', CAST(id % 5497 % 1400 AS INT))").alias("order_date"),
        (base % 1000 + 1).cast("int").alias("quantity"),
        F.when(base < 5047, F.lit(150000)).otherwise(F.lit(500)).cast("decimal(18,2)").alias("subtotal_amount"),
        F.lit(0.05).cast("decimal(6,4)").alias("tax_rate"),
        F.when(base >= 590, F.lit(2000)).otherwise(F.lit(5)).cast("decimal(18,2)").alias("shipping_cost"),
        F.when(base < 3064, "Office Supplies").when(base < 4344, "Furniture")
         .otherwise("Technology").alias("category"),
        F.lit("x").alias("subcategory"))
    assert df.count() == 5499
    cats = {r.category: r["count"] for r in df.groupBy("category").count().collect()}
    assert cats == {"Office Supplies": 3066, "Furniture": 1280, "Technology": 1153}
    assert df.filter("subtotal_amount > 100000").count() == 5049
    assert df.filter("shipping_cost > 1000").count() == 4907
    assert Q.duplicate_report(df).first().duplicates_found == 2
    assert Q.incomplete_report(df).first().cleaned_records == 0
    assert Q.validation_report(df).first().warnings == 15455


def test_mark_and_drop_add_up(spark):
    from shopfloor.sources import testdata as td
    df = td.sales_orders_dirty(spark, "/root/testdata/sf0.001")
    marked = Q.mark_duplicates(df)
    n, dups = df.count(), marked.filter("is_duplicate").count()
    assert Q.drop_duplicates_keep_first(df).count() == n - dups
    assert Q.duplicate_report(df).first().duplicates_found == dups > 0


def test_profiles_of_parts_merge(spark, scratch):
    """A refreshed profile equals a full one; only the changed part's folder is read."""
    rows = [(p, i, None if i % 5 == 0 else f"v{i % 7}", i * 1.5 if p != 2 else None) for p in (1, 2, None) for i in range(200)]
    sch = "part int, id int, name string, amount double"
    df = spark.createDataFrame(rows, sch)
    cols = ["id", "name", "amount"]
    kept = PF.partition_profiles(df, F.col("part"), cols)
    merged = {r["column"]: r for r in PF.merge_profiles(kept).collect()}
    assert (merged["name"]["rows"], merged["name"]["null_count"], merged["name"]["distinct_estimate"]) == (600, 120, 7)
    assert (merged["amount"]["low_number"], float(merged["amount"]["total"])) == (0, 2 * 1.5 * sum(range(200)))
    new = df.where("part IS NULL").withColumn("name", F.lit("z")).withColumn("id", F.col("id") + 1000)
    whole = df.where("part IS NOT NULL").unionByName(new)
    got = PF.merge_profiles(PF.refreshed(kept, new, F.col("part"), cols))
    assert rows_of(got) == rows_of(PF.merge_profiles(PF.partition_profiles(whole, F.lit("all"), cols)))
    gone = spark.createDataFrame([(2,)], "part int")
    left = PF.merge_profiles(PF.refreshed(kept, new.limit(0), F.col("part"), cols, gone=gone))
    assert {r["rows"] for r in left.collect()} == {400}
    path = scratch + "/profiled"
    df.write.partitionBy("part").parquet(path)
    one = PF.partition_profiles(spark.read.parquet(path).where("part = 1"), F.col("part"), cols)
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()
    assert {(r.part, r.rows) for r in one.collect()} == {("1", 200)}
    assert PF.merge_profiles(PF.partition_profiles(df.limit(0), F.col("part"))).count() == 0
