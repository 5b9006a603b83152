import os

from pyspark.sql import functions as F

from shopfloor import schemas as S
from shopfloor.functions import columns as C
from shopfloor.functions import rules as R
from shopfloor.operators import dedupe as D
from shopfloor.operators import quality as Q
from shopfloor.sources import files as FS
from domain_rows import rows_of


def test_schema_export_and_table(spark, scratch):
    ddl = FS.export_schema(S.ORDERS)
    assert ddl.startswith("order_id bigint NOT NULL, status string") and "subtotal_amount decimal(18,2)" in ddl
    t = FS.create_table(spark, "orders_ext_test", S.ORDERS, os.path.join(scratch, "t"))
    assert t.schema.names == S.ORDERS.names and t.count() == 0


def test_repoint_and_issue_list(spark, orders_small):
    items = spark.createDataFrame([(1, 12), (2, 3)], "order_item_id long, product_id long")
    mapping = spark.createDataFrame([(12, 2)], "old_id long, keep_id long")
    assert rows_of(D.repoint(items, mapping)) == [(1, 2), (2, 3)]
    issues = {r.rule: r.issue for r in Q.validation_issues(orders_small).collect()}
    assert issues["invalid_status"] == "status: 4 invalid_status"
    assert "extreme_quantity" in issues


def test_column_helpers(spark, products_seed):
    df = spark.createDataFrame([("Pending", "12.5", "2020-02-30", "a@b.co"), (None, "x", "2020-02-03", "nope")],
                               "s string, n string, d string, e string")
    r = df.select(C.in_domain("s", ["pending"]).alias("ok"), C.try_numeric("n").alias("num"),
                  C.try_date("d").alias("dt"), C.valid_email("e").alias("mail")).collect()
    assert [x.ok for x in r] == [True, False]
    assert r[0].num is not None and r[1].num is None
    assert r[0].dt is None and r[1].dt is not None
    assert [x.mail for x in r] == [True, False]
    bad = products_seed.withColumn("price", F.when(F.col("product_id") == 3, -F.col("price")).otherwise(F.col("price")))
    _, q = R.split_valid(bad, R.product_model_rules(bad.schema))
    assert [(x.product_id, list(x.violations)) for x in q.collect()] == [(3, ["price_ge_0"])]
