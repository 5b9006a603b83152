"""Plan properties that matter at scale, asserted on the executed plans."""

import contextlib
import io
import os
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from shopfloor.operators import analytics as an
from shopfloor.operators import changes as CH
from shopfloor.operators import ids as I
from shopfloor.operators import quality as Q
from shopfloor.sources import testdata as td

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    """AQE's final plan: run the DataFrame's own query (test data is small)."""
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in p
    return p.split("== Initial Plan ==")[0]


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_flagship_prunes_columns(spark):
    f = formatted(E.queries()["a5_category_summary"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in f
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in f


def test_filter_reaches_parquet_scan(spark, orders_small, scratch):
    p = os.path.join(scratch, "orders")
    orders_small.write.parquet(p)
    f = formatted(an.orders_by_status(spark.read.parquet(p), "pending"))
    assert "EqualTo(status,pending)" in f


def test_duplicates_without_window(spark):
    p = plan(Q.mark_duplicates(td.sales_orders_dirty(spark, SF)))
    assert "Window" not in p and "BroadcastNestedLoopJoin" not in p


def test_bi_summary_single_pass(spark):
    f = formatted(an.bi_summary(td.sales_orders(spark, SF)))
    assert "Expand" in f
    scans = re.findall(r"^\(\d+\) Scan parquet", f, flags=re.M)
    assert len(scans) == 3                       # orders, customer, lineitem: each read once


def test_command_fold_has_no_nested_loops(spark):
    out = CH.apply_order_commands(td.sales_orders(spark, SF), td.order_commands(spark, SF),
                                  as_of="2024-06-01 00:00:00")
    for k in ("target", "changes", "rejects"):
        p = plan(out[k])
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_dense_ids_no_row_window(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    p = plan(I.dense_ids(df, ["k"], "x", base=0))
    # the only single-partition step is the running sum over per-partition counts, and rows
    # and counts read one checkpointed copy
    assert p.count("SinglePartition") <= 1 and "BroadcastNestedLoopJoin" not in p and "rangepartitioning" not in p


def test_hot_duplicate_key_is_split_by_aqe(spark):
    """One duplicate key holds a third of the rows: with broadcasts off, the
    join back of mark_duplicates is a sort-merge join and AQE splits the
    skewed partition (results stay exact)."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 30000
        hot = F.col("id") % 3 == 0
        df = spark.range(n).select(
            F.col("id").alias("order_id"),
            F.when(hot, F.lit("HOT")).otherwise(F.concat(F.lit("c"), (F.col("id") % 5000).cast("string")))
             .alias("customer_name"),
            F.lit(None).cast("date").alias("order_date"), F.lit("x").alias("category"),
            F.lit(1).alias("quantity"), F.lit(1).cast("decimal(18,2)").alias("subtotal_amount"))
        marked = Q.mark_duplicates(df)
        p = plan(marked)
        assert "SortMergeJoin(skew=true)" in p and "AQEShuffleRead skewed" in p
        dups = marked.filter("is_duplicate").count()
        assert dups == n - marked.select("customer_name").distinct().count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
