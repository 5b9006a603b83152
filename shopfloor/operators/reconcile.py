"""Reconciliation of two tables by a tree of checksums over key ranges.

``exceptAll`` shuffles both tables whole.  Here each side is read once and
summed up: a leaf holds the rows of ``leaf_width`` consecutive keys as a
count and two sums of row hashes (combinable, a row a leaf), an inner node
``FANOUT`` children.  The trees are compared from the top down, only below
nodes that differ, and only the rows in leaves that differ are compared one
by one.  A tree may be written and kept, so that a side that has not changed
is not read again.

Two ranges with different rows are taken for equal only if their counts and
both 64-bit sums agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

FANOUT = 256
SUMS = ["rows", "sum_a", "sum_b"]


def _leaf(key: str, leaf_width: int):
    return F.expr(f"floor(`{key}` / cast({leaf_width} as decimal(20,0)))").cast("long")


def checksum_leaves(df: DataFrame, key: str, leaf_width: int) -> DataFrame:
    """(leaf, rows, sum_a, sum_b); ``key`` is a whole number, null keys share the leaf NULL.

    A null takes part in a row's hash, so a value can't move to another column unseen."""
    parts = [x for c in sorted(df.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]

    def total(seed):
        return F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)"))
    return df.groupBy(_leaf(key, leaf_width).alias("leaf")).agg(
        F.count(F.lit(1)).alias("rows"), total(1).alias("sum_a"), total(2).alias("sum_b"))


def _level(leaves: DataFrame, up: int) -> DataFrame:
    """The nodes ``up`` levels above the leaves."""
    node = F.expr(f"floor(leaf / {FANOUT ** up}D)").cast("long") if up else F.col("leaf")
    return leaves.groupBy(node.alias("node")).agg(*[F.sum(c).alias(c) for c in SUMS])


def unequal_leaves(a: DataFrame, b: DataFrame, levels: int = 2) -> DataFrame:
    """(leaf) of the leaves of two trees that differ, by descending below unequal nodes."""
    for up in range(levels, -1, -1):
        x, y = _level(a, up), _level(b, up)
        y = y.select(F.col("node").alias("_n"), *[F.col(c).alias(f"_{c}") for c in SUMS])
        same = F.lit(True)
        for c in SUMS:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        differ = x.join(y, F.col("node").eqNullSafe(F.col("_n")), "full").where(~same).select(F.coalesce("node", "_n").alias("_differ"))
        if up == 0:
            return differ.select(F.col("_differ").alias("leaf"))
        node = F.expr(f"floor(leaf / {FANOUT ** up}D)").cast("long")
        a, b = (t.join(differ, node.eqNullSafe(F.col("_differ")), "left_semi") for t in (a, b))


def reconcile(source: DataFrame, target: DataFrame, key: str, leaf_width: int = 4096,
              source_leaves: DataFrame | None = None, target_leaves: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows of ``source`` not in ``target`` (``missing``) and the other way round
    (``unexpected``), repeats counted; ``leaves``: the ranges that differ;
    ``counts``: rows of each side, from the trees.

    Kept trees of either side may be given; they must be of the same columns
    and ``leaf_width``."""
    cols = [c for c in source.columns if c in target.columns]
    s, t = source.select(*cols), target.select(*cols)
    checkpoint_dir(source.sparkSession)
    # every level and output reads the trees, not the tables
    a = source_leaves if source_leaves is not None else checksum_leaves(s, key, leaf_width).checkpoint(eager=True)
    b = target_leaves if target_leaves is not None else checksum_leaves(t, key, leaf_width).checkpoint(eager=True)
    leaves = unequal_leaves(a, b).checkpoint(eager=True)

    def inside(df):
        return df.withColumn("_leaf", _leaf(key, leaf_width)).join(
            leaves.withColumnRenamed("leaf", "_l"), F.col("_leaf").eqNullSafe(F.col("_l")), "left_semi").drop("_leaf")
    s, t = inside(s), inside(t)
    counts = a.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("source_rows")).select(
        F.lit("source").alias("side"), F.col("source_rows").alias("rows")).unionByName(
        b.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).select(F.lit("target").alias("side"), "rows"))
    return {"missing": s.exceptAll(t), "unexpected": t.exceptAll(s), "leaves": leaves, "counts": counts}
