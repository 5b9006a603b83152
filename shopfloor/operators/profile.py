"""Mergeable table profiles.

A profile has one row per part of a table (a year, a load) and column: counts,
exact sum, bounds, and the state of a distinct-count sketch.  Profiles of parts
merge into that of the table, so when a part changes only that part is read
again.  Everything but the distinct count is exact; that is an estimate
(HyperLogLog, about 1.6 % standard error at the default 2**12 buckets).

Defined results: numbers are summed and bounded as decimal(38,10), all other
types are bounded by their text; a column without values has null bounds, sum
and a distinct count of 0; a part without rows has no profile; a null part is a
part of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_BITS = 12
_NUMBER = "decimal(38,10)"


def partition_profiles(df: DataFrame, part: Column, columns: list[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """(part, column, rows, non_null, total, low_number, high_number, low_text,
    high_text, sketch): one aggregate over one scan."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        number = c.cast(_NUMBER) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast(_NUMBER)
        text = F.lit(None).cast("string") if isinstance(f.dataType, T.NumericType) else c.cast("string")
        aggs.append(F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("non_null"),
                             F.sum(number).cast(_NUMBER).alias("total"), F.min(number).alias("low_number"),
                             F.max(number).alias("high_number"), F.min(text).alias("low_text"), F.max(text).alias("high_text"),
                             F.hll_sketch_agg(c.cast("string"), F.lit(bits)).alias("sketch")).alias(f"_c{i}"))
    wide = df.groupBy(part.cast("string").alias("part")).agg(*aggs)
    return wide.select("part", F.explode(F.array(*[f"_c{i}" for i in range(len(fields))])).alias("p")).select("part", "p.*")


def merge_profiles(profiles: DataFrame, by: list[str] = ()) -> DataFrame:
    """The profile of all parts together (or per ``by``), with the distinct estimate."""
    return profiles.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"),
        F.sum(F.col("rows") - F.col("non_null")).alias("null_count"),
        F.sum("total").cast(_NUMBER).alias("total"), F.min("low_number").alias("low_number"),
        F.max("high_number").alias("high_number"), F.min("low_text").alias("low_text"), F.max("high_text").alias("high_text"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))


def refreshed(profiles: DataFrame, changed: DataFrame, part: Column, columns: list[str] | None = None,
              gone: DataFrame | None = None) -> DataFrame:
    """``profiles`` with the parts of ``changed`` profiled anew; ``gone`` (part) names parts that no longer exist.

    ``changed`` holds whole parts, read through the table's partitions: other parts are not read."""
    old = changed.select(part.cast("string").alias("_old"))
    if gone is not None:
        old = old.unionByName(gone.select(F.col("part").cast("string").alias("_old")))
    return (profiles.join(old.distinct(), F.col("part").eqNullSafe(F.col("_old")), "left_anti")
            .unionByName(partition_profiles(changed, part, columns)))
