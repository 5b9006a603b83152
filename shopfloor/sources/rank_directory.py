"""Listings that can jump to page n (L1, L2): a range-sorted copy of a table
with the number of rows of each part.

``LIMIT`` with a deep ``OFFSET`` sorts the table and sends offset + limit rows
through one task for every page.  Here the table is sorted once; each part of
the copy holds a run of ranks and every row its place in the part.  The rows
of a page lie in one part or two, known from the directory, so a page reads
these parts' files alone, and in them only the row groups with its places.

With ``segment`` (L2: one customer's orders) the copy is sorted by segment
first, and the directory has a row for each segment and part, so the pages
of one segment are found alike, however many parts it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import in_blocks


class RankDirectory:
    """A listing below ``path``: ``rows`` (by part) and ``parts`` (the directory)."""

    def __init__(self, spark: SparkSession, path: str, segment: str | None = None):
        self.spark, self.path, self.segment = spark, path.rstrip("/"), segment

    @classmethod
    def write(cls, df: DataFrame, path: str, order_by: list, segment: str | None = None) -> RankDirectory:
        """Sort ``df`` by ``segment``, then ``order_by`` (a total order: end it with a
        unique key) and write the copy and its directory."""
        out = cls(df.sparkSession, path, segment)
        placed = in_blocks(df, [*([F.col(segment).asc_nulls_first()] if segment else []), *order_by]).drop("_blk")
        rows = placed.withColumnRenamed("_pid", "_part")
        rows.write.partitionBy("_part").parquet(f"{out.path}/rows")
        rows.limit(0).write.parquet(f"{out.path}/schema")           # of an empty table there is no other file
        seg = [segment] if segment else []
        parts = placed.groupBy(*seg, "_pid").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first_row"))
        before = Window.partitionBy(*(seg or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        # one row for each part (and segment in it)
        parts = parts.select(*seg, F.col("_pid").alias("_part"), "_rows", "_first_row",
                             F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rank"))
        parts.write.parquet(f"{out.path}/parts")
        return out

    def _parts(self, value=None) -> DataFrame:
        parts = self.spark.read.parquet(f"{self.path}/parts")
        return parts if self.segment is None else parts.where(F.col(self.segment).eqNullSafe(F.lit(value)))

    def page(self, number: int, per_page: int = 50, value=None) -> DataFrame:
        """Page ``number`` (from 1) in order, of the segment ``value`` if there are segments."""
        if number < 1 or per_page < 1:
            raise ValueError("number and per_page start at 1")
        low, high = (number - 1) * per_page, number * per_page
        hits = self._parts(value).where((F.col("_rank") < high) & (F.col("_rank") + F.col("_rows") > low)).collect()
        rows = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")
        pieces = F.lit(False)
        for h in hits:                  # the parts that hold the page's ranks
            first = h["_first_row"] + max(0, low - h["_rank"])
            last = h["_first_row"] + min(h["_rows"], high - h["_rank"])
            pieces = pieces | ((F.col("_part") == h["_part"]) & (F.col("_row") >= first) & (F.col("_row") < last))
        rows = rows.where(F.col("_part").isin([h["_part"] for h in hits])).where(pieces)
        # at most a page of rows
        return rows.orderBy("_part", "_row").drop("_part", "_row")

    def info(self, per_page: int = 50, value=None) -> DataFrame:
        """L1 header from the directory alone: total rows and pages."""
        return (self._parts(value).agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("total"))
                .withColumn("per_page", F.lit(per_page).cast("bigint"))
                .withColumn("total_pages", F.expr(f"(total + {per_page} - 1) div {per_page}")))
