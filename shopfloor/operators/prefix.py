"""Running sums within segments, without a window over a whole segment.

A segment (a session, a product) may hold a third of all rows.  The rows are
sorted over all partitions, cut into blocks, and each block is summed; the
sums of the earlier blocks (one row a block) and a window inside the block
give every row its running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK_ROWS = 4096               # rows of a block
BLOCK = ["_pid", "_blk"]
_ROW_BITS = 33                  # layout of monotonically_increasing_id


def in_blocks(df: DataFrame, order_by: list, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` sorted by ``order_by``, each row with its partition ``_pid``, block
    ``_blk`` and place ``_row``; checkpointed, so that a row keeps its place."""
    checkpoint_dir(df.sparkSession)
    placed = df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    return (placed.withColumn("_pid", F.shiftright("_mid", _ROW_BITS))
            .withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
            .withColumn("_blk", F.expr(f"_row div {block_rows}")).drop("_mid"))


def running_sums(placed: DataFrame, segment: list[str], **values: Column) -> DataFrame:
    """``placed`` (see :func:`in_blocks`, sorted by ``segment`` first) with each of
    ``values`` summed over the rows of the segment before and with each row."""
    block = [*segment, *BLOCK]
    rows = placed.select("*", *[F.coalesce(v.cast("long"), F.lit(0)).alias(f"_v_{k}") for k, v in values.items()])
    before = Window.partitionBy(*segment).orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*block).agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    sums = sums.select(*[F.col(c).alias(f"_k_{c}") for c in block],
                       *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    here = Window.partitionBy(*block).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in segment] + [F.col(c) == F.col(f"_k_{c}") for c in BLOCK]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = rows.join(sums, on)
    return joined.select(*placed.columns, *[(F.col(f"_b_{k}") + F.sum(f"_v_{k}").over(here)).alias(k) for k in values])
