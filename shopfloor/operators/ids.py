"""Dense sequential ids (max + 1, max + 2, ...) without a one-task window.

``row_number()`` over an un-partitioned window moves every row into a
single task.  Instead the rows are range-sorted across all partitions,
each row gets its position inside its partition, and a per-partition
offset (a running sum over one row per partition -- bounded by the
partition count, hence safe to broadcast) turns that into a global rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, shared_copy

_ROW_BITS = 33                      # layout of monotonically_increasing_id
_ROW_MASK = (1 << _ROW_BITS) - 1


def next_id(target: DataFrame, id_col: str) -> DataFrame:
    """One-row ``(next_base)`` = COALESCE(MAX(id), 0)."""
    return target.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("next_base"))


def dense_ids(df: DataFrame, order_by: list, id_col: str = "id",
              base: int | Column | DataFrame = 0) -> DataFrame:
    """Add ``id_col`` = base + 1, base + 2, ... in ``order_by`` order.

    ``order_by`` must be a total order (end it with a unique key) so the
    ids are reproducible.  ``base`` may be an int, a literal Column, or a
    one-row DataFrame with a ``next_base`` column (see :func:`next_id`).

    The sorted, position-tagged rows are always checkpointed to the shared
    checkpoint folder.  The counts and the rows then read one and the same
    copy: as two branches of one plan each would have a range exchange of
    its own, sampled and coalesced by its own size, and a position would
    mean different rows in each.
    """
    ordered = df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id())
    checkpoint_dir(df.sparkSession)
    return _numbered(ordered.checkpoint(eager=True), id_col, base)


def ordered_copy(df: DataFrame, order_by: list[str], tag: Callable[[DataFrame], DataFrame], first: str) -> DataFrame:
    """``df`` in ``order_by`` order as a compressed copy, each row with its place ``_mid``.

    ``tag`` adds columns to the rows on their way into the copy, after the
    shuffle, so they are computed once and never shuffled.  Rows for which the
    boolean column ``first`` of it holds (they must have a value of the first
    sort column) come before the others of their partition, so their row
    numbers have no gaps (see :func:`ids_in_place`).  ``_mid`` is in order among
    these rows, and among the others.
    """
    # Rows are compared by the first key alone where it differs: the flag itself would be a poor one.
    ahead = F.when(F.col(first), F.col(order_by[0])).asc_nulls_last()
    placed = tag(df.repartitionByRange(*order_by)).sortWithinPartitions(ahead, *order_by)
    return shared_copy(placed.withColumn("_mid", F.monotonically_increasing_id()), "in-order", compression="zstd")


def ids_in_place(rows: DataFrame, id_col: str = "id", base: int | Column | DataFrame = 0) -> DataFrame:
    """:func:`dense_ids` of all ``first`` rows of an :func:`ordered_copy`, which are
    neither sorted nor copied again; the partitions are counted once."""
    return _numbered(rows, id_col, base, keep=True)


def _numbered(ordered: DataFrame, id_col: str, base: int | Column | DataFrame, keep: bool = False) -> DataFrame:
    """Rows in order, tagged with ``_mid``, numbered over all partitions; ``keep``:
    the partitions' offsets are checkpointed, for several readers of the result."""
    ordered = (ordered.withColumn("_pid", F.shiftright(F.col("_mid"), _ROW_BITS))
               .withColumn("_row", F.col("_mid").bitwiseAND(F.lit(_ROW_MASK))))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # The base enters the running sum as a row before partition 0, so
    # offset(p) = base + rows of all earlier partitions -- no join needed.
    if isinstance(base, DataFrame):
        base_row = base.select(F.lit(-1).cast("long").alias("_pid"), F.col("next_base").cast("long").alias("_cnt"))
    else:
        b = base if isinstance(base, Column) else F.lit(base)
        base_row = counts.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_pid"),
                                                        b.cast("long").alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.unionByName(base_row)
               .select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
               .filter(F.col("_pid") >= 0))
    if keep:
        checkpoint_dir(ordered.sparkSession)
        offsets = offsets.checkpoint(eager=True)
    # one row per partition: bounded by the partition count
    out = ordered.join(F.broadcast(offsets), "_pid")
    out = out.withColumn(id_col, (F.col("_off") + F.col("_row") + 1).cast("bigint"))
    return out.drop("_mid", "_pid", "_row", "_off")
