"""Helpers shared by the operators: table access, shared-folder tables,
process-wide caches and dense positions without a one-task window."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends there, so a
    lost executor never changes what later steps read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_cache(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, kept between its tasks."""
    store = sys.modules.setdefault("_shopfloor_process_cache", types.ModuleType("_shopfloor_process_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def rows_of(batches, columns):
    """Python rows of Arrow batches, column lists zipped."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))


ARROW_BYTES = 2 << 20           # bytes of an Arrow batch on its way to a Python worker (a longer row alone)


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is, its session's Arrow batches bounded by ``ARROW_BYTES``.

    Rows hold whole texts, and a batch of 10,000 of them is held by the JVM
    and by the worker at once.  A lower bound set by the user stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df


BATCH_CHARS = 1 << 20           # bytes of text handled at once (a longer text alone)


def slices(batches, most: int = BATCH_CHARS):
    """Slices of Arrow batches with about ``most`` bytes of text."""
    import numpy as np
    import pyarrow.compute as pc
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, n = 0, b.num_rows
        while at < n:
            start = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def text_slices(batches, most: int = BATCH_CHARS):
    """As ``slices``, with the texts of each (null: empty)."""
    for part in slices(batches, most):
        yield part, [t or "" for t in part.column("text").to_pylist()]


def utf8_of(column):
    """The bytes of a string column, one text after the other, and where each begins and ends (null: empty)."""
    import numpy as np
    column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def ids_text(doc_id: str = "doc_id", text: str = "text"):
    """The two columns an operator reads, under its own names; extra columns
    of the input, whatever they are called, go no further."""
    return [F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")]


def offsets(counts: DataFrame, part: str, count: str, out: str, by: list[str] = ()) -> DataFrame:
    """Running sum of ``count`` over earlier ``part`` s (per ``by``).

    ``counts`` has one row per task (and ``by`` value), never one per data
    row, so its windows stay small at every input size.
    """
    w = Window.partitionBy(*by).orderBy(part) if by else Window.orderBy(part)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long"))


def rest_of(df: DataFrame, *names: str):
    """All columns but ``names`` as one struct column, so that no name clashes with a helper's."""
    left = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return (F.struct(*left) if left else F.struct(F.lit(None).cast("int").alias("none"))).alias("rest")


def as_before(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """``columns`` in their order: those in ``new`` from there, the others from ``rest``."""
    return df.select(*[new[c].alias(c) if c in new else F.col(f"rest.`{c}`").alias(c) for c in columns])
