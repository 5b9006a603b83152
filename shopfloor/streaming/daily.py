"""Daily summary that accounts for late rows.

``jobs.daily_summary`` leaves out rows that come after their day was closed.
Here each micro-batch is split by the watermark of the last committed batch,
which its manifest keeps:

- rows of open days become partial sums, ``partials/batch=<n>/day=<d>``;
- rows of closed days go to ``late/batch=<n>`` as they are, and one correction
  per day and status to ``corrections/batch=<n>``; rows without a time likewise
  go to ``late`` (they have no day and no correction);
- days that the new watermark closes are summed over the partials of these days
  alone (partition pruning) into ``closed/batch=<n>``.

So closed + corrections = all rows of closed days.  A batch's folders are written
before its manifest and overwritten when it is replayed; readers take committed
batches only.  A batch's rows, late rows and newest time are counted by ``observe``
while they are written.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import envelope
from .jobs import _exists, _last_committed, _manifest, utc_day

DAY_MS = 24 * 3600 * 1000
_AMOUNT = "decimal(38,10)"
_MANIFEST = "batch_id long, watermark long, rows long, late_rows long"


def _delay_ms(delay: str) -> int:
    units = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS}
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", delay)
    if not m:
        raise ValueError(f"unknown delay {delay!r}")
    return int(m[1]) * units[m[2]]


_SUM_ROWS = f"status string, event_count long, amount {_AMOUNT}"


def _sums():
    """Count and exact sum; decimals add up the same in any order."""
    return F.count(F.lit(1)).alias("event_count"), F.sum(F.col("amount").cast(_AMOUNT)).cast(_AMOUNT).alias("amount")


def summary_batch_writer(spark: SparkSession, base: str, delay: str = "1 hour"):
    """``foreachBatch`` function over rows ``(t timestamp, status, amount, ...)``."""
    delay_ms = _delay_ms(delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        man = _manifest(base, batch_id)
        if _exists(spark, man):
            return                                        # replay
        last = _last_committed(spark, base)
        before = last["watermark"] if last else None

        def path(kind):
            return os.path.join(base, kind, f"batch={batch_id}")
        # a day is closed once the watermark has reached its end
        closed = F.unix_millis("t") < F.lit((before // DAY_MS) * DAY_MS) if before is not None else F.lit(False)
        rows = batch.withColumn("day", utc_day(F.col("t"))).withColumn("_late", F.coalesce(closed, F.lit(True)) | F.col("t").isNull())
        (rows.where(~F.col("_late")).groupBy("day", "status").agg(*_sums(), F.max(F.unix_millis("t")).alias("newest"))
         .write.mode("overwrite").partitionBy("day").parquet(path("partials")))
        late = rows.where("_late").drop("_late")
        late.write.mode("overwrite").parquet(path("late"))
        late = spark.read.schema(late.schema).parquet(path("late"))
        late.where("day IS NOT NULL").groupBy("day", "status").agg(*_sums()).write.mode("overwrite").parquet(path("corrections"))
        # rows of closed days are older than the watermark: only open days move it
        seen = spark.read.schema(f"{_SUM_ROWS}, newest long").parquet(path("partials")).agg(
            F.coalesce(F.sum("event_count"), F.lit(0)).alias("open"), F.max("newest").alias("newest")).first()
        n_late = late.count()
        known = [w for w in (before, seen["newest"] - delay_ms if seen["newest"] is not None else None) if w is not None]
        now = max(known) if known else None
        if now is not None:
            days = F.col("day") < utc_day(F.timestamp_millis(F.lit(now)))
            if before is not None:
                days &= F.col("day") >= utc_day(F.timestamp_millis(F.lit(before)))
            _closing(spark, base, batch_id, days).write.mode("overwrite").parquet(path("closed"))
        spark.createDataFrame([(batch_id, now, seen["open"] + n_late, n_late)], _MANIFEST) \
            .coalesce(1).write.mode("overwrite").json(man)
    return write


def _closing(spark, base, batch_id, days) -> DataFrame:
    """Sums of the days that close now, over committed partials and this batch's."""
    partials = spark.read.schema(f"{_SUM_ROWS}, batch long, day date").parquet(os.path.join(base, "partials"))
    done = committed_batches(spark, base).unionByName(spark.range(1).select(F.lit(batch_id).cast("long").alias("batch")))
    return (partials.where(days).join(done, "batch", "left_semi").groupBy("day", "status")
            .agg(F.sum("event_count").alias("event_count"), F.sum("amount").cast(_AMOUNT).alias("amount")))


def committed_batches(spark: SparkSession, base: str) -> DataFrame:
    mdir = os.path.join(base, "_manifests")
    if not _exists(spark, mdir):
        return spark.createDataFrame([], "batch long")
    return spark.read.schema(_MANIFEST).json(mdir).select(F.col("batch_id").alias("batch"))


def _committed(spark, base, kind, schema) -> DataFrame:
    path = os.path.join(base, kind)
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path).join(committed_batches(spark, base), "batch", "left_semi")


def closed_days(spark: SparkSession, base: str) -> DataFrame:
    """(day, status, event_count, amount, batch) as each day was closed."""
    return _committed(spark, base, "closed", f"day date, {_SUM_ROWS}")


def corrections(spark: SparkSession, base: str) -> DataFrame:
    """(day, status, event_count, amount, batch): what late rows add to closed days."""
    return _committed(spark, base, "corrections", f"day date, {_SUM_ROWS}")


def correction_events(rows: DataFrame, ts, source: str = "shopfloor") -> DataFrame:
    """Corrections as report.daily_summary_correction envelopes."""
    data = F.struct("day", "status", "event_count", F.col("amount").cast("double").alias("amount"))
    return rows.select(*envelope("report.daily_summary_correction", data, ts, source), "day", "status")


def start_daily_summary(events: DataFrame, base: str, delay: str = "1 hour", trigger: dict | None = None):
    """``events``: streaming ``(t timestamp, status, amount)``."""
    fn = summary_batch_writer(events.sparkSession, base, delay)
    w = events.writeStream.option("checkpointLocation", os.path.join(base, "_checkpoint")).foreachBatch(fn)
    return w.trigger(**(trigger or {"processingTime": "30 seconds"})).start()
