"""Structured Streaming jobs.

Every function here is a transformation of a (streaming) DataFrame or a
``writeStream`` starter.  The transformations work on batch DataFrames
too, which is how the batch operators and the streams share semantics.
Checkpoints and outputs go to the shared checkpoint folder named by
``spark.checkpoint.dir`` (see :func:`shopfloor.session.checkpoint_dir`).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .._shipping import ship_by_value as _ship_by_value
from ..functions.columns import envelope, parse_id_list
from ..operators.changes import apply_order_commands
from ..session import checkpoint_dir
from ..sources.files import write_versioned
from .cart_state import CART_TTL_MS, cart_state

_ship_by_value(__name__)


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of a stream (checkpoint + output)."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def event_time(c: str) -> "F.Column":
    """Watermarks need TIMESTAMP.  A ``timestamp_ntz`` wall time is read as
    UTC by exact arithmetic (micros since the NTZ epoch), so windows and
    timeouts do not depend on the session time zone."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    return F.timestamp_micros(micros)


def utc_day(c) -> "F.Column":
    """DATE of a TIMESTAMP instant in UTC, independent of the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(c) / 86400).cast("int"))


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


# ---------------------------------------------------------------------------
# Live dashboard (complete mode)
# ---------------------------------------------------------------------------

def dashboard_counts(orders: DataFrame) -> DataFrame:
    """Orders and revenue per (dimension, value) for the live
    dashboard: totals, per status, per category -- one aggregation over
    an exploded (dimension, value) pair, so one state store serves all."""
    dims = F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")),
        F.struct(F.lit("status").alias("dimension"), F.col("status").alias("value")),
        F.struct(F.lit("category").alias("dimension"), F.col("category").alias("value")))
    return (orders.select(F.explode(dims).alias("d"), "subtotal_amount")
            .groupBy(F.col("d.dimension").alias("dimension"), F.col("d.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.sum("subtotal_amount").cast("decimal(38,2)").alias("revenue")))


def start_dashboard(agg: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None):
    """Complete-mode sink: each micro-batch is a new version of the result
    (``files.read_latest(spark, out_path, "dashboard")``), published by its
    manifest, so readers and a crash never meet a table half written."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_versioned({"dashboard": batch}, out_path, batch_id)
    w = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return w.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


# ---------------------------------------------------------------------------
# R2: command stream -> versioned order table, exactly once
# ---------------------------------------------------------------------------

def _manifest(base: str, batch_id: int) -> str:
    return os.path.join(base, "_manifests", f"batch={batch_id}")


def command_batch_writer(spark: SparkSession, base: str, initial_target: DataFrame | None,
                         as_of: str | None = None):
    """``foreachBatch`` function applying a micro-batch of commands.

    Layout under ``base``: ``target/version=<n>`` (full order table),
    ``changes/batch=<n>`` (R4 feed), ``rejects/batch=<n>``, and a manifest
    per batch written LAST.  A replayed batch whose manifest exists is
    skipped, so the sink is idempotent; readers follow the newest
    manifest, so a half-written version is never visible.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        man = _manifest(base, batch_id)
        if _exists(spark, man) or batch.isEmpty():
            return                                  # replay: already applied; or only the watermark moved
        last = _last_committed(spark, base)
        target = initial_target if last is None else \
            spark.read.parquet(os.path.join(base, "target", f"version={last['version']}"))
        prev_max = _max_id(target) if last is None else last["max_id"]
        out = apply_order_commands(target, batch, as_of=as_of, next_base=_base_row(spark, prev_max))
        nv = batch_id
        out["target"].write.mode("overwrite").parquet(os.path.join(base, "target", f"version={nv}"))
        out["changes"].write.mode("overwrite").parquet(os.path.join(base, "changes", f"batch={batch_id}"))
        out["rejects"].write.mode("overwrite").parquet(os.path.join(base, "rejects", f"batch={batch_id}"))
        spark.createDataFrame([(batch_id, nv, _created_max(spark, base, batch_id, prev_max))],
                              "batch_id long, version long, max_id long").coalesce(1).write.mode("overwrite").json(man)
    return write


def _last_committed(spark: SparkSession, base: str):
    """The newest manifest's row, or None if nothing is committed yet.  A
    manifest that can't be read fails the batch: taking it for "nothing
    yet" would start again from the initial table."""
    mdir = os.path.join(base, "_manifests")
    if not _exists(spark, mdir):
        return None
    return spark.read.json(mdir).orderBy(F.desc("batch_id")).first()


def _max_id(target: DataFrame) -> int:
    return target.agg(F.coalesce(F.max("order_id"), F.lit(0))).first()[0]


def _base_row(spark: SparkSession, prev_max: int) -> DataFrame:
    return spark.range(1).select(F.lit(prev_max).cast("long").alias("next_base"))


def _created_max(spark: SparkSession, base: str, batch_id: int, prev_max: int) -> int:
    """Highest id ever given out: also of rows created and deleted in one
    batch, so that no layout gives an id twice."""
    new = spark.read.parquet(os.path.join(base, "changes", f"batch={batch_id}")) \
        .where("action = 'created'").agg(F.max("order_id")).first()[0]
    return max(prev_max, new) if new is not None else prev_max


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def current_orders(spark: SparkSession, base: str) -> DataFrame:
    """The order table as of the newest committed batch."""
    v = spark.read.json(os.path.join(base, "_manifests")).select(F.max("version")).first()[0]
    return spark.read.parquet(os.path.join(base, "target", f"version={v}"))


# -- changelog layout: per batch only the touched rows ---------------------

def changelog_view(spark: SparkSession, base: str, snapshot: DataFrame | None = None) -> DataFrame:
    """Current orders = base snapshot overlaid with the committed change log.

    The log holds, per batch, only touched rows ``(order_id, op, seq, ...)``;
    the newest op per order (by batch, then seq) wins: a combinable
    ``max_by`` aggregate, then ``left_anti`` + union (the upsert operator's
    plan).  Batches without a manifest are ignored."""
    snap = snapshot if snapshot is not None else spark.read.parquet(os.path.join(base, "snapshot"))
    if not _exists(spark, os.path.join(base, "_manifests")):
        return snap                                  # nothing committed yet
    committed = spark.read.json(os.path.join(base, "_manifests")).select("batch_id")
    log = spark.read.parquet(os.path.join(base, "changelog"))
    log = log.join(committed, "batch_id", "left_semi")
    cols = [c for c in S.ORDERS.names if c != "order_id"]
    last = (log.groupBy("order_id")
            .agg(F.max_by(F.struct("op", *cols), F.struct("batch_id", "seq")).alias("_r"))
            .select("order_id", "_r.*"))
    kept = snap.join(last.select("order_id"), "order_id", "left_anti")
    return kept.unionByName(last.filter(F.col("op") == "upsert").drop("op"))


def changelog_batch_writer(spark: SparkSession, base: str, snapshot: DataFrame, as_of: str | None = None):
    """``foreachBatch`` function for the changelog layout.

    Writes ``changelog/batch_id=<n>`` (touched rows only) and
    ``rejects/batch=<n>``, then the manifest (with the running max id, so
    new ids never need a scan of the table).  A batch whose manifest
    exists is skipped; a crash before the manifest leaves files that no
    reader sees and that the replay overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if _exists(spark, _manifest(base, batch_id)) or batch.isEmpty():
            return
        last = _last_committed(spark, base)
        prev_max = _max_id(snapshot) if last is None else last["max_id"]
        target = changelog_view(spark, base, snapshot)
        out = apply_order_commands(target, batch, as_of=as_of, next_base=_base_row(spark, prev_max))
        delta = out["delta"].withColumn("batch_id", F.lit(batch_id).cast("long"))
        delta.write.mode("overwrite").parquet(os.path.join(base, "changelog", f"batch_id={batch_id}"))
        out["rejects"].write.mode("overwrite").parquet(os.path.join(base, "rejects", f"batch={batch_id}"))
        out["changes"].write.mode("overwrite").parquet(os.path.join(base, "changes", f"batch={batch_id}"))
        mx = _created_max(spark, base, batch_id, prev_max)
        spark.createDataFrame([(batch_id, mx)], "batch_id long, max_id long") \
            .coalesce(1).write.mode("overwrite").json(_manifest(base, batch_id))
    return write


def compact_changelog(spark: SparkSession, base: str, snapshot: DataFrame, out_path: str) -> None:
    """Fold the committed log into a new snapshot (run off the hot path)."""
    changelog_view(spark, base, snapshot).write.mode("overwrite").parquet(out_path)


def start_command_stream(spark: SparkSession, commands: DataFrame, base: str, initial_target: DataFrame,
                         as_of: str | None = None, trigger: dict | None = None, layout: str = "snapshot",
                         message_id: str | None = None, sent_at: str = "sent_at", redelivery: str = "7 days"):
    """R2: queued commands -> foreachBatch apply.

    A queue may deliver a message more than once.  With ``message_id`` (and
    the event time ``sent_at``) each message is applied the first time it
    comes, in whichever batch; ids are kept in the state store for the time
    ``redelivery`` behind the newest message, and a message that comes later
    than that is dropped as late.

    ``layout="snapshot"`` publishes a full order table per batch (simple,
    for small tables); ``layout="changelog"`` writes only the touched rows
    per batch over a fixed snapshot (``initial_target``), so a batch costs
    what it touches -- the layout for large tables."""
    if message_id:
        commands = (commands.withWatermark(sent_at, redelivery).dropDuplicatesWithinWatermark([message_id])
                    .select("seq", "action", "data"))
    fn = (changelog_batch_writer(spark, base, initial_target, as_of) if layout == "changelog"
          else command_batch_writer(spark, base, initial_target, as_of))
    w = (commands.writeStream.option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .foreachBatch(fn))
    return w.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


# ---------------------------------------------------------------------------
# Change feed from two snapshots, event envelopes
# ---------------------------------------------------------------------------

def diff_snapshots(old: DataFrame, new: DataFrame, key: str = "order_id",
                   compare=S.ORDER_FIELDS, ts=None) -> DataFrame:
    """``(key, action, severity, timestamp, old_status, new_status, row)``
    by a full outer join of two snapshots: created / deleted / updated (any
    compared field differs, NULL-safely).  ``row`` has the compared fields as
    they are now (all NULL for a deleted row)."""
    o = old.select(F.col(key).alias("_k"), F.lit(True).alias("_o"),
                   *[F.col(c).alias(f"o_{c}") for c in compare])
    n = new.select(F.col(key).alias("_k"), F.lit(True).alias("_n"),
                   *[F.col(c).alias(f"n_{c}") for c in compare])
    j = o.join(n, "_k", "full_outer")
    changed = None
    for c in compare:
        d = ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
        changed = d if changed is None else (changed | d)
    action = (F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "deleted")
              .when(changed, "updated"))
    return (j.withColumn("action", action).filter(F.col("action").isNotNull())
            .withColumn("severity", F.when(F.col("action") == "created", "success")
                        .when(F.col("action") == "deleted", "warning").otherwise("info"))
            .select(F.col("_k").alias(key), "action", "severity",
                    (ts if ts is not None else F.current_timestamp()).alias("timestamp"),
                    F.col("o_status").alias("old_status"), F.col("n_status").alias("new_status"),
                    F.struct(*[F.col(f"n_{c}").alias(c) for c in compare]).alias("row")))


def change_events(diff: DataFrame, ts, source: str = "shopfloor", key: str = "order_id") -> DataFrame:
    """Envelopes order.created / order.updated (id and fields) and
    order.deleted (id), plus order.status_changed where old and new status
    differ."""
    live = F.col("action") != "deleted"             # to_json leaves out NULL members
    base = diff.select(
        *envelope(F.concat(F.lit("order."), F.col("action")),
                  F.struct(F.col(key).alias("order_id"),
                           *[F.when(live, F.col(f"row.{c}")).alias(c) for c in diff.schema["row"].dataType.names]),
                  ts, source),
        F.col(key).alias(key))
    status = diff.filter((F.col("action") == "updated")
                         & ~F.col("old_status").eqNullSafe(F.col("new_status"))).select(
        *envelope("order.status_changed",
                  F.struct(F.col(key).alias("order_id"), F.col("old_status"), F.col("new_status")), ts, source),
        F.col(key).alias(key))
    return base.unionByName(status)


# ---------------------------------------------------------------------------
# Alerts (stateless)
# ---------------------------------------------------------------------------

def bulk_status_events(requests: DataFrame, orders: DataFrame, new_status: str, ts,
                       source: str = "shopfloor", batch: str = "batch_id", ids: str = "ids") -> DataFrame:
    """One order.bulk_status_update per request: its ids, the status, and how
    many orders have one of them.  The id list is the request's own text; the
    counts are one aggregate over all requests."""
    asked = requests.select(F.col(batch).alias("_b"), parse_id_list(F.col(ids)).alias("_ids"))
    hits = (asked.select("_b", F.explode(F.array_distinct("_ids")).alias("_id"))
            .join(orders.select(F.col("order_id").alias("_id")), "_id", "left_semi")
            .groupBy("_b").agg(F.count(F.lit(1)).alias("_n")))
    return asked.join(hits, "_b", "left").select(
        *envelope("order.bulk_status_update",
                  F.struct(F.col("_ids").alias("order_ids"), F.lit(new_status).alias("new_status"),
                           F.coalesce("_n", F.lit(0)).alias("updated_count")), ts, source), F.col("_b").alias(batch))


def daily_summary_events(summary: DataFrame, ts, source: str = "shopfloor") -> DataFrame:
    """R7 rows as report.daily_summary envelopes, one per day and status."""
    return summary.select(*envelope("report.daily_summary", F.struct("day", "status", "event_count", "amount"), ts, source),
                          "day", "status")


def low_stock_alerts(products: DataFrame, threshold: int, ts, source: str = "shopfloor") -> DataFrame:
    """Envelope per product whose stock fell below ``threshold``."""
    low = products.filter(F.col("stock_quantity") < threshold)
    return low.select(*envelope("inventory.low_stock",
                                F.struct(F.col("name").alias("product"),
                                         F.col("stock_quantity").alias("current_stock"),
                                         F.lit(threshold).alias("threshold")), ts, source), "product_id")


def high_value_alerts(orders: DataFrame, threshold, ts, amount_col: str = "subtotal_amount",
                      source: str = "shopfloor") -> DataFrame:
    """Envelope per order above ``threshold``."""
    hv = orders.filter(F.col(amount_col) > F.lit(threshold))
    return hv.select(*envelope("order.high_value",
                               F.struct("order_id", F.col(amount_col).cast("double").alias("amount"),
                                        F.col("customer_name").alias("customer")), ts, source), "order_id")


# ---------------------------------------------------------------------------
# Daily summary (event-time tumbling window, watermark, append)
# ---------------------------------------------------------------------------

def daily_summary(events: DataFrame, ts_col: str = "ts", delay: str = "1 hour",
                  status_col: str = "event_type", amount_col: str = "value") -> DataFrame:
    """Per day and status: count and amount.  A ``timestamp_ntz`` event
    time is read as UTC (:func:`event_time`) for the watermark; append mode
    emits a day once the watermark passes its end, so late rows within
    ``delay`` are still counted and later ones are dropped."""
    ntz = dict(events.dtypes).get(ts_col) == "timestamp_ntz"
    t = event_time(ts_col) if ntz else F.col(ts_col)
    return (events.withColumn("_ts", t).withWatermark("_ts", delay)
            .groupBy(F.window("_ts", "1 day").alias("w"), F.col(status_col).alias("status"))
            .agg(F.count(F.lit(1)).alias("event_count"),
                 # exact decimal sum: independent of partitioning and order
                 F.sum(F.col(amount_col).cast("decimal(38,10)")).cast("double").alias("amount"))
            .select(utc_day(F.col("w.start")).alias("day"), F.col("w.start").alias("day_start"),
                    F.col("w.end").alias("day_end"), "status", "event_count", "amount"))


# ---------------------------------------------------------------------------
# Cart state per session with a 7-day inactivity timeout
# ---------------------------------------------------------------------------


def cart_state_stream(actions: DataFrame, products: DataFrame, delay: str = "1 hour", ttl_ms: int = CART_TTL_MS) -> DataFrame:
    """Streaming cart lines per session (stream-static join with the
    catalog, then keyed state, see :mod:`.cart_state`).

    ``actions``: streaming ``(session_id, seq, action, product_id,
    quantity, ts)``.  Output mode ``update``: each trigger emits the
    current lines of every session that changed (a row without product if
    there are none), expired carts, and rows with ``reason`` for actions
    that came too late to be applied."""
    ntz = dict(actions.dtypes).get("ts") == "timestamp_ntz"
    return cart_state(actions, products, event_time("ts") if ntz else F.col("ts"), delay, ttl_ms)
