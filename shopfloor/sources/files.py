"""File sources and sinks.

Readers always use an explicit schema (no inference) and keep malformed
records in ``_corrupt_record`` (PERMISSIVE).  Writers never funnel data
through one task unless asked (``single_file``).  Multi-output jobs are
published atomically: each output to a new ``version=`` folder, then a
manifest that readers follow, written last.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import rules as R
from ..operators.analytics import bi_extract
from ..operators.changes import upsert
from .json_array import RANGE_BYTES, read_json_array


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])


def read_orders(spark: SparkSession, path: str, fmt: str = "parquet", raw: bool = False,
                multiline: bool = False) -> DataFrame:
    """The order table from parquet, CSV (header) or JSON.

    ``raw=True`` reads every column as text (for the coercion rules);
    ``multiline=True`` reads a JSON array document in one task (S8; a large one
    is read by :func:`read_order_array`)."""
    schema = S.ORDERS_RAW if raw else S.ORDERS
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    r = spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    if fmt == "csv":
        return r.option("header", True).csv(path)
    if fmt == "json":
        return r.option("multiLine", multiline).json(path)
    raise ValueError(f"unknown format {fmt}")


def read_order_array(spark: SparkSession, path: str, raw: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The order table from JSON array document(s), by many tasks.  ``_seq`` is
    the place of a row in its file; a broken element is in ``_corrupt_record``."""
    schema = _with_corrupt(S.ORDERS_RAW if raw else S.ORDERS)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # a generated row, so that each element is parsed once: of a plain column, push-down puts a parse into every rule
    parsed = F.inline(F.array(F.from_json("record", schema, options)))
    return read_json_array(spark, path, range_bytes).select(parsed, F.struct("path", "offset").alias("_seq"))


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with header.  One file only on request (``coalesce(1)``
    funnels everything through one task; fine for small exports only)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def json_ready(df: DataFrame) -> DataFrame:
    """Dates as ISO text, decimals as double (the reference's
    export conventions)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines (one object per line; the reference wrote one array --
    JSON Lines splits across tasks, an array would not)."""
    json_ready(df).write.mode(mode).json(path)


def with_file_order(df: DataFrame, col: str = "_seq") -> DataFrame:
    """Position of each row in its input file(s), for "last row wins".

    (file, split start, row id): rows of one split keep file order in the
    monotonically increasing id; splits of a file are ordered by offset."""
    return df.withColumn(col, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                       F.monotonically_increasing_id()))


def _import_value(field: T.StructField) -> "F.Column":
    """Import text as the column's type; NULL where the type can't hold it."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return c
    if isinstance(field.dataType, T.DateType):
        return c.try_cast("timestamp").try_cast("date")
    number = c.try_cast("decimal(38,10)")
    if isinstance(field.dataType, T.IntegralType):
        return F.when(number == F.floor(number), number.try_cast(field.dataType))
    return number.try_cast(field.dataType)


def import_orders(target: DataFrame, source: DataFrame) -> dict[str, DataFrame]:
    """Validate an import BEFORE writing, then upsert.

    ``source`` is a raw (all-text) order file read with ``read_orders(...,
    raw=True)`` plus ``with_file_order``.  Rows that fail coercion, NOT
    NULL or CHECK constraints of the table, or whose value the column's type
    can't hold, go to ``rejects`` with their violations; the rest are typed,
    reduced to the last row per order id (file order) and upserted.  A whole
    number may be written as ``3.0`` or ``1e3``.  Nothing is written here.
    """
    sch = source.schema
    values = {f.name: _import_value(f) for f in S.ORDERS.fields}
    rules = ([r for r in R.validation_rules(sch) if r.name.startswith("non_numeric_") or r.name == "invalid_order_date"]
             + [R.Rule(f"unfit_{c}", "import", "error", c, F.col(c).isNotNull() & v.isNull()) for c, v in values.items()]
             + [R.Rule(f"null_{c}", "import", "error", c, F.col(c).isNull()) for c in S.ORDER_FIELDS]
             + R.order_model_rules(sch)
             + [R.Rule("order_id_invalid", "import", "error", "order_id",
                       values["order_id"].isNull())])
    tagged = source.withColumn("violations", R.violations(rules))
    if "_corrupt_record" in source.columns:
        tagged = tagged.withColumn("violations", F.when(F.col("_corrupt_record").isNotNull(),
                                                        F.array_union("violations", F.array(F.lit("malformed"))))
                                   .otherwise(F.col("violations")))
    good = tagged.filter(F.size("violations") == 0)
    rejects = tagged.filter(F.size("violations") > 0).drop("_seq")
    typed = good.select(*[values[f.name].alias(f.name) for f in S.ORDERS.fields], "_seq")
    res = upsert(target, typed, "order_id", seq="_seq")
    return {"target": res["target"], "rejects": rejects, "report": res["report"].drop("rejected")}


def bi_feed(orders: DataFrame, path: str, as_of_ts=None) -> DataFrame:
    """The 13-column BI extract written partitioned by year (readers
    prune by year), plus a one-row metadata DataFrame (record count, load
    time) computed by the same job's aggregate."""
    ext = bi_extract(orders)
    ext.write.mode("overwrite").partitionBy("year").parquet(path)
    ts = as_of_ts if as_of_ts is not None else F.current_timestamp()
    return orders.sparkSession.read.parquet(path).agg(
        F.count(F.lit(1)).alias("total_records"), F.max(ts).alias("last_updated"))


def verify_import(source: DataFrame, target: DataFrame, key: str = "order_id",
                  sample: int = 5) -> dict[str, DataFrame]:
    """Post-load verification: counts, ``sample`` rows (by key), and a
    full reconciliation: rows of the source not in the target and vice
    versa (``exceptAll``, so duplicates count too)."""
    cols = [c for c in source.columns if c in target.columns]
    s, t = source.select(*cols), target.select(*cols)
    counts = (s.select(F.lit(1).alias("_s"), F.lit(None).cast("int").alias("_t"))
              .unionByName(t.select(F.lit(None).cast("int").alias("_s"), F.lit(1).alias("_t")))
              .agg(F.count("_s").alias("source_rows"), F.count("_t").alias("target_rows")))
    return {"counts": counts,
            "sample": t.orderBy(key).limit(sample),
            "missing": s.exceptAll(t), "unexpected": t.exceptAll(s)}


# ---------------------------------------------------------------------------
# Schema export / table creation
# ---------------------------------------------------------------------------

def export_schema(schema: T.StructType = S.ORDERS) -> str:
    return S.ddl(schema)


def create_table(spark: SparkSession, name: str, schema: T.StructType, path: str, fmt: str = "parquet"):
    """Register an (empty) external table with the given schema."""
    return spark.catalog.createTable(name, path=path, source=fmt, schema=schema)


# ---------------------------------------------------------------------------
# atomic multi-output publication (N10, Hard 3/4)
# ---------------------------------------------------------------------------

def write_versioned(outputs: dict[str, DataFrame], base: str, version: int | str,
                    fmt: str = "parquet") -> str:
    """Write each output to ``base/<name>/version=<v>`` then the manifest
    ``base/_manifests/version=<v>`` last.  Readers use :func:`read_latest`;
    a crash before the manifest leaves the previous version current."""
    spark = next(iter(outputs.values())).sparkSession
    for name, df in outputs.items():
        df.write.mode("overwrite").format(fmt).save(os.path.join(base, name, f"version={version}"))
    man = os.path.join(base, "_manifests", f"version={version}")
    spark.createDataFrame([(str(version), json.dumps(sorted(outputs)))], "version string, outputs string") \
        .coalesce(1).write.mode("overwrite").json(man)
    return man


def read_latest(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """The newest published version of one output (numeric versions compare
    as numbers, others as text)."""
    m = spark.read.json(os.path.join(base, "_manifests"))
    order = F.struct(F.col("version").try_cast("long"), F.col("version"))
    v = m.agg(F.max_by("version", order)).first()[0]
    return spark.read.format(fmt).load(os.path.join(base, name, f"version={v}"))


def write_envelopes(events: DataFrame, path: str, mode: str = "append") -> None:
    """S15 re-aimed: event envelopes to JSON Lines (a file/queue sink
    replaces the HTTP POST, which is not built)."""
    events.select("event_type", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                  "source", "data").write.mode(mode).json(path)
