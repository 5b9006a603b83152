"""Session construction and cluster-aware helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library relies on.  AQE re-plans joins
# (broadcast when the measured side is small, skew-split when one key is
# hot) and coalesces shuffle partitions at runtime.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Suggested settings for a large cluster (~100 TB inputs, ~1000 executors).
# Start with many shuffle partitions and let AQE coalesce them to the
# advisory size: each reduce task then holds ~256 MB, which fits executor
# memory and spills gracefully.  Skewed partitions (a hot key) are split
# when they exceed 5x the median and 1 GB.  Scan splits of 512 MB keep the
# task count of a 100 TB scan near 200k.  The broadcast threshold bounds
# every runtime-chosen broadcast.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(master: str | None = None, app_name: str = "shopfloor",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None, cluster: bool = False) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``master`` is only used when given; on a cluster the launcher decides.
    ``cluster=True`` adds :data:`CLUSTER_CONF`.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder for lineage cuts and versioned outputs.

    A cluster names it in ``spark.checkpoint.dir``; that value is always
    used.  Only when it is unset and the master is local (tests, local
    runs) a private scratch folder is created and registered; a cluster
    without a shared folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="shopfloor-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some deployments refuse core confs at runtime
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _one_chain(df: DataFrame) -> bool:
    """Whether each step of the plan has one input.  With several, AQE may end a query whose
    other stages still run, and these would wait for shuffle files that are gone."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1:
        node = node.children().head()
    return node.children().isEmpty()


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession):
    """A query that starts and ends in here leaves no shuffle files; else they stay until
    the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def shared_copy(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.  Lineage ends there,
    as with a checkpoint, but it takes fewer bytes, and the planner knows its size."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, name)}-{uuid.uuid4().hex}"
    with _dropping_shuffles(spark) if _one_chain(df) else contextlib.nullcontext():
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
