"""Exact deduplication by content sort (operator 6).

Texts are normalised (white space deleted) and range-partitioned by their
first bytes and a hash, with sampled splitters; Spark's external sort
places equal texts next to each other.  Each task then compares every text with its
neighbour, whole text against whole text, and numbers the runs of equal
ones.  The sort key ends with the order of preference and the id, so a
group of copies of any size spreads over as many tasks as it needs; a run
that goes on in the next task is joined by comparing the texts at the two
edges.

Defined results: null counts as empty, and all empty texts are equal; of
equal texts the one with most code points stays, then the smallest doc_id
(null last); repeated rows stay rows of their own, and all rows with the
id that stays count as kept; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_text, offsets, small_batches, written

WHITE = " \t\n\x0b\x0c\r"
HEAD = 48                             # code points of a text that splitters look at
TASK_ROWS_BROADCAST = 1_000_000       # tasks up to which their offsets are broadcast


def sorted_runs(docs: DataFrame) -> DataFrame:
    """Written rows (part, run, doc_id, n_points, text_sha256, edge text) in content order.

    ``first_text`` and ``last_text`` hold the whole text of a task's first and
    last row, and are null elsewhere.
    """
    rows = docs.select(ids_text()).select(
        "doc_id", F.translate(F.coalesce("text", F.lit("")), WHITE, "").alias("norm"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"))
    # Splitters are drawn from short keys, so that the sample stays small however long texts
    # are: the first bytes, then 128 bits of hash where these are equal.
    rows = rows.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("h1", F.xxhash64("norm")) \
        .withColumn("h2", F.xxhash64(F.lit("content"), "norm"))
    last = [F.col("n_points").desc(), F.col("doc_id").asc_nulls_last()]
    placed = rows.repartitionByRange("head", "h1", "h2", *last).sortWithinPartitions("head", "h1", "h2", "norm", *last) \
        .select("norm", "n_points", "doc_id")

    def scan(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        names = ["part", "run", "doc_id", "n_points", "text_sha256", "first_text", "last_text"]
        run, last, sha, waiting = -1, None, None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            norm = b.column("norm")
            head = norm[0].as_py()
            same = [last is not None and last == head] + pc.equal(norm[1:], norm[:-1]).to_pylist()
            runs, shas = [], []
            for i, equal in enumerate(same):
                if not equal:
                    run += 1
                    sha = hashlib.sha256(norm[i].as_buffer()).hexdigest()
                runs.append(run)
                shas.append(sha)
            first = [head if last is None else None] + [None] * (n - 1)
            last = norm[n - 1].as_py()
            rows = [pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), b.column("doc_id"),
                    b.column("n_points"), pa.array(shas, pa.string()), pa.array(first, pa.string())]
            # the last row waits: it is the task's last row only if no batch follows
            if waiting is not None:
                yield pa.record_batch([*waiting, pa.nulls(1, pa.string())], names=names)
            waiting = [c[n - 1:] for c in rows]
            yield pa.record_batch([*(c[:n - 1] for c in rows), pa.nulls(n - 1, pa.string())], names=names)
        if waiting is not None:
            yield pa.record_batch([*waiting, pa.array([last], pa.string())], names=names)

    return written(placed.transform(small_batches).mapInArrow(scan, "part int, run long, doc_id long, n_points int, text_sha256 string, "
                                           "first_text string, last_text string"), "content-order")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = sorted_runs(docs)
    # one row a task: its runs, and whether its first run goes on from the task before
    tasks = rows.groupBy("part").agg(F.max("run").alias("top"), F.max("first_text").alias("first_text"),
                                     F.max("last_text").alias("last_text"))
    before = Window.orderBy("part")
    tasks = tasks.select("part", (F.col("top") + 1 - F.coalesce((F.lag("last_text").over(before) == F.col("first_text"))
                                                               .cast("long"), F.lit(0))).alias("new"),
                         (F.col("top") + 1).alias("runs"))
    # group number = new runs of earlier tasks + run, less one where the first run goes on
    base = offsets(tasks, "part", "new", "sum").select(
        "part", (F.col("sum") + F.col("new") - F.col("runs")).alias("base"))
    base = base.checkpoint(eager=True)
    near = F.broadcast(base) if base.count() <= TASK_ROWS_BROADCAST else base
    numbered = rows.select("part", "run", "doc_id", "n_points", "text_sha256").join(near, "part") \
        .withColumn("group", F.col("base") + F.col("run"))
    best = F.struct(F.col("n_points").alias("n"), F.coalesce(-F.col("doc_id"), F.lit(-(1 << 63))).alias("d"))
    groups = numbered.groupBy("group").agg(F.max_by("doc_id", best).alias("keep_id"),
                                           F.count(F.lit(1)).alias("group_size"))
    return numbered.join(groups, "group").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, whole rows: one row of each group.  Rows without an
    id and rows that share one are told apart by their text; of rows that have
    the kept id and an equal text, one with the most code points stays."""
    keep = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha")).distinct()
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("`doc_id`").cast("long").alias("id"),
                       F.sha2(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]", ""), 256).alias("sha"), F.char_length(text).alias("n"))
    best = rows.join(keep, F.col("id").eqNullSafe(F.col("_keep")) & (F.col("sha") == F.col("_sha"))) \
        .groupBy("sha").agg(F.max_by("row", "n").alias("row"))
    return best.select("row.*")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
                  regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS t FROM documents),
k AS (SELECT t, arg_min(doc_id, (-c, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, k.keep_id, k.group_size, n.doc_id = k.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN k USING (t)
"""
