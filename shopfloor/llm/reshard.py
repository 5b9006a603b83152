"""Resharding by minimum-cost flow (operator 1).

Old shards are sources with their sizes in bytes, new shards sinks with
their capacities.  A byte that stays in its shard costs nothing, a byte
that moves costs one.  The flow of least cost is solved on the numbers of
the shards alone; it says how many bytes go from each old shard to each
new one.  Within an old shard rows are ordered by falling size; what stays
comes first, then the blocks that move, so that block edges fall among
small rows.  A row goes where its middle byte falls.

Positions are running sums over a range-sorted copy of (doc_id, size,
checksum), so a shard of any size, or one key with a third of all rows,
spreads over many tasks.  Texts take no part in it.

Defined results: a null text has no bytes, only the ``overhead``; rows of
equal size are ordered by doc_id, null first; repeated rows are placed
each on its own; an empty table gives an empty table; further columns are
ignored.  The law is ``bytes``: sizes of the new shards are near equal, and
equal texts may lie in different shards.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, rest_of, small_batches, written

OVERHEAD = 16
NO_SHARD = -1                   # the old shard of rows that have none; all of them move


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, moving the fewest: successive
    shortest paths with potentials over source -> old -> new -> sink.

    An arc old -> new costs 0 if both are the same shard, else 1.  Needs
    sum(capacity) >= sum(supply).
    """
    if sum(capacity.values()) < sum(supply.values()):
        raise ValueError("the new shards are too small")
    olds, news = sorted(supply), sorted(capacity)
    source, sink = ("s",), ("t",)
    graph: dict[tuple, dict[tuple, list[int]]] = {}

    def arc(a, b, room, cost):
        graph.setdefault(a, {})[b] = [room, cost]
        graph.setdefault(b, {})[a] = [0, -cost]

    for o in olds:
        arc(source, ("o", o), supply[o], 0)
        for n in news:
            arc(("o", o), ("n", n), supply[o], int(o != n))
    for n in news:
        arc(("n", n), sink, capacity[n], 0)
    graph.setdefault(source, {})
    graph.setdefault(sink, {})
    potential = dict.fromkeys(graph, 0)
    while True:
        dist, via, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for b, (room, cost) in graph[a].items():
                e = d + cost + potential[a] - potential[b]
                if room and e < dist.get(b, 1 << 60):
                    dist[b], via[b] = e, a
                    heapq.heappush(queue, (e, b))
        if sink not in dist:
            break
        far = dist[sink]
        for a in graph:
            potential[a] += min(dist.get(a, far), far)
        path, b = [], sink
        while b != source:
            path.append((via[b], b))
            b = via[b]
        push = min(graph[a][b][0] for a, b in path)
        for a, b in path:
            graph[a][b][0] -= push
            graph[b][a][0] += push
    return {(o, n): graph[("n", n)][("o", o)][0] for o in olds for n in news if graph[("n", n)][("o", o)][0]}


def block_edges(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, first byte, end byte): what stays first, then by new shard."""
    out, at = [], {}
    for (o, n), size in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out.append((o, n, at.get(o, 0), at.get(o, 0) + size))
        at[o] = at.get(o, 0) + size
    return out


def _keys(old_shard: Column, overhead: int) -> list[Column]:
    """doc_id, old_shard, size, text_crc32 of a row."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    return [F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(old_shard.cast("int"), F.lit(NO_SHARD)).alias("old_shard"),
            (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")]


def reshard(docs: DataFrame, old_shard: Column, n_new: int, capacity: dict[int, int] | None = None,
            overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot of every row.

    ``capacity`` defaults to equal shares of all bytes.  ``slot`` numbers the
    rows of a new shard from 0.
    """
    spark = docs.sparkSession
    rows = docs.select(*_keys(old_shard, overhead))
    order = [F.col("old_shard"), F.col("size").desc(), F.col("doc_id"), F.col("text_crc32")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def running(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        at: dict[int, tuple[int, int]] = {}
        for b in batches:
            before = []
            for o, s in zip(b.column("old_shard").to_pylist(), b.column("size").to_pylist()):
                n, size = at.get(o, (0, 0))
                before.append((n, size))
                at[o] = n + 1, size + s
            yield pa.record_batch([*b.columns, pa.array([part] * b.num_rows, pa.int32()),
                                   pa.array([n for n, _ in before], pa.int64()), pa.array([s for _, s in before], pa.int64())],
                                  names=[*b.schema.names, "part", "nth", "before"])

    rows = written(placed.transform(small_batches).mapInArrow(running, "doc_id long, old_shard int, size long, text_crc32 long, part int, nth long, "
                                              "before long"), "reshard")
    sums = rows.groupBy("part", "old_shard").agg(F.sum("size").alias("bytes"))
    supply = {r[0]: r[1] for r in sums.groupBy("old_shard").agg(F.sum("bytes")).collect()}     # one row a shard
    total = sum(supply.values())
    capacity = capacity or {n: total // n_new + (n < total % n_new) for n in range(n_new)}
    edges = block_edges(min_cost_flow(supply, capacity))
    starts = offsets(sums, "part", "bytes", "base", by=["old_shard"])
    blocks: dict[int, list[tuple[int, int]]] = {}
    for o, n, _, end in edges:
        blocks.setdefault(o, []).append((end, n))
    blocks_df = spark.createDataFrame(
        [(o, [e for e, _ in b], [n for _, n in b]) for o, b in blocks.items()],
        "old_shard int, ends array<long>, news array<int>")
    # one row a task and old shard, one row an old shard
    where = starts.select("part", "old_shard", "base").join(F.broadcast(blocks_df), "old_shard")
    moved = rows.join(F.broadcast(where), ["part", "old_shard"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "part", "nth",
        F.expr("element_at(news, least(size(news), 1 + size(filter(ends, e -> e <= base + before + floor(size / 2)))))")
        .alias("shard"))
    # slots: a block's rows of a task follow one another, so the first one's number is enough
    firsts = moved.groupBy("part", "old_shard", "shard").agg(F.min("nth").alias("nth0"), F.count(F.lit(1)).alias("n"))
    firsts = offsets(firsts.withColumn("k", F.struct("part", "old_shard")), "k", "n", "slot0", by=["shard"])
    return moved.join(F.broadcast(firsts.select("part", "old_shard", "shard", "slot0", "nth0")),
                      ["part", "old_shard", "shard"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("slot0") + F.col("nth") - F.col("nth0")).alias("slot"))


def transfers(assignment: DataFrame) -> DataFrame:
    """old_shard, shard, rows, bytes of every block that moves."""
    return assignment.where("old_shard != shard").groupBy("old_shard", "shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


CHUNK = 1 << 16                 # equal rows that are numbered together at most


def _copies(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``copy``: the number of each among equal rows, from 0, in ``order`` of chunk and column.

    Equal rows are numbered by chunks, so one row with a third of all repeats is no single task's work.
    """
    keys = ["no_id", "id", "size", "text_crc32", "old_shard"]
    rows = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long")))
    before = offsets(rows.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n")), "chunk", "n", "base", by=keys)
    nth = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(order)) - 1
    return rows.withColumn("nth", nth).join(before.select(*keys, "chunk", "base"), [*keys, "chunk"]) \
        .withColumn("copy", F.col("base") + F.col("nth")).drop("base", "nth", "chunk", "doc_id")


def rewrite(docs: DataFrame, old_shard: Column, assignment: DataFrame, path: str, overhead: int = OVERHEAD) -> None:
    """Write the shards whose rows change (given or taken); the others stay as they are.

    ``docs``, ``old_shard`` and ``overhead`` are those of :func:`reshard`.  Each
    row of ``docs`` takes one row of ``assignment`` with its doc_id, size,
    checksum and old shard; rows that agree in these are interchangeable.
    """
    moved = transfers(assignment)
    # A row's new shard is affected just when its old one is: rows of other shards are neither copied nor joined.
    # Broadcast: one row a shard.
    affected = F.broadcast(written(moved.select(F.col("old_shard").alias("_shard")).union(moved.select("shard")).distinct(), "affected"))

    def of_affected(rows):
        return rows.join(affected, F.col("old_shard") == F.col("_shard"), "left_semi")
    # the copy fixes the rows' numbers
    every = written(of_affected(docs.select(rest_of(docs), *_keys(old_shard, overhead)))
                    .withColumn("row", F.monotonically_increasing_id()), "rewrite")
    assignment = of_affected(assignment)
    rows = _copies(every.drop("rest").withColumn("chunk", F.floor(F.col("row") / CHUNK)), "row")
    places = _copies(assignment.withColumn("chunk", F.struct("shard", F.floor(F.col("slot") / CHUNK).alias("c"))), "slot")
    to = rows.join(places, ["no_id", "id", "size", "text_crc32", "old_shard", "copy"]).select("row", "shard", "slot")
    (every.select("rest", "row").join(to, "row")
     .select("rest.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
     .repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
     .write.partitionBy("_shard").parquet(path))
