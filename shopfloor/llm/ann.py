"""Approximate nearest neighbours (operator 10).

A hierarchical k-means tree is fitted on a bounded sample of the unit
vectors; every row is then indexed at the leaf it descends to.  A query
walks the tree best-bin-first: a priority queue holds nodes by the
distance to their centres, and leaves are visited in the order in which
they are popped.  How many leaves are visited is calibrated: for a set of
calibration queries the true neighbours are found by an exact pass over
all rows, in blocks, and the visits are widened until the neighbours' leaves
are reached for the wanted share of them.

Leaves are split into blocks of at most ``block`` rows (a vector that a third
of all rows share fills many) and the queries by a hash of their id into parts
of about ``QUERY_ROWS``, so that one task holds a block and a part at most.  Each
block answers the queries of each part with its own nearest rows, and these are
merged per query.  Scores are computed in
double precision from the original vectors, in an order that doesn't
depend on the block, so equal vectors have equal scores.

The model is fitted on at most ``FIT_ROWS`` rows, drawn by a hash of the id;
every row is indexed.

Defined results: vectors that are null, empty, zero, of another length
than most, or hold null or non-finite components take no part, neither as
queries nor as candidates; ties go to the smaller vec_id; rows that repeat a
vec_id are candidates once (the vector of the smallest bytes); fewer
candidates than k give fewer rows; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import offsets, written

FIT_ROWS = 20_000
CALIBRATION_QUERIES = 64
BRANCHES = 8
LEAF_ROWS = 64                  # sample rows below which a node is a leaf
BLOCK_ROWS = 2_000
QUERY_ROWS = 20_000
RECALL = 0.98


class Tree:
    """Nodes with centres; ``children`` are ranges of nodes, leaves have a number."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 11):
        self.centres = [sample.mean(0) if len(sample) else np.zeros(0)]
        self.children: list[tuple[int, int]] = [(0, 0)]
        rng = np.random.default_rng(seed)
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            groups = self._split(sample[rows], branches, rng)
            parts = [rows[groups == g] for g in range(groups.max() + 1)]
            parts = [p for p in parts if len(p)]
            if len(parts) < 2:
                continue                                  # all rows alike
            first = len(self.centres)
            self.children[node] = (first, first + len(parts))
            for k, p in enumerate(parts):
                self.centres.append(sample[p].mean(0))
                self.children.append((0, 0))
                todo.append((first + k, p))
        self.centres = np.array(self.centres)
        self.leaf = np.full(len(self.centres), -1)
        ends = [n for n, (a, b) in enumerate(self.children) if a == b]
        self.leaf[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    @staticmethod
    def _split(x, k, rng, rounds: int = 8):
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            near = (x @ centres.T - 0.5 * (centres ** 2).sum(1)).argmax(1)
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            n = np.bincount(near, minlength=len(centres))
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        return near

    def descend(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x``."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            a, b = self.children[node]
            if a == b:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[a:b]
            near = (x[rows] @ c.T - 0.5 * (c ** 2).sum(1)).argmax(1)
            todo += [(a + k, rows[near == k]) for k in range(b - a) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            a, b = self.children[node]
            if a == b:
                out.append(int(self.leaf[node]))
                continue
            away = ((self.centres[a:b] - q) ** 2).sum(1)
            for k in range(b - a):
                heapq.heappush(queue, (float(away[k]), a + k))
        return out


def _vectors(column, dim: int) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(-1, dim)


def units(x: np.ndarray) -> np.ndarray:
    """Scaled to length 1, whatever the size of the components."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q with each row, each row summed alone and in the same order."""
    q = q / np.abs(q).max()
    x = x / np.abs(x).max(1, keepdims=True)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def nearest_in(queries, qids, x, ids, k):
    """(query, id, score) of the k nearest rows in a block for each query."""
    out = []
    ux, uq = units(x), units(queries)
    for at in range(0, len(queries), 256):
        rough = uq[at:at + 256] @ ux.T
        for i, row in enumerate(rough):
            q, qid = queries[at + i], qids[at + i]
            others = int((ids == qid).any())
            limit = np.partition(row, -min(k + others, len(row)))[-min(k + others, len(row))] - 1e-9
            rows = np.flatnonzero((row >= limit) & (ids != qid))
            score = cosines(q, x[rows])
            best = np.lexsort((ids[rows], -score))[:k]
            out += [(int(qid), int(ids[rows[b]]), float(score[b])) for b in best]
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) with one row an id, and the length of the vectors."""
    v = F.col(f"`{column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND "
        "abs(x) < double('Infinity')) AND exists(v, x -> x != 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = int(sizes["n"]) if sizes else 1
    rows = rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows, dim


def search(vectors: DataFrame, is_query, k: int = 5, recall: float = RECALL, fit_rows: int = FIT_ROWS,
           branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, block: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found of each query.

    ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    rows = written(rows, "vectors")
    mixed = F.xxhash64("vec_id", F.lit("fit"))
    sample = rows.orderBy(mixed, "vec_id").limit(fit_rows).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(units(_vectors(sample, dim)) if len(sample) else np.zeros((0, dim)), branches, leaf_rows)

    def to_leaf(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            leaves = tree.descend(units(_vectors(b.column("v"), dim))) if b.num_rows else np.zeros(0, np.int64)
            place = []
            for f in leaves.tolist():
                place.append(seen.get(f, 0))
                seen[f] = seen.get(f, 0) + 1
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(leaves, pa.int32()),
                                   pa.array([part] * b.num_rows, pa.int32()), pa.array(place, pa.int64())],
                                  names=["vec_id", "v", "leaf", "part", "place"])

    indexed = written(rows.mapInArrow(to_leaf, "vec_id long, v array<double>, leaf int, part int, place long"), "leaves")
    counts = indexed.groupBy("part", "leaf").agg(F.count(F.lit(1)).alias("n"))
    base = offsets(counts, "part", "n", "base", by=["leaf"]).select("part", "leaf", "base")
    # a row's block within its leaf: blocks have at most ``block`` rows
    blocked = indexed.join(base, ["part", "leaf"]).select(
        "leaf", F.floor((F.col("base") + F.col("place")) / block).cast("int").alias("block"), "vec_id", "v")
    blocks = counts.groupBy("leaf").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))

    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    parts = max(1, -(-queries.count() // query_rows))
    visits = _calibrated(spark, rows, queries, tree, dim, k, recall)

    def plan(batches):
        import pyarrow as pa
        for b in batches:
            uq = units(_vectors(b.column("q"), dim)) if b.num_rows else np.zeros((0, dim))
            leaves = [tree.visit(q, visits) for q in uq]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in leaves])
            yield pa.record_batch([b.column("query_id").take(pa.array(at)), b.column("q").take(pa.array(at)),
                                   pa.array([f for x in leaves for f in x], pa.int32())], names=["query_id", "q", "leaf"])

    asked = queries.mapInArrow(plan, "query_id long, q array<double>, leaf int").join(blocks, "leaf").select(
        "leaf", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), _part("query_id", parts).alias("part"), "query_id", "q")
    blocked = blocked.select("*", F.explode(F.expr(f"sequence(0, {parts - 1})")).alias("part"))

    def answer(_, left, right):
        import pandas as pd
        got = []
        if len(left) and len(right):
            x, ids = np.stack(right["v"].to_numpy()), right["vec_id"].to_numpy()
            got = nearest_in(np.stack(left["q"].to_numpy()), left["query_id"].to_numpy(), x, ids, k)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

    group = ["leaf", "block", "part"]
    found = (asked.groupBy(*group).cogroup(blocked.groupBy(*group))
             .applyInPandas(answer, "query_id long, vec_id long, score double"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return (found.groupBy("query_id").agg(top.alias("top"))
            .select("query_id", F.posexplode("top").alias("i", "t"))
            .select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"),
                    (-F.col("t.s")).alias("score")))


def _part(query_id: str, parts: int):
    return F.pmod(F.xxhash64(query_id, F.lit("part")), F.lit(parts)).cast("int")


def exact(rows: DataFrame, qids: np.ndarray, queries: np.ndarray, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): k nearest of a bounded set of queries, against all rows in blocks."""

    def block(batches):
        import pyarrow as pa
        for b in batches:
            got = []
            if b.num_rows:
                got = nearest_in(queries, qids, _vectors(b.column("v"), dim), b.column("vec_id").to_numpy(), k)
            c = list(zip(*got)) or [[]] * 3
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64())],
                                  names=["query_id", "vec_id", "score"])

    found = rows.select("vec_id", "v").mapInArrow(block, "query_id long, vec_id long, score double")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(top.alias("t")).select("query_id", F.explode("t").alias("t")).select(
        "query_id", F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def _calibrated(spark, rows, queries, tree, dim, k, recall) -> int:
    """Leaves to visit so that ``recall`` of the true neighbours of a bounded
    set of calibration queries are reached."""
    some = queries.orderBy(F.xxhash64("query_id", F.lit("calibrate")), "query_id").limit(CALIBRATION_QUERIES).collect()
    if not some or tree.leaves <= 1:
        return max(1, tree.leaves)
    q = np.array([r["q"] for r in some], np.float64)
    qids = np.array([r["query_id"] for r in some])
    true = exact(rows, qids, q, dim, k).join(rows, "vec_id").select("query_id", "v").collect()   # queries times k rows
    order = {i: {f: n for n, f in enumerate(tree.visit(u, tree.leaves))} for i, u in zip(qids.tolist(), units(q))}
    leaves = tree.descend(units(np.array([r["v"] for r in true], np.float64)))
    needed = np.sort([order[r["query_id"]][int(f)] + 1 for r, f in zip(true, leaves)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
