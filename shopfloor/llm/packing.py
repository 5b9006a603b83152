"""Packing by non-negative least squares (operator 9).

Every text's ids with an end id are cut into full windows and a rest.
Lengths count in units of ``quantum`` ids, rounded up.  Shallow
combinations that fill a window exactly (up to three pieces, or one
length several times with one more piece) are the columns of a matrix, the number of pieces of each length its right-hand side.
Non-negative least squares gives the repeat counts, which are rounded
down; the pieces that no combination takes are laid end to end and cut
where a window ends.  The very last window is split at powers of two, so
that it needs no padding.

The solver sees a histogram of ``window / quantum`` numbers, whatever the
size of the input.  Pieces are numbered by running counts per task and
length, never by one window over all rows.

Defined results: a null text counts as empty and gives one piece with the
end id; equal texts and repeated rows are packed each on its own; texts
of any length are cut; an empty table gives no pieces; further columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, small_batches
from .tokens import token_pieces

BROADCAST_ROWS = 1_000_000      # (task, length) rows up to which their offsets are broadcast


def combinations(units: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((length, times), ...) of few different lengths that add up to ``units``:
    up to three pieces, or one length several times with one more piece."""
    triples = [(units - b - c, b, c) for b in range(units // 2 + 1) for c in range(min(b, units - 2 * b) + 1)
               if units - b - c >= b]
    out = [tuple((x, t.count(x)) for x in dict.fromkeys(t) if x) for t in triples]
    for c in range(1, units // 3 + 1):
        for m in range(3, units // c + 1):
            rest = units - m * c
            out.append(((c, m + (rest == c)),) if rest in (0, c) else ((c, m), (rest, 1)))
    return list(dict.fromkeys(tuple(sorted(c, reverse=True)) for c in out))


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least ||matrix x - target||, by active sets."""
    n = matrix.shape[1]
    x = np.zeros(n)
    passive: list[int] = []
    scale = max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        gradient = matrix.T @ (target - matrix @ x)
        gradient[passive] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= 1e-9 * scale:
            break
        passive.append(j)
        while passive:
            s = np.linalg.lstsq(matrix[:, passive], target, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[passive] = s
                break
            now = x[passive]
            low = s <= 0
            step = (now[low] / np.maximum(now[low] - s[low], 1e-300)).min()
            now = now + step * (s - now)
            x[:] = 0
            x[passive] = np.maximum(now, 0)
            passive = [p for p, v, bad in zip(passive, now, low) if not (bad and v <= 1e-12 * scale)]
    return x


def plan(histogram: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeat count) of each combination used; ``histogram[c]``
    pieces have length c.  Never takes more pieces than there are."""
    left = histogram.astype(np.int64).copy()
    out = []
    if left[units]:
        out.append(((units,), int(left[units])))
        left[units] = 0
    combos = [c for c in combinations(units) if all(left[x] >= m for x, m in c)]
    if not combos:
        return out
    matrix = np.zeros((units + 1, len(combos)))
    for j, c in enumerate(combos):
        for x, m in c:
            matrix[x, j] = m
    # lengths weigh by their size: what counts is ids, not pieces
    weight = np.sqrt(np.arange(units + 1.0))[:, None]
    x = nnls(matrix * weight, left * weight[:, 0])
    for j in np.argsort(-x, kind="stable"):
        n = min(int(x[j] + 1e-6), *(int(left[c]) // m for c, m in combos[j]), 1 << 62)
        if n > 0:
            out.append((tuple(c for c, m in combos[j] for _ in range(m)), n))
            for c, m in combos[j]:
                left[c] -= m * n
    return out


def slots(chosen: list[tuple[tuple[int, ...], int]], units: int):
    """For each length the rank intervals that combinations take, as sorted
    arrays (first rank, first sequence, pieces a sequence takes, first place),
    and the ranks taken in all; then the number of sequences."""
    first: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = np.zeros(units + 1, np.int64)
    base = 0
    for lengths, n in chosen:
        place = 0
        for c in dict.fromkeys(lengths):
            m = lengths.count(c)
            first.setdefault(c, []).append((int(taken[c]), base, m, place))
            taken[c] += m * n
            place += m
        base += n
    return {c: np.array(v, np.int64) for c, v in first.items()}, taken, base


def ends_of(total: int, window: int) -> np.ndarray:
    """Where the sequences of ``total`` ids laid end to end end, beyond the full
    windows: the rest, split into powers of two."""
    full = total // window * window
    cuts, at, rest = [], full, total - full
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            cuts.append(at)
    return np.array(cuts, np.int64)


def pack(docs: DataFrame, vocab_path: str, window: int = 4096, end_id: int = 2, quantum: int = 16,
         with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    wanted, ids (little-endian, 32 bits) of every piece."""
    if window % quantum:
        raise ValueError("quantum must divide window")
    units = window // quantum
    spark = docs.sparkSession
    pieces = token_pieces(docs, vocab_path, window, end_id, quantum)
    counts = pieces.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(units + 1, np.int64)
    for c, n in counts.groupBy("class").agg(F.sum("n")).collect():          # one row a length
        histogram[c] = n
    chosen = plan(histogram, units)
    taken_by, taken, sequences = slots(chosen, units)

    ranks = offsets(counts, "part", "n", "rank0", by=["class"])
    taken_df = spark.createDataFrame([(c, int(t)) for c, t in enumerate(taken)], "class int, taken long")
    ranks = ranks.join(F.broadcast(taken_df), "class")
    n_ranks = int(ranks.count())

    def near(df):
        return F.broadcast(df) if n_ranks <= BROADCAST_ROWS else df

    # the pieces left over: of each task and length those from a rank on
    rest = (pieces.select("part", "class", "pos", "before", "length").join(near(ranks), ["part", "class"])
            .where(F.col("rank0") + F.col("pos") >= F.col("taken"))
            .groupBy("part", "class").agg(F.sum("length").alias("sum"), F.min("before").alias("skip")))
    rest = rest.withColumn("key", F.col("class") * F.lit(1 << 32) + F.col("part")).checkpoint(eager=True)
    total = rest.agg(F.sum("sum")).first()[0] or 0
    by_class = offsets(rest.groupBy("class").agg(F.sum("sum").alias("all")), "class", "all", "class0")
    inside = offsets(rest, "part", "sum", "part0", by=["class"])
    lines = inside.join(F.broadcast(by_class.select("class", "class0")), "class").select(
        "part", "class", (F.col("class0") + F.col("part0") - F.col("skip")).alias("line0"))
    where = ranks.join(lines, ["part", "class"], "left").select("part", "class", "rank0", "line0")
    tail = ends_of(total, window)
    full = total // window
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"] + ["ids"] * with_ids

    def assign(batches):
        import pyarrow as pa
        for b in batches:
            rows = []
            line0, ids_of = b.column("line0"), b.column("ids")
            cols = [b.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class",
                                                      "pos", "before", "rank0")]
            for i, (doc, start, n, crc, doc_tokens, c, pos, before, rank0) in enumerate(zip(*cols)):
                rank = rank0 + pos
                if rank < taken[c]:
                    v = taken_by[c]
                    first, base, m, place = v[np.searchsorted(v[:, 0], rank, side="right") - 1].tolist()
                    rows.append((doc, start, n, crc, doc_tokens, base + (rank - first) // m, place + (rank - first) % m,
                                 ids_of[i].as_py() if with_ids else None))
                    continue
                at = line0[i].as_py() + before
                cuts = {k * window for k in range(at // window + 1, (at + n - 1) // window + 1)}
                cuts |= {int(e) for e in tail if at < e < at + n}
                raw = ids_of[i].as_py()
                edges = [at, *sorted(cuts), at + n]
                for a, z in zip(edges, edges[1:]):
                    part = raw[4 * (a - at):4 * (z - at)]
                    seq = min(a // window, full) + (int(np.searchsorted(tail, a, side="right")) if a >= full * window else 0)
                    rows.append((doc, start + a - at, z - a, zlib.crc32(part), doc_tokens, sequences + seq, a,
                                 part if with_ids else None))
            got = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(x, k) for x, k in list(zip(got, kinds))[:len(columns)]], names=columns)

    kinds = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, place long"
    placed = pieces.join(near(where), ["part", "class"]).transform(small_batches).mapInArrow(assign, kinds + ", ids binary" * with_ids)
    # at most ``window`` pieces meet in a sequence
    w = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")) \
        .withColumn("length", F.col("length").cast("long")).drop("place")
