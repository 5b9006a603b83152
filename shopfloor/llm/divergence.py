"""Audit of how far the sources of a language differ in their words (operator 12).

First pass: the terms that at least ``MIN_DOCS`` documents of a language hold
are counted exactly.  They are built into minimal perfect hashes in shards
(one row a shard, made by the tasks), which are broadcast.  Second pass: each
task finds its terms' slots, compares the stored keys, and counts them in a
dense row of slots for each (language, source); the counts are summed.  The
kept terms go round in portions of at most ``BROADCAST_BYTES``, each with a
pass of its own, so neither the driver nor a task ever holds more of them,
however many there are.

Differences of all pairs of sources come from dense blocks of slots: a block
holds all sources of a language and at most ``CELLS`` counts.

Defined results: null text, language and source count as ''; terms are runs
of letters (A-Z lower-cased) and of characters beyond ASCII; rows count each
on its own, whatever their ids; a language without kept terms has pairs of
value 0 and no terms; groups without terms take part; equal values are
ordered by the item's UTF-8 bytes; a source alone in its language has no
pair; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import process_cache, slices, small_batches, utf8_of, written
from .perfect_hash import Shards, build, key_hashes
from .runs import Powers

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
SHARD_TERMS = 1 << 12           # terms of a shard, about
SHARD_BYTES = 1 << 20           # bytes of its keys, about (a longer key alone)
BROADCAST_BYTES = 32 << 20      # of shards broadcast at once (one shard, if that is larger)
TOKENS = 1 << 22                # occurrences a task holds before it gives out their counts (more, if a slice of texts has more)
CELLS = 1 << 20                 # counts of a block for the pairs
BLOCK_SLOTS = 4096              # slots of a block at most

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20

SHARD = "lang string, shard int, n_sources long, n_terms long, n_rest int, sizes array<int>, bits binary, lengths binary, keys binary"
COUNTS = "lang string, block long, slot long, source string, n long"


def columns_of(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` documents of the language."""
    found = F.expr(r"split(text, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', -1)")
    lowered = F.transform(found, lambda t: F.when(t.rlike("[A-Z]"), F.translate(t, UPPER, LOWER)).otherwise(t))
    return (docs.select("lang", F.explode(F.array_distinct(lowered)).alias("term")).where("term <> ''")
            .groupBy("lang", "term").count().where(F.col("count") >= min_docs).select("lang", "term"))


def terms_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and where the terms of texts side by side begin and end."""
    letter = _LETTER[data]
    new = np.zeros(len(data) + 1, bool)
    new[bounds] = True
    joined = letter[1:] & letter[:-1] & ~new[1:-1]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    return _LOWERED[data], np.flatnonzero(first), np.flatnonzero(last) + 1


def _powers() -> Powers:
    return process_cache("powers", Powers)


def _to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, bounds = utf8_of(b.column("term"))
        a, _ = key_hashes(data, bounds[:-1], bounds[1:], _powers())
        shard = a % b.column("n_shards").to_numpy().astype(np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("n_sources"), pa.array(shard.astype(np.int32)), b.column("term")],
                                         names=["lang", "n_sources", "shard", "term"])


def _build_shard(key, frame):
    import pandas as pd
    made = build(sorted(t.encode() for t in frame["term"]), _powers())
    return pd.DataFrame([{"lang": key[0], "shard": key[1], "n_sources": int(frame["n_sources"].iloc[0]), "n_terms": len(frame), **made}])


def hashes_of(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each shard of the kept terms."""
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).join(sources, "lang").select(
        "lang", "n_sources", F.greatest(F.ceil(F.col("n") / SHARD_TERMS), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("long").alias("n_shards"))
    dealt = kept.join(langs, "lang").mapInArrow(_to_shard, "lang string, n_sources long, shard int, term string")
    return dealt.groupBy("lang", "shard").applyInPandas(_build_shard, SHARD)


def _block_slots(n_sources: int) -> int:
    return max(1, min(BLOCK_SLOTS, CELLS // n_sources))


class _Vocabulary:
    """The broadcast shards: which belong to a language, and their slots in it."""

    def __init__(self, shards: list[dict]):
        self.hashes = Shards(shards)
        self.langs = {}                 # language: (number of its first shard here, their numbers in the language, all its shards)
        for i, s in enumerate(shards):
            self.langs.setdefault(s["lang"], []).append((i, s))
        self.here = {lang: np.full(own[0][1]["n_shards"], -1, np.int64) for lang, own in self.langs.items()}
        self.slot_in_lang = self.hashes.first_slot.copy()       # of a shard's first slot
        for lang, own in self.langs.items():
            for i, s in own:
                self.here[lang][s["shard"]] = i
                self.slot_in_lang[i] = s["first"]
        self.low = {lang: int(self.hashes.first_slot[own[0][0]]) for lang, own in self.langs.items()}
        self.size = {lang: sum(s["n_terms"] for _, s in own) for lang, own in self.langs.items()}
        self.block = {lang: _block_slots(own[0][1]["n_sources"]) for lang, own in self.langs.items()}

    def slots(self, data, starts, ends, langs: np.ndarray, names: list[str]) -> np.ndarray:
        """The slot of each term, among all slots here; -1 for terms not kept or of another portion."""
        a, b = key_hashes(data, starts, ends, _powers())
        shard = np.full(len(starts), -1, np.int64)
        for k, name in enumerate(names):
            if name in self.here:
                mine = np.flatnonzero(langs == k)
                shard[mine] = self.here[name][(a[mine] % np.uint64(len(self.here[name]))).astype(np.int64)]
        known = np.flatnonzero(shard >= 0)
        out = np.full(len(starts), -1, np.int64)
        out[known] = self.hashes.lookup(data, starts[known], ends[known], a[known], b[known], shard[known])
        return out


class _Counters:
    """Slots met by each (language, source), counted in a dense row at a time.

    Groups come in any order, and their dense rows together may be larger than
    memory.  So slots are kept as they come, up to ``TOKENS``, then dealt by
    group, and one dense row of slots serves all groups in turn.
    """

    def __init__(self, vocabulary: _Vocabulary):
        self.v, self.groups, self.parts, self.n = vocabulary, {}, [], 0
        self.dense = np.zeros(max([0, *vocabulary.size.values()]), np.int64)

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, group: np.ndarray, slots: np.ndarray) -> None:
        self.parts.append((group.astype(np.int32), slots.astype(np.int32)))
        self.n += len(slots)

    def given_out(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        group, slots = (np.concatenate(x) for x in zip(*self.parts))
        slots = slots[np.argsort(group, kind="stable")]
        ends = np.cumsum(np.bincount(group, minlength=len(self.groups)))
        for (lang, source), low, high in zip(self.groups, [0, *ends[:-1]], ends):
            own = slots[low:high]
            if not len(own):
                continue
            np.add.at(self.dense, own, 1)
            found = np.flatnonzero(self.dense[:self.v.size[lang]]) if len(own) * 8 > self.v.size[lang] else np.unique(own).astype(np.int64)
            counts = self.dense[found]
            self.dense[found] = 0
            here = found + self.v.low[lang]
            shard = np.searchsorted(self.v.hashes.first_slot, here, side="right") - 1
            slot = here - self.v.hashes.first_slot[shard] + self.v.slot_in_lang[shard]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found)), pa.array(slot // self.v.block[lang]), pa.array(slot), pa.array([source] * len(found)),
                 pa.array(counts)], names=["lang", "block", "slot", "source", "n"])
        self.groups, self.parts, self.n = {}, [], 0


def _count_task(shards, name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = process_cache("divergence", dict)       # of the latest portion alone
        if name not in kept:
            kept.clear()
            kept[name] = _Vocabulary(shards.value)
        vocabulary = kept[name]
        counters = _Counters(vocabulary)
        for part in slices(batches):
            langs, sources = part.column("lang").dictionary_encode(), part.column("source").to_pylist()
            names, lang_of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            data, bounds = utf8_of(part.column("text"))
            data, starts, ends = terms_in(data, bounds)
            doc = np.searchsorted(bounds, starts, side="right") - 1
            slots = vocabulary.slots(data, starts, ends, lang_of[doc], names)
            found = slots >= 0
            slots, doc = slots[found], doc[found]
            low = np.array([vocabulary.low.get(n, 0) for n in names] or [0], np.int64)[lang_of]
            group = np.array([counters.group(names[k], s) for k, s in zip(lang_of, sources)], np.int64)
            counters.add(group[doc], slots - low[doc])
            if counters.n >= TOKENS:
                yield from counters.given_out()
        yield from counters.given_out()
    return count


def _portions(shards: list) -> Iterator[list]:
    """Shards in order, together at most ``BROADCAST_BYTES`` (or one)."""
    portion, size = [], 0
    for s in shards:
        if portion and size + s["size"] > BROADCAST_BYTES:
            yield portion
            portion, size = [], 0
        portion.append(s)
        size += s["size"]
    if portion:
        yield portion


def recount(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(lang, block, slot, source, n): how often each kept term occurs in each group, zeros left out."""
    spark = docs.sparkSession
    # sizes only: a row for each 4,096 kept terms
    sizes = [r.asDict() for r in shards.select("lang", "shard", "n_terms", F.expr(
        "octet_length(bits) + octet_length(lengths) + octet_length(keys) + 8 * size(sizes) + 100").alias("size")).orderBy("lang", "shard").collect()]
    first, total = {}, {}
    for s in sizes:
        total[s["lang"]] = total.get(s["lang"], 0) + 1
        s["first"] = first.get(s["lang"], 0)
        first[s["lang"]] = s["first"] + s["n_terms"]
    passes = []
    for portion in _portions(sizes):
        wanted = spark.createDataFrame([(s["lang"], s["shard"], s["first"], total[s["lang"]]) for s in portion],
                                       "lang string, shard int, first long, n_shards int")
        rows = [r.asDict() for r in shards.join(F.broadcast(wanted), ["lang", "shard"]).orderBy("lang", "shard").collect()]
        shared = spark.sparkContext.broadcast(rows)
        passes.append(written(small_batches(docs).mapInArrow(_count_task(shared, uuid.uuid4().hex), COUNTS)
                              .groupBy("lang", "block", "slot", "source").agg(F.sum("n").alias("n")), "recount"))
        shared.destroy()
    out = passes[0] if passes else spark.createDataFrame([], COUNTS)
    for p in passes[1:]:
        out = out.unionByName(p)
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            lengths = np.frombuffer(r["lengths"], "<i4").astype(np.int64)
            bounds = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(lengths, out=bounds[1:])
            terms = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(bounds), pa.py_buffer(r["keys"]))
            slots = np.arange(len(lengths)) + r["first"]
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(lengths)), pa.array(slots), terms], names=["lang", "slot", "term"])


def slot_terms(shards: DataFrame) -> DataFrame:
    """(lang, slot, term): the stored keys."""
    # a row a shard, so the window runs over few rows
    before = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_terms").over(before), F.lit(0)).alias("first")
    at = shards.select("lang", "shard", "n_terms").select("lang", "shard", first)
    return shards.select("lang", "shard", "lengths", "keys").join(at, ["lang", "shard"]).mapInArrow(_terms, "lang string, slot long, term string")


def _share(n: str, total: str) -> str:
    """SQL: 1 + floor(SCALE * n / total) for 0 <= n <= total, three digits at a time, so nothing overflows below 9e15."""
    one = f"({n} * 1000 div {total})", f"({n} * 1000 % {total})"
    two = f"({one[1]} * 1000 div {total})", f"({one[1]} * 1000 % {total})"
    return f"(1 + {one[0]} * 1000000 + {two[0]} * 1000 + {two[1]} * 1000 div {total})"


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = 0, n
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def _pairs_of_block(key, frame):
    import pandas as pd
    marks = frame[frame["slot"] < 0].sort_values("source")
    sources, total = marks["source"].to_numpy(), marks["n"].to_numpy()[:, None]
    width = int(marks["width"].iloc[0])
    counts = np.zeros((len(sources), width), np.int64)
    cells = frame[frame["slot"] >= 0]
    of = {s: i for i, s in enumerate(sources)}
    counts[cells["source"].map(of).to_numpy(np.int64), cells["slot"].to_numpy(np.int64) - int(marks["first"].iloc[0])] = cells["n"].to_numpy()
    p = shares(counts + SMOOTHING, total)
    out = [(np.full(len(sources) - i - 1, i), np.arange(i + 1, len(sources)), np.abs(p[i + 1:] - p[i]).sum(axis=1)) for i in range(len(sources))]
    a, b, value = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"lang": key[0], "source": sources[a], "item": sources[b], "value": value})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources and each group's most overused terms."""
    docs = columns_of(docs)
    groups = written(docs.groupBy("lang", "source").count().select("lang", "source"), "groups")
    kept = written(kept_terms(docs, min_docs), "kept")
    shards = written(hashes_of(kept, groups), "shards")
    counts = recount(docs, shards)
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(
        shards.groupBy("lang").agg(F.sum("n_terms").alias("v")), "lang", "left").select("lang", "n_sources", F.coalesce("v", F.lit(0)).alias("v"))
    whole = sums.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    # one row a group: total N + 5 V of the group and of its language
    totals = written(groups.join(sums, ["lang", "source"], "left").join(langs, "lang").join(whole, "lang", "left").select(
        "lang", "source", "v", "n_sources", (F.coalesce("n", F.lit(0)) + SMOOTHING * F.col("v")).alias("total"),
        (F.coalesce("n_lang", F.lit(0)) + SMOOTHING * F.col("v")).alias("total_lang")), "totals")
    pair = _pairs(counts, totals)
    term = _overused(counts, totals, shards, top)
    return pair.unionByName(term)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"),
                       F.row_number().over(w).alias("rank"))


def _pairs(counts: DataFrame, totals: DataFrame) -> DataFrame:
    width = f"greatest(1, least({BLOCK_SLOTS}, {CELLS} div n_sources))"
    # a mark for each group and block of its language, with the group's total
    marks = totals.where("v > 0").select("lang", "source", "total", "v", F.expr(width).alias("w")).select(
        "lang", "source", "total", "v", "w", F.explode(F.expr("sequence(0L, (v - 1) div w)")).alias("block")).select(
        "lang", "block", F.lit(-1).cast("long").alias("slot"), "source", F.col("total").alias("n"),
        F.expr("block * w").alias("first"), F.expr("least(w, v - block * w)").alias("width"))
    cells = counts.select("lang", "block", "slot", "source", "n", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("width"))
    sums = cells.unionByName(marks).groupBy("lang", "block").applyInPandas(
        _pairs_of_block, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = totals.where("v = 0").select("lang", "source")
    zero = none.join(none.withColumnRenamed("source", "item"), "lang").where("source < item").withColumn("value", F.lit(0).cast("long"))
    half = sums.unionByName(zero)
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return _ranked(half.select("lang", "value", both.alias("p")).select("lang", "p.source", "p.item", "value"), "pair")


def _overused(counts: DataFrame, totals: DataFrame, shards: DataFrame, top: int) -> DataFrame:
    here = Window.partitionBy("lang", "slot")                   # at most a row for each source
    rows = counts.select("lang", "slot", "source", "n", F.sum("n").over(here).alias("n_lang")).join(totals, ["lang", "source"])
    rows = rows.select("lang", "slot", "source", F.expr(
        f"{_share(f'(n + {SMOOTHING})', 'total')} - {_share(f'(n_lang + {SMOOTHING})', 'total_lang')}").alias("value")).where("value > 0")
    # the first ``top`` values with their ties, then the terms decide among equal values
    most = rows.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc()))).where(F.col("r") <= top)
    named = most.join(slot_terms(shards), ["lang", "slot"]).select("lang", "source", F.col("term").alias("item"), "value")
    return _ranked(named, "term").where(F.col("rank") <= top)


ORACLE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
k AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(ts)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 30),
o AS (SELECT lang, source, t, count(*) AS c FROM (SELECT lang, source, unnest(ts) AS t FROM d) GROUP BY lang, source, t),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.t, coalesce(o.c, 0) AS c FROM g JOIN k ON k.lang = g.lang
      LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t),
n AS (SELECT lang, source, sum(c) AS n FROM f GROUP BY lang, source),
p AS (SELECT f.lang, f.source, f.t, f.c, 1 + (CAST(1000000000 AS HUGEINT) * (f.c + 5)) // (n.n + 5 * v.v) AS p
      FROM f JOIN n ON n.lang = f.lang AND n.source = f.source JOIN v ON v.lang = f.lang),
l AS (SELECT f.lang, f.t, 1 + (CAST(1000000000 AS HUGEINT) * (sum(f.c) + 5)) // (m.n + 5 * v.v) AS q
      FROM f JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY lang) m ON m.lang = f.lang JOIN v ON v.lang = f.lang
      GROUP BY f.lang, f.t, m.n, v.v),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.t = a.t AND b.source <> a.source
      GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.t, CAST(p.p - l.q AS BIGINT) FROM p JOIN l ON l.lang = p.lang AND l.t = p.t WHERE p.c > 0 AND p.p > l.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM r
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 50
"""
