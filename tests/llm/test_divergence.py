"""The audit of sources against plain Python, and perfect hashes against a dictionary."""

import collections
import random
import re

import numpy as np
import pytest
from corpus_rows import rows

from oracle_harness import compare, duck
from shopfloor.llm import divergence, perfect_hash, queries
from shopfloor.llm.runs import Powers

COLS = ["lang", "source", "part", "item", "value", "rank"]
SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall((text or "").translate(str.maketrans(divergence.UPPER, divergence.LOWER)))


def expected(data, min_docs, top):
    data = [(lang or "", source or "", terms_of(text)) for _, text, lang, source in data]
    in_docs, n = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, terms in data:
        in_docs[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in sorted({lang for lang, _ in n}):
        kept = [t for t, c in in_docs[lang].items() if c >= min_docs]
        of = {s: {t: n[lang, s][t] for t in kept} for x, s in n if x == lang}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}

        def share(counts):
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10 ** 9 * (c + 5) // total for t, c in counts.items()}
        p, q = {s: share(c) for s, c in of.items()}, share(whole)
        for s in of:
            pairs = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in of if x != s]
            terms = [(p[s][t] - q[t], t) for t in kept if of[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def fixture():
    rng = random.Random(12)
    words = ["The", "the", "naïve", "ÉTÉ", "Été", "x1y", "日本", "a", "b", "c_d", "zz", "long" * 40, "🙂", "q"]
    data = [(i, t, lang, source) for i, t, lang, source, _ in rows()]
    data += [(k, " ".join(rng.choices(words, [1 + (k % 3 == j % 3) * 4 for j in range(len(words))], k=rng.randint(0, 30))),
              rng.choice(["en", "fr", "", None, "a\x00b"]), rng.choice(["s1", "s2", "s3", None, "é"])) for k in range(100, 340)]
    data += [(7, "alone in its language the", "xx", "only"), (8, "12 34", "yy", "no"), (9, None, "yy", "terms"), (9, None, "yy", "terms")]
    return data + [data[-5]] * 3


def got(df):
    assert df.columns == COLS
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:               # many shards, portions, counters given out and blocks
        for name, value in (("SHARD_TERMS", 3), ("BROADCAST_BYTES", 700), ("TOKENS", 12), ("CELLS", 12)):
            monkeypatch.setattr(divergence, name, value)
    data = fixture()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    if small:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(1).alias(n) for n in ("slot", "block", "n", "v", "term", "shard", "total", "value", "rank", "item")])
    assert got(divergence.audit(df, min_docs=4, top=3)) == expected(data, 4, 3)


def test_nothing_is_kept_and_an_empty_table(spark):
    data = fixture()[:60]
    df = spark.createDataFrame(data, SCHEMA)
    assert got(divergence.audit(df, min_docs=1000, top=3)) == expected(data, 1000, 3)
    assert got(divergence.audit(df.limit(0))) == []


def test_shares_are_exact():
    rng = random.Random(1)
    total = [rng.randint(5, 9 * 10 ** 15) for _ in range(2000)]
    n = [rng.randint(0, t) for t in total]
    assert divergence.shares(np.array(n), np.array(total)).tolist() == [1 + 10 ** 9 * a // b for a, b in zip(n, total)]


def test_shares_in_sql(spark):
    df = spark.createDataFrame([(3, 7), (9 * 10 ** 15, 9 * 10 ** 15), (123456789012345, 8 * 10 ** 15), (0, 1)], "n long, total long")
    assert [r.p for r in df.selectExpr(f"{divergence._share('n', 'total')} AS p").collect()] == [
        1 + 10 ** 9 * r.n // r.total for r in df.collect()]


@pytest.mark.parametrize("levels", [1, 2, 24])
def test_perfect_hashes(monkeypatch, levels):
    monkeypatch.setattr(perfect_hash, "LEVELS", levels)
    rng, powers = random.Random(levels), Powers()
    keys = sorted({bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(1, 9))) for _ in range(700)})
    other = sorted({bytes(rng.choices(b"abcd", k=rng.randint(1, 9))) for _ in range(700)})
    shards = perfect_hash.Shards([perfect_hash.build(k, powers) for k in (keys[::2], [b"single"], keys[1::2])])
    asked = [(k, i % 2 * 2) for i, k in enumerate(keys)] + [(k, 0) for k in other] + [(b"single", 1), (b"singlf", 1)]
    data = np.frombuffer(b"".join(k for k, _ in asked), np.uint8)
    ends = np.cumsum([len(k) for k, _ in asked])
    starts = ends - [len(k) for k, _ in asked]
    a, b = perfect_hash.key_hashes(data, starts, ends, powers)
    slots = shards.lookup(data, starts, ends, a, b, np.array([s for _, s in asked]))
    assert sorted(slots[:len(keys)].tolist() + [slots[-2]]) == list(range(len(keys) + 1))       # minimal and perfect
    mine = set(keys[::2])
    for (k, s), slot in zip(asked, slots):
        known = k in mine if s == 0 else k == b"single" if s == 1 else k in keys
        assert (slot >= 0) == known and (not known or shards.key(slot) == k)


def test_oracle(spark):
    small = "/root/testdata/sf0.001"
    problems, n, *_ = compare(spark, duck(small), "op12_hash_recount", queries.op12_hash_recount, divergence.ORACLE_SQL, small)
    assert not problems and n > 0, problems
