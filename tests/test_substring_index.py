"""The substring index against ILIKE on every (term, row)."""

import random

from pyspark.sql import functions as F

from shopfloor.operators import substring_index as SI

TERMS = ["", "a", "ab", "abc", "ABC", "abcd", "bcabc", "%", "a%c", "_bc", "\\%", "éaé", "zzz", "cabcab", "aaa", None, "abc"]


def _plain(spark, df, terms):
    t = spark.createDataFrame([(x,) for x in set(terms) - {None}], "term string")
    hit = F.ilike("text", F.concat(F.lit("%"), "term", F.lit("%")))
    return sorted(tuple(r) for r in df.crossJoin(t).where(hit).select("term", "id").collect())


def test_search_equals_a_scan(spark, monkeypatch):
    monkeypatch.setattr(SI, "CHUNK", 7)
    monkeypatch.setattr(SI, "PORTION", 2)
    rng = random.Random(4)
    texts = [None, "", "a", "ab", "a%c", "İabc", "%%"] + ["".join(rng.choices(["a", "b", "c", "A", "é", "%", "abc"], k=rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    index = SI.build(df, "id", "text")
    assert index.agg(F.max(F.size("ids"))).first()[0] < 40 and index.groupBy("gram").count().agg(F.max("count")).first()[0] > 5
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    assert sorted(tuple(r) for r in SI.search(df, index, terms, "id", "text").collect()) == _plain(spark, df, TERMS)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, text string")
    some = spark.createDataFrame([(1, "abcd")], "id long, text string")
    terms = spark.createDataFrame([("bcd",), ("",)], "term string")
    assert SI.search(none, SI.build(none, "id", "text"), terms, "id", "text").count() == 0
    assert SI.search(some, SI.build(some, "id", "text"), terms.limit(0), "id", "text").count() == 0
    assert sorted(r.term for r in SI.search(some, SI.build(some, "id", "text"), terms, "id", "text").collect()) == ["", "bcd"]


def test_rows_meet_a_trigram_once_for_all_its_terms(spark, monkeypatch):
    """Terms of one trigram go along with its rows, rows of one key are told apart by their text."""
    monkeypatch.setattr(SI, "TERMS", 5)
    df = spark.createDataFrame([(i // 2, f"abc{i:03d}") for i in range(400)], "id long, text string")
    names = [f"abc{i:03d}"[:n] for i in range(40) for n in (5, 6)]
    index = SI.build(df, "id", "text")
    found = SI.search(df, index, spark.createDataFrame([(n,) for n in names], "term string"), "id", "text")
    assert sorted(tuple(r) for r in found.collect()) == _plain(spark, df, names)
