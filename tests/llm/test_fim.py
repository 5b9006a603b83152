"""Fill-in-the-middle against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from corpus_rows import rows
from pyspark.sql import functions as F

from shopfloor.llm import fim, queries
from shopfloor.llm.bitvector import Bits, WaveletMatrix

COLS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
MARKS = "<P>", "<S>", "<M>"


def pieces(text, units):
    if units == "chars":
        return list(text)
    if units == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    space = "\x20\x09-\x0D"
    return ([text] if text else []) if not text.strip(" \t\n\x0b\x0c\r") else re.findall(rf"^[{space}]*[^{space}]+[{space}]*|[^{space}]+[{space}]*", text)


def expected(doc_id, text, units="chars"):
    text = text or ""
    parts = pieces(text, units)
    n = len(parts)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def got(df, cols=COLS):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_ranks_and_selection_against_counting():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        flags = rng.random(n) < 0.4
        at = np.arange(n + 1)
        assert Bits.of(flags).rank(at).tolist() == [int(flags[:i].sum()) for i in at]
        symbols = rng.integers(0, 5, n).astype(np.uint8)
        matrix = WaveletMatrix(symbols, 3)
        for s in range(5):
            assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]
        both = np.isin(symbols, (1, 4))
        for k in range(int(both.sum()) + 2):
            first = next((i for i in at if both[:i].sum() >= k), n)
            assert matrix.select((1, 4), np.array([k]), np.array([0]), np.array([n])).tolist() == [first]


@pytest.mark.parametrize("units", ["chars", "words", "lines"])
def test_transform(docs, clashing, empty, units):
    want = sorted((expected(i, t, units) for i, t, *_ in rows()), key=repr)
    for df in (docs, clashing):
        assert got(fim.transform(df, units)) == want
    assert fim.transform(empty, units).columns == COLS and fim.transform(empty, units).count() == 0


def test_forms_marks_and_the_way_back(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["<", ">", "P", "S", "M", "<P>", "é", "日", "🙂", " ", "\n", "ab"]) for _ in range(rng.randint(0, 30)))
             for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = fim.transform(df)
    assert got(out) == sorted((expected(i, t) for i, t in enumerate(texts)), key=repr)
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = {r.doc_id: r.t for r in out.select("doc_id", fim.restored().alias("t")).collect()}
    assert back == dict(enumerate(texts))


def test_a_very_long_text_and_a_hot_one(spark):
    long = "é1 <日\n" * 400_000
    df = spark.createDataFrame([(3, long)] + [(k, "a tail") for k in range(10, 400)], "doc_id long, text string").coalesce(1)
    rows_ = got(fim.transform(df))
    assert rows_ == sorted((expected(i, t) for i, t in [(3, long)] + [(k, "a tail") for k in range(10, 400)]), key=repr)


def test_unknown_units_are_refused(docs):
    with pytest.raises(ValueError):
        fim.transform(docs, "tokens")


def test_registered_query_has_digests(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((*expected(i, t)[:5], sha(expected(i, t)[5]), sha(t or "")) for i, t, *_ in rows()), key=repr)
    assert got(queries.op11_wavelet_fim(spark, str(tmp_path)), COLS[:5] + ["output_sha256", "restored_sha256"]) == want
