"""The pipeline against plain Python, stage by stage, and the SQL twins."""

import os
import re

import pytest
from corpus_rows import SCHEMA, rows
from test_operators import check_packing, lines_expected, near_expected, plain_spans

import corpus_pipeline as P
import __spark_entry__ as E
from oracle_harness import compare, duck
from shopfloor.llm import pii, quality
from shopfloor.llm.queries import vocabulary_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder with labelled documents and repeated passages."""
    path = str(tmp_path_factory.mktemp("tables"))
    bad = [(1000 + k, "junk!! " * 30 + str(k), None, None, 10) for k in range(40)]
    good = [(2000 + k, " ".join(f"{'abcdefgh'[(k * j) % 8]}ord{(k * 31 + j * j) % 997}" for j in range(60)) + ".", "en", "s", 10)
            for k in range(160)]
    spark.createDataFrame(rows() + bad + good, SCHEMA).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(i, int(i >= 2000), 0) for i, *_ in bad + good], "doc_id long, quality int, toxic int") \
        .write.parquet(path + "/labels.parquet")
    return path


def test_stages(spark, folder):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in P.STAGES][:2] == ["quality", "lines"] and len(P.STAGES) == 5
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    assert not kept & set(range(1000, 1040)) and set(range(2000, 2160)) <= kept
    model = quality.train(spark.read.parquet(folder + "/documents.parquet"), spark.read.parquet(folder + "/labels.parquet"))
    scores = quality.score(spark.createDataFrame(before, SCHEMA), model).where("score >= 0.3").count()
    assert scores == len(after)

    before, after = seen["near copies"]
    want, _ = near_expected([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5)
    assert {r.doc_id for r in after if r.doc_id is not None} == {i for i, root in want.items() if i == root}

    before, after = seen["personal data"]
    assert sorted((r.doc_id for r in after), key=repr) == sorted((r.doc_id for r in before), key=repr)
    spans = {r.doc_id: plain_spans(r.text or "") for r in before}
    for r in after:
        assert r.text is None or r.n_chars == len(r.text)
        assert r.text is None or not spans[r.doc_id] or any(f"[{k.upper()}]" in r.text for k in pii.KINDS)

    before, after = seen["packing"]
    check_packing(after, [(r.doc_id, r.text) for r in before], Tokenizer.from_file(vocabulary_path()), 4096)


def test_line_stage_drops_emptied_documents(spark, folder):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in P.drop_repeated_lines(spark, docs, folder).collect()), key=repr)
    assert got == sorted(((i, t) for i, n, gone, t in lines_expected() if gone == 0 or gone < n), key=repr)


def test_line_stage_drops_passages_of_one_and_two_lines(spark, folder):
    passage = lambda k, n: " ".join(f"p{k}w{i}" for i in range(n))
    one, x, y, short = passage(1, 51), passage(2, 20), passage(3, 31), passage(4, 50)
    texts = [one, f"a\n{one}\nb", f"c\n{x}\n{y}\nd", f"e\n{x}\n{y}\nf", f"{y}\ng\n{x}", one, f"h\n{short}\ni", f"j\n{short}\nk"]
    docs = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in P.drop_repeated_lines(spark, docs, folder).collect()}
    assert got == {0: one, 1: "a\nb", 2: texts[2], 3: "e\nf", 4: texts[4], 6: texts[6], 7: texts[7]}


def test_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not present")
@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if re.match(r"op\d+_|pipeline", n)])
def test_sql_twin(spark, name):
    problems, *_ = compare(spark, duck(SMALL), name, E.queries()[name], E.oracle_sql()[name], SMALL)
    assert not problems, problems
