"""Corpus pipeline: five stages over ``documents``, each one an operator of ``shopfloor.llm``.

The quality classifier drops what it rejects, line deduplication removes
repeated passages (a document left without any line goes), near
deduplication keeps one document of each group, personal data is replaced
by marks, and the rest is packed into sequences.  Each stage takes all that
the one before kept; all but the last return the columns of ``documents``,
with ``n_chars`` as the text is now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import line_dedup, near_dedup, packing, pii, quality
from shopfloor.llm.common import table, written
from shopfloor.llm.queries import vocabulary_path


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.remove_repeated_lines(docs, drop_emptied=True, passage_words=line_dedup.PASSAGE_WORDS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs, width=5)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality", keep_quality), ("lines", drop_repeated_lines), ("near copies", drop_near_copies),
          ("personal data", redact), ("packing", pack)]

#: The classifier, the signatures and the tokenizer can't be written in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
