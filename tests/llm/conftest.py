import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_rows import SCHEMA, rows  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named as the operators' own."""
    from pyspark.sql import functions as F
    names = ["score", "_stats", "rest", "key", "rep", "label", "labels", "slot", "shard", "size", "covered", "part", "_doc", "_gone",
             "_id", "added", "component_id", "kept", "n_shingles", "ids", "position", "text_key", "node", "root", "_keep"]
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
