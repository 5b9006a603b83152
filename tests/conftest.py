import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from domain_rows import ORDERS_SMALL, D, day, product_rows  # noqa: E402
from shopfloor import schemas as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("shopfloor-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shopfloor-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="shopfloor-test-")


@pytest.fixture
def orders_small(spark):
    rows = [(i, st, c, day(d), q, D(s), D(t), D(sh), cat, sub)
            for i, st, c, d, q, s, t, sh, cat, sub in ORDERS_SMALL]
    return spark.createDataFrame(rows, S.ORDERS)


@pytest.fixture
def products_seed(spark):
    return spark.createDataFrame(product_rows(), S.PRODUCTS)
