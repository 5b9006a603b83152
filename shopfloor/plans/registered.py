"""Registered queries: one Spark job and one DuckDB oracle per operator.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame built on the driver's
test tables; ``ORACLE[name]`` is the same result in DuckDB SQL.  Output
columns carry the same names in both.  Money leaves as DOUBLE (exact
decimal sum, then one cast) and dates as ISO text, so both engines hand
over identical values to the comparison.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import testdata as td

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def checkable(df: DataFrame) -> DataFrame:
    """Decimals -> double, dates -> 'YYYY-MM-DD', small ints -> bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    """Decorator: register a query builder (and its oracle, if any)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return checkable(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def oracle(inner: str, doubles=(), texts=(), bigints=()) -> str:
    """Wrap an oracle query with the same output casts as ``checkable``."""
    rep = ([f"CAST({c} AS DOUBLE) AS {c}" for c in doubles]
           + [f"CAST({c} AS VARCHAR) AS {c}" for c in texts]
           + [f"CAST({c} AS BIGINT) AS {c}" for c in bigints])
    if not rep:
        return inner
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({inner}) AS q"


# Domain tables as CTE prefixes for the oracle queries.
SO = f"WITH so AS ({td.SALES_ORDERS_SQL})\n"
SOD = f"WITH so AS ({td.SALES_ORDERS_DIRTY_SQL})\n"
PROD = f"WITH products AS ({td.PRODUCTS_SQL})\n"
ITEMS = f"order_items AS ({td.ORDER_ITEMS_SQL})"
CO = f"customer_orders AS ({td.CUSTOMER_ORDERS_SQL})"
