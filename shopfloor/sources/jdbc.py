"""Database sources and sinks (S2, S3) through Spark's JDBC data source.

The reference sent SQL text to one PostgreSQL connection per query.  Here
a table or query is read in parallel slices of a numeric column, and a
DataFrame is written with one connection per partition in batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def jdbc_read_options(url: str, table: str | None = None, query: str | None = None,
                      partition_column: str | None = None, lower: int | None = None,
                      upper: int | None = None, num_partitions: int | None = None,
                      fetchsize: int = 10000, **extra) -> dict:
    """Options for ``spark.read.format("jdbc")``; a ``partition_column``
    with bounds splits the read into ``num_partitions`` range queries."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table / query")
    opts = {"url": url, "fetchsize": str(fetchsize)}
    opts["dbtable" if table else "query"] = table or query
    if partition_column:
        if table is None:
            raise ValueError("partitioned reads need dbtable (Spark restriction)")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(num_partitions or 1))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, url: str, **kw) -> DataFrame:
    """A database table or query as a DataFrame (filters and column
    selection applied later are pushed into the generated SQL)."""
    return spark.read.format("jdbc").options(**jdbc_read_options(url, **kw)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batchsize: int = 1000,
               isolation: str = "READ_COMMITTED", **extra) -> int:
    """S3: write with ``batchsize`` rows per round trip (the reference's
    1,000-row commits); returns the number of rows written, counted by an
    ``Observation`` during the write itself (no second pass)."""
    obs = Observation("jdbc_write")
    counted = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    (counted.write.format("jdbc").mode(mode)
     .options(url=url, dbtable=table, batchsize=str(batchsize), isolationLevel=isolation,
              **{k: str(v) for k, v in extra.items()})
     .save())
    return int(obs.get["rows"])


def query(spark: SparkSession, sql: str, **params) -> DataFrame:
    """S2 named parameters: ``spark.sql`` with bound ``:name`` arguments
    (values are never spliced into the text)."""
    return spark.sql(sql, args=params)
