"""Order analytics and BI extracts.

Aggregates run as partial + final hash aggregation, so a hot status or
category costs one partial row per input partition.  Money is summed as
decimal (exact); averages divide the exact sum by the count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contains_ci, date_parts

REVENUE = "subtotal_amount"


def _revenue_sum(c: str = REVENUE) -> Column:
    return F.sum(c).cast("decimal(38,2)")


def _mean(c: str = REVENUE) -> Column:
    # exact sum / count; NULL when the group has no non-null values
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


# -- filters and projections -------------------------------------------------

def orders_by_status(orders: DataFrame, status: str, sort: bool = True) -> DataFrame:
    """Rows of one status (sorted by id when ``sort``)."""
    out = orders.filter(F.col("status") == status)
    return out.orderBy("order_id") if sort else out


def filter_orders(orders: DataFrame, **equals) -> DataFrame:
    """Conjunction of the optional equality filters that are set."""
    preds = [F.col(k) == v for k, v in equals.items() if v not in (None, "")]
    return orders.filter(reduce(lambda a, b: a & b, preds)) if preds else orders


def bi_extract(orders: DataFrame) -> DataFrame:
    """The 13-column BI extract with year, month and quarter."""
    return orders.select("order_id", "status", "customer_name", "order_date", "quantity",
                         "subtotal_amount", "tax_rate", "shipping_cost", "category",
                         "subcategory", *date_parts("order_date"))


def search_orders(orders: DataFrame, status: str | None = None, customer_name: str | None = None,
                  category: str | None = None, limit: int = 50, escape: bool = False) -> DataFrame:
    """P4 + L3: status =, customer ILIKE %x%, category =; newest ``limit`` by id.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition
    keeps its top ``limit`` rows, only those reach the final task.
    """
    out = filter_orders(orders, status=status, category=category)
    if customer_name is not None:
        out = out.filter(contains_ci("customer_name", customer_name, escape=escape))
    return out.orderBy(F.col("order_id").desc()).limit(limit)


def page(orders: DataFrame, page_no: int = 1, per_page: int = 50,
         status: str | None = None, category: str | None = None) -> DataFrame:
    """L1: ``ORDER BY order_id DESC LIMIT per_page OFFSET (page-1)*per_page``."""
    out = filter_orders(orders, status=status, category=category)
    return out.orderBy(F.col("order_id").desc()).offset((page_no - 1) * per_page).limit(per_page)


def page_after(orders: DataFrame, last_id: int | None, per_page: int = 50) -> DataFrame:
    """L1 keyset variant for deep pages: ids below the last one seen."""
    out = orders if last_id is None else orders.filter(F.col("order_id") < last_id)
    return out.orderBy(F.col("order_id").desc()).limit(per_page)


def customer_orders_page(orders: DataFrame, limit: int = 100, offset: int = 0,
                         date_col: str = "order_date", id_col: str = "customer_order_id") -> DataFrame:
    """L2: customer orders newest first (id breaks ties), LIMIT/OFFSET."""
    return orders.orderBy(F.col(date_col).desc(), F.col(id_col).desc()).offset(offset).limit(limit)


def page_info(orders: DataFrame, per_page: int = 50, **equals) -> DataFrame:
    """L1 header: total rows and page count for the filtered listing."""
    return (filter_orders(orders, **equals)
            .agg(F.count(F.lit(1)).alias("total"))
            .withColumn("per_page", F.lit(per_page).cast("bigint"))
            .withColumn("total_pages", F.expr(f"(total + {per_page} - 1) div {per_page}")))


# -- aggregates ---------------------------------------------------------------

def order_count(orders: DataFrame) -> DataFrame:
    """A1."""
    return orders.agg(F.count(F.lit(1)).alias("total_orders"))


def orders_by_status_count(orders: DataFrame) -> DataFrame:
    """A2: orders per status."""
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("order_count"))


def category_revenue(orders: DataFrame) -> DataFrame:
    """A3: orders and revenue per category, revenue desc (NULL first, as PostgreSQL)."""
    return (orders.groupBy("category")
            .agg(F.count(F.lit(1)).alias("order_count"), _revenue_sum().alias("total_amount"))
            .orderBy(F.col("total_amount").desc_nulls_first(), "category"))


def yearly_revenue(orders: DataFrame) -> DataFrame:
    """A4: orders and revenue per calendar year."""
    return (orders.groupBy(F.year("order_date").cast("bigint").alias("year"))
            .agg(F.count(F.lit(1)).alias("order_count"), _revenue_sum().alias("total_amount"))
            .orderBy("year"))


def category_summary(orders: DataFrame) -> DataFrame:
    """A5: count, revenue, mean order value, units per category."""
    return (orders.groupBy("category")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 _revenue_sum().alias("total_revenue"),
                 _mean().alias("avg_order_value"),
                 F.sum("quantity").cast("bigint").alias("total_quantity"))
            .orderBy(F.col("total_revenue").desc_nulls_first(), "category"))


def yearly_summary(orders: DataFrame) -> DataFrame:
    """Count, revenue, mean per year."""
    return (orders.groupBy(F.year("order_date").cast("bigint").alias("year"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 _revenue_sum().alias("total_revenue"),
                 _mean().alias("avg_order_value"))
            .orderBy("year"))


def status_summary(orders: DataFrame) -> DataFrame:
    """Count and revenue per status, count desc."""
    return (orders.groupBy("status")
            .agg(F.count(F.lit(1)).alias("order_count"), _revenue_sum().alias("total_revenue"))
            .orderBy(F.col("order_count").desc(), "status"))


def bi_summary(orders: DataFrame) -> DataFrame:
    """The three summaries of the BI endpoint from ONE scan.

    ``GROUPING SETS ((category), (year), (status))`` expands each row three
    times before the partial aggregate (Expand node), so the table is read
    once instead of three times.  ``dimension`` tells the sets apart.
    """
    o = orders.select("category", "status", F.year("order_date").cast("bigint").alias("year"),
                      "subtotal_amount", "quantity")
    gid = F.grouping_id("category", "year", "status")
    return (o.groupingSets([["category"], ["year"], ["status"]], "category", "year", "status")
            .agg(F.count(F.lit(1)).alias("order_count"),
                 _revenue_sum().alias("total_revenue"),
                 _mean().alias("avg_order_value"),
                 F.sum("quantity").cast("bigint").alias("total_quantity"),
                 gid.alias("_gid"))
            .select(F.when(F.col("_gid") == 3, "category").when(F.col("_gid") == 5, "year")
                     .otherwise("status").alias("dimension"),
                    "category", "year", "status", "order_count", "total_revenue",
                    "avg_order_value", "total_quantity"))


def table_stats(orders: DataFrame, approx: bool = False) -> DataFrame:
    """Migration report statistics in one aggregate.

    Exact distinct counts shuffle each distinct value once; ``approx=True``
    uses HyperLogLog++ sketches (no value shuffle) for very large tables.
    """
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return orders.agg(
        F.count(F.lit(1)).alias("total_records"),
        cd("status").cast("bigint").alias("unique_statuses"),
        cd("customer_name").cast("bigint").alias("unique_customers"),
        cd("category").cast("bigint").alias("unique_categories"),
        F.min("order_date").alias("earliest_order"),
        F.max("order_date").alias("latest_order"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        _revenue_sum().alias("total_revenue"))


def measures(orders: DataFrame) -> DataFrame:
    """Total revenue, average order value (safe divide), order count."""
    return orders.agg(_revenue_sum().alias("total_revenue"),
                      F.try_divide(F.sum(REVENUE).cast("double"), F.count(F.lit(1)))
                       .alias("average_order_value"),
                      F.count(F.lit(1)).alias("orders_count"))


def top_customers(orders: DataFrame, k: int = 10) -> DataFrame:
    """Customer ranking by revenue, top ``k`` (name breaks ties)."""
    return (orders.groupBy("customer_name")
            .agg(_revenue_sum().alias("total_revenue"), F.count(F.lit(1)).alias("order_count"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), F.col("customer_name").asc_nulls_last())
            .limit(k))


def category_ranking(orders: DataFrame) -> DataFrame:
    """Ordinal of categories by revenue, numbered after aggregation.

    The window has no partition key, but it runs over the aggregated
    result (one row per category), never over the orders themselves.
    """
    agg = orders.groupBy("category").agg(_revenue_sum().alias("total_revenue"))
    w = Window.orderBy(F.col("total_revenue").desc_nulls_first(), F.col("category").asc_nulls_first())
    return agg.withColumn("rank", F.row_number().over(w).cast("bigint"))


def revenue_growth(orders: DataFrame) -> DataFrame:
    """Growth against the exact previous calendar year.

    ``rangeBetween(-1, -1)`` on the year finds the year before; a gap in
    the years gives NULL (unlike ``lag``).  The window runs on the yearly
    aggregate, a handful of rows.
    """
    yearly = (orders.groupBy(F.year("order_date").cast("bigint").alias("year"))
              .agg(_revenue_sum().alias("revenue")))
    w = Window.orderBy("year").rangeBetween(-1, -1)
    prev = F.sum("revenue").over(w)
    return (yearly.withColumn("previous_revenue", prev)
            .withColumn("growth", F.try_divide((F.col("revenue") - F.col("previous_revenue")).cast("double"),
                                               F.col("previous_revenue").cast("double")))
            .orderBy("year"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Counts per non-NULL value, most frequent first (value breaks ties)."""
    out = (df.filter(F.col(column).isNotNull()).groupBy(column)
           .agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.col("count").desc(), F.col(column)))
    return out.limit(k) if k else out
