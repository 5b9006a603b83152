"""Registered analytics queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import substring_index as SI
from ..session import checkpoint_dir, scratch_path
from ..sources import testdata as td
from ..sources.rank_directory import RankDirectory
from .registered import SO, oracle, register

ORDER_OUT = ("order_id, status, customer_name, order_date, quantity, subtotal_amount, "
             "tax_rate, shipping_cost, category, subcategory")
MONEY_COLS = ("subtotal_amount", "tax_rate", "shipping_cost")


@register("sales_orders", oracle(SO + "SELECT * FROM so", doubles=MONEY_COLS,
                                 texts=("order_date",), bigints=("quantity",)))
def q_sales_orders(spark, d):
    """S1 on the test data: the full ``orders`` table (adapter)."""
    return td.sales_orders(spark, d)


@register("a5_category_summary", oracle(SO + """
SELECT category, COUNT(*) AS order_count, CAST(SUM(subtotal_amount) AS DECIMAL(38,2)) AS total_revenue,
       CAST(SUM(subtotal_amount) AS DOUBLE) / COUNT(subtotal_amount) AS avg_order_value,
       CAST(SUM(quantity) AS BIGINT) AS total_quantity
FROM so GROUP BY category""", doubles=("total_revenue",)))
def q_a5(spark, d):
    return an.category_summary(td.sales_orders(spark, d))


@register("a1_order_count", SO + "SELECT COUNT(*) AS total_orders FROM so")
def q_a1(spark, d):
    return an.order_count(td.sales_orders(spark, d))


@register("a2_orders_by_status", SO + "SELECT status, COUNT(*) AS order_count FROM so GROUP BY status")
def q_a2(spark, d):
    return an.orders_by_status_count(td.sales_orders(spark, d))


@register("a3_category_revenue", oracle(SO + """
SELECT category, COUNT(*) AS order_count, SUM(subtotal_amount) AS total_amount
FROM so GROUP BY category""", doubles=("total_amount",)))
def q_a3(spark, d):
    return an.category_revenue(td.sales_orders(spark, d))


@register("a4_yearly_revenue", oracle(SO + """
SELECT CAST(year(order_date) AS BIGINT) AS year, COUNT(*) AS order_count,
       SUM(subtotal_amount) AS total_amount
FROM so GROUP BY 1""", doubles=("total_amount",)))
def q_a4(spark, d):
    return an.yearly_revenue(td.sales_orders(spark, d))


@register("a6_yearly_summary", oracle(SO + """
SELECT CAST(year(order_date) AS BIGINT) AS year, COUNT(*) AS order_count,
       SUM(subtotal_amount) AS total_revenue,
       CAST(SUM(subtotal_amount) AS DOUBLE) / COUNT(subtotal_amount) AS avg_order_value
FROM so GROUP BY 1""", doubles=("total_revenue",)))
def q_a6(spark, d):
    return an.yearly_summary(td.sales_orders(spark, d))


@register("a7_status_summary", oracle(SO + """
SELECT status, COUNT(*) AS order_count, SUM(subtotal_amount) AS total_revenue
FROM so GROUP BY status""", doubles=("total_revenue",)))
def q_a7(spark, d):
    return an.status_summary(td.sales_orders(spark, d))


@register("a8_bi_summary", oracle(SO + """
SELECT CASE GROUPING(category, year, status) WHEN 3 THEN 'category' WHEN 5 THEN 'year'
            ELSE 'status' END AS dimension,
       category, year, status, COUNT(*) AS order_count, SUM(subtotal_amount) AS total_revenue,
       CAST(SUM(subtotal_amount) AS DOUBLE) / COUNT(subtotal_amount) AS avg_order_value,
       CAST(SUM(quantity) AS BIGINT) AS total_quantity
FROM (SELECT category, status, CAST(year(order_date) AS BIGINT) AS year, subtotal_amount, quantity FROM so) t
GROUP BY GROUPING SETS ((category), (year), (status))""", doubles=("total_revenue",)))
def q_a8(spark, d):
    return an.bi_summary(td.sales_orders(spark, d))


@register("a9_table_stats", oracle(SO + """
SELECT COUNT(*) AS total_records, COUNT(DISTINCT status) AS unique_statuses,
       COUNT(DISTINCT customer_name) AS unique_customers, COUNT(DISTINCT category) AS unique_categories,
       MIN(order_date) AS earliest_order, MAX(order_date) AS latest_order,
       CAST(SUM(quantity) AS BIGINT) AS total_quantity, SUM(subtotal_amount) AS total_revenue
FROM so""", doubles=("total_revenue",), texts=("earliest_order", "latest_order")))
def q_a9(spark, d):
    return an.table_stats(td.sales_orders(spark, d))


@register("a22_measures", oracle(SO + """
SELECT SUM(subtotal_amount) AS total_revenue,
       CAST(SUM(subtotal_amount) AS DOUBLE) / NULLIF(COUNT(*), 0) AS average_order_value,
       COUNT(*) AS orders_count FROM so""", doubles=("total_revenue",)))
def q_a22(spark, d):
    return an.measures(td.sales_orders(spark, d))


@register("a23_top_customers", oracle(SO + """
SELECT customer_name, SUM(subtotal_amount) AS total_revenue, COUNT(*) AS order_count
FROM so GROUP BY customer_name
ORDER BY total_revenue DESC NULLS LAST, customer_name ASC NULLS LAST LIMIT 10""",
                                    doubles=("total_revenue",)))
def q_a23(spark, d):
    return an.top_customers(td.sales_orders(spark, d), k=10)


@register("w3_category_ranking", oracle(SO + """
SELECT category, total_revenue,
       CAST(ROW_NUMBER() OVER (ORDER BY total_revenue DESC NULLS FIRST, category ASC NULLS FIRST) AS BIGINT) AS rank
FROM (SELECT category, SUM(subtotal_amount) AS total_revenue FROM so GROUP BY category) t""",
                                      doubles=("total_revenue",)))
def q_w3(spark, d):
    return an.category_ranking(td.sales_orders(spark, d))


@register("w7_revenue_growth", oracle(SO + """
SELECT year, revenue, previous_revenue,
       CAST(revenue - previous_revenue AS DOUBLE) / NULLIF(CAST(previous_revenue AS DOUBLE), 0) AS growth
FROM (SELECT year, revenue,
             SUM(revenue) OVER (ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS previous_revenue
      FROM (SELECT CAST(year(order_date) AS BIGINT) AS year, SUM(subtotal_amount) AS revenue
            FROM so GROUP BY 1) y) t""", doubles=("revenue", "previous_revenue")))
def q_w7(spark, d):
    return an.revenue_growth(td.sales_orders(spark, d))


@register("p1_orders_by_status", oracle(SO + "SELECT * FROM so WHERE status = 'Pending'",
                                        doubles=MONEY_COLS, texts=("order_date",), bigints=("quantity",)))
def q_p1(spark, d):
    return an.orders_by_status(td.sales_orders(spark, d), "Pending")


@register("p2_filter_orders", oracle(SO + """
SELECT * FROM so WHERE status = 'Order Finished' AND category = 'BUILDING'""",
                                     doubles=MONEY_COLS, texts=("order_date",), bigints=("quantity",)))
def q_p2(spark, d):
    return an.filter_orders(td.sales_orders(spark, d), status="Order Finished", category="BUILDING")


@register("p3_bi_extract", oracle(SO + f"""
SELECT {ORDER_OUT}, CAST(year(order_date) AS BIGINT) AS year, CAST(month(order_date) AS BIGINT) AS month,
       CAST(quarter(order_date) AS BIGINT) AS quarter FROM so""",
                                  doubles=MONEY_COLS, texts=("order_date",), bigints=("quantity",)))
def q_p3(spark, d):
    return an.bi_extract(td.sales_orders(spark, d))


@register("p4_search_orders", oracle(SO + """
SELECT * FROM so WHERE status = 'Pending' AND customer_name ILIKE '%00001%'
ORDER BY order_id DESC LIMIT 50""", doubles=MONEY_COLS, texts=("order_date",), bigints=("quantity",)))
def q_p4(spark, d):
    return an.search_orders(td.sales_orders(spark, d), status="Pending", customer_name="00001")


# Terms to search for: the end of every customer's name, and short, empty, unknown and wildcard ones.
_ODD_TERMS = ["", "99", "#7", "nobody", "_00000001", "R#%9", "CUSTOMER#00000010"]


@register("p4_indexed_search", SO + """
, t AS (SELECT DISTINCT right(c_name, 4) AS term FROM customer UNION SELECT unnest([""" + ", ".join(f"'{t}'" for t in _ODD_TERMS) + """])),
n AS MATERIALIZED (SELECT order_id AS id, customer_name || '' AS name FROM so), m AS MATERIALIZED (SELECT term || '' AS term FROM t)
SELECT m.term, n.id FROM n JOIN m ON n.name ILIKE '%' || m.term || '%'""")
def q_p4_indexed(spark, d):
    """Orders by a part of the customer's name, for many terms at once."""
    orders = td.sales_orders(spark, d).select("order_id", "customer_name")
    terms = td.read_table(spark, d, "customer").select(F.substring("c_name", -4, 4).alias("term")).unionByName(
        spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in _ODD_TERMS])).alias("term")))
    checkpoint_dir(spark)
    index = SI.build(orders, "order_id", "customer_name").checkpoint(eager=True)
    return SI.search(orders, index, terms, "order_id", "customer_name")


@register("l1_page", oracle(SO + """
SELECT * FROM so WHERE category = 'MACHINERY' ORDER BY order_id DESC LIMIT 50 OFFSET 100""",
                            doubles=MONEY_COLS, texts=("order_date",), bigints=("quantity",)))
def q_l1(spark, d):
    return an.page(td.sales_orders(spark, d), page_no=3, per_page=50, category="MACHINERY")


_MIDDLE = "(SELECT COUNT(*) // 2 // 50 FROM so)"


def _listing(spark, d):
    return RankDirectory.write(td.sales_orders(spark, d), scratch_path(spark, f"listing-{uuid.uuid4().hex}"),
                               [F.col("order_id").desc()])


@register("l1_middle_page", oracle(SO + f"""
SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY order_id DESC) AS k FROM so) t
WHERE k > {_MIDDLE} * 50 AND k <= ({_MIDDLE} + 1) * 50""", doubles=MONEY_COLS, texts=("order_date",), bigints=("quantity",)))
def q_l1_middle(spark, d):
    """The page in the middle of the whole table, from a rank directory."""
    listing = _listing(spark, d)
    total = listing.info().first()["total"]
    return listing.page(total // 2 // 50 + 1, 50)


@register("l1_listing_info", SO + """
SELECT COUNT(*) AS total, CAST(50 AS BIGINT) AS per_page, (COUNT(*) + 49) // 50 AS total_pages FROM so""")
def q_l1_listing_info(spark, d):
    return _listing(spark, d).info(50)


@register("l2_customer_last_page", oracle(SO + """
, c AS (SELECT customer_name FROM so GROUP BY customer_name ORDER BY COUNT(*) DESC, customer_name LIMIT 1),
t AS (SELECT so.*, ROW_NUMBER() OVER (ORDER BY order_date DESC, order_id DESC) AS k, COUNT(*) OVER () AS n
      FROM so JOIN c ON c.customer_name = so.customer_name)
SELECT * EXCLUDE (k, n) FROM t WHERE k > (n - 1) // 10 * 10""", doubles=MONEY_COLS, texts=("order_date",), bigints=("quantity",)))
def q_l2_last(spark, d):
    """The last page of the customer with the most orders, newest first."""
    orders = td.sales_orders(spark, d)
    most = orders.groupBy("customer_name").count().orderBy(F.col("count").desc(), "customer_name").first()[0]
    listing = RankDirectory.write(orders, scratch_path(spark, f"listing-{uuid.uuid4().hex}"),
                                  [F.col("order_date").desc(), F.col("order_id").desc()], segment="customer_name")
    return listing.page(listing.info(10, most).first()["total_pages"], 10, most)


@register("l1_page_info", SO + """
SELECT COUNT(*) AS total, CAST(50 AS BIGINT) AS per_page, (COUNT(*) + 49) // 50 AS total_pages
FROM so WHERE category = 'MACHINERY'""")
def q_l1_info(spark, d):
    return an.page_info(td.sales_orders(spark, d), per_page=50, category="MACHINERY")


@register("l4_top_categories", SO + """
SELECT category, COUNT(*) AS count FROM so WHERE category IS NOT NULL
GROUP BY category ORDER BY count DESC, category LIMIT 10""")
def q_l4(spark, d):
    return an.value_counts(td.sales_orders(spark, d), "category", k=10)
