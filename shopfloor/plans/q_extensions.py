"""Registered extension-point queries (U1-U4) and the customer-order
listing (L2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import normalize_name, order_total
from ..operators import analytics as an
from ..sources import testdata as td
from .registered import CO, SO, register


def _limits(spark, d):
    """Rules table derived from the data: per market segment a quantity
    bound of twice the segment's average; per (segment, 1-URGENT) a
    subtotal bound."""
    so = td.sales_orders(spark, d)
    seg = so.groupBy("category").agg(F.floor(F.avg("quantity") * 2).cast("int").alias("max_quantity"),
                                     F.lit(None).cast("decimal(18,2)").alias("max_subtotal")) \
        .withColumn("subcategory", F.lit(None).cast("string"))
    urgent = so.select("category").distinct().select(
        "category", F.lit("1-URGENT").alias("subcategory"), F.lit(None).cast("int").alias("max_quantity"),
        F.lit(300000).cast("decimal(18,2)").alias("max_subtotal"))
    return seg.unionByName(urgent)


@register("u1_category_limits", SO + """
, seg AS (SELECT category, CAST(FLOOR(AVG(quantity) * 2) AS INT) AS mq FROM so GROUP BY category)
SELECT so.order_id,
       COALESCE(CASE WHEN so.subcategory = '1-URGENT' THEN so.subtotal_amount > 300000
                     ELSE so.quantity > seg.mq END, false) AS over_category_limit
FROM so LEFT JOIN seg ON seg.category = so.category""")
def q_u1(spark, d):
    out = R.category_limits(td.sales_orders(spark, d), _limits(spark, d))
    return out.select("order_id", "over_category_limit")


@register("u2_normalized_names", f"WITH {CO}\n" + """
SELECT customer_order_id,
       array_to_string(list_transform(string_split(regexp_replace(trim(lower(customer_name || ' ' || shipping_city)),
         '\\s+', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS normalized
FROM customer_orders""")
def q_u2(spark, d):
    co = td.customer_orders(spark, d)
    return co.select("customer_order_id",
                     normalize_name(F.concat_ws(" ", "customer_name", "shipping_city")).alias("normalized"))


@register("u3_order_totals", SO + """
SELECT order_id, CAST(CAST(subtotal_amount + subtotal_amount * tax_rate + shipping_cost AS DECIMAL(18,2)) AS DOUBLE)
         AS total_amount FROM so""")
def q_u3(spark, d):
    return td.sales_orders(spark, d).select("order_id", order_total().alias("total_amount"))


@register("u4_status_domain", SO + """
SELECT order_id, status NOT IN (SELECT DISTINCT c_mktsegment FROM customer) AS status_outside_domain FROM so""")
def q_u4(spark, d):
    domain = td.read_table(spark, d, "customer").select(F.col("c_mktsegment").alias("status"))
    check = R.domain_rule("status_outside_domain", "status", domain)
    return check(td.sales_orders(spark, d)).select("order_id", "status_outside_domain")


@register("l2_customer_orders_page", f"WITH {CO}\n" + """
SELECT customer_order_id, customer_email, order_date FROM customer_orders
ORDER BY order_date DESC, customer_order_id DESC LIMIT 100 OFFSET 200""")
def q_l2(spark, d):
    co = td.customer_orders(spark, d).select("customer_order_id", "customer_email", "order_date")
    return an.customer_orders_page(co, limit=100, offset=200)
