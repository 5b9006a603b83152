"""Registered catalog, lookup, de-duplication and id queries
(P5-P7, A10, A26, A27, A28, J1-J5, J9, L6, M1-M4, T3, T4, W2, W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import dedupe as D
from ..operators import ids as I
from ..sources import testdata as td
from .registered import CO, ITEMS, PROD, SO, oracle, register

PROD_DOUBLES = ("price",)


def _products(spark, d):
    return td.products(spark, d)


@register("p6_list_products", oracle(PROD + "SELECT * FROM products WHERE is_active",
                                     doubles=PROD_DOUBLES, bigints=("stock_quantity",)))
def q_p6(spark, d):
    return C.list_products(_products(spark, d))


@register("p5_search_products", oracle(PROD + """
SELECT * FROM products
WHERE is_active AND (name ILIKE '%ring%' OR description ILIKE '%ring%')
  AND category = 'ECONOMY' AND price >= 950 AND price <= 990""",
                                       doubles=PROD_DOUBLES, bigints=("stock_quantity",)))
def q_p5(spark, d):
    return C.search_products(_products(spark, d), term="ring", category="ECONOMY",
                             min_price=950, max_price=990)


def _requested_ids(spark, d):
    """A set of requested product ids, one per line item; doubled keys beyond
    the catalog give not-found ids, and odd ones are never asked for."""
    return td.read_table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("product_id"))


REQ_SQL = "req AS (SELECT l_partkey * 2 AS product_id FROM lineitem)"


@register("p7_lookup_products", oracle(PROD + f", {REQ_SQL}\n"
                                       "SELECT * FROM products WHERE product_id IN (SELECT product_id FROM req)",
                                       doubles=PROD_DOUBLES, bigints=("stock_quantity",)))
def q_p7(spark, d):
    return C.lookup(_products(spark, d), _requested_ids(spark, d), "product_id")


@register("p7_missing_ids", PROD + f", {REQ_SQL}\n"
          "SELECT DISTINCT product_id FROM req WHERE product_id NOT IN (SELECT product_id FROM products)")
def q_p7_missing(spark, d):
    return C.missing_ids(_products(spark, d), _requested_ids(spark, d), "product_id")


@register("a10_active_categories", PROD + "SELECT DISTINCT category FROM products WHERE is_active")
def q_a10(spark, d):
    return C.active_categories(_products(spark, d))


@register("j1_orders_with_items", oracle(f"WITH {CO}, {ITEMS}\n" + """
SELECT o.customer_order_id, o.customer_name, o.status, o.total_amount,
       i.order_item_id AS item_order_item_id, i.product_id AS item_product_id,
       i.quantity AS item_quantity, i.subtotal AS item_subtotal
FROM customer_orders o LEFT JOIN order_items i ON o.customer_order_id = i.customer_order_id""",
                                         doubles=("total_amount", "item_subtotal"),
                                         bigints=("item_quantity",)))
def q_j1(spark, d):
    o = td.customer_orders(spark, d).select("customer_order_id", "customer_name", "status", "total_amount")
    i = td.order_items(spark, d).select("order_item_id", "customer_order_id", "product_id",
                                        "quantity", "subtotal")
    return C.orders_with_items(o, i)


@register("j1_order_item_arrays", f"WITH {CO}, {ITEMS}\n" + """
SELECT o.customer_order_id, o.status, COALESCE(string_agg(CAST(i.order_item_id AS VARCHAR) || ':' || CAST(i.product_id AS VARCHAR)
         || ':' || CAST(i.subtotal AS VARCHAR), ',' ORDER BY i.order_item_id), '') AS item_list
FROM customer_orders o LEFT JOIN order_items i ON o.customer_order_id = i.customer_order_id
WHERE o.customer_order_id IN (SELECT l_orderkey FROM lineitem)
GROUP BY o.customer_order_id, o.status""")
def q_j1_nested(spark, d):
    """The item list of every order that a line item names."""
    o = td.customer_orders(spark, d).select("customer_order_id", "status")
    i = td.order_items(spark, d).select("order_item_id", "customer_order_id", "product_id", "subtotal")
    asked = td.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("customer_order_id"))
    return C.orders_with_item_arrays(o, i, asked).select("customer_order_id", "status", _item_list())


def _item_list():
    return F.expr("array_join(transform(items, x -> concat(x.order_item_id, ':', x.product_id, ':', x.subtotal)), ',')") \
        .alias("item_list")


@register("j2_orders_by_email_lists", f"WITH {CO}, {ITEMS}\n" + """
SELECT o.customer_order_id, COALESCE(string_agg(CAST(i.order_item_id AS VARCHAR) || ':' || CAST(i.product_id AS VARCHAR)
         || ':' || CAST(i.subtotal AS VARCHAR), ',' ORDER BY i.order_item_id), '') AS item_list
FROM customer_orders o LEFT JOIN order_items i ON o.customer_order_id = i.customer_order_id
WHERE o.customer_email = 'customer7@example.com'
GROUP BY o.customer_order_id""")
def q_j2_lists(spark, d):
    o = td.customer_orders(spark, d).select("customer_order_id", "customer_email", "order_date")
    i = td.order_items(spark, d).select("order_item_id", "customer_order_id", "product_id", "subtotal")
    return C.orders_by_email(o, i, "customer7@example.com", nested=True).select("customer_order_id", _item_list())


@register("j2_orders_by_email", oracle(f"WITH {CO}, {ITEMS}\n" + """
SELECT o.customer_order_id, o.customer_email, o.order_date, i.order_item_id AS item_order_item_id,
       i.product_id AS item_product_id
FROM customer_orders o LEFT JOIN order_items i ON o.customer_order_id = i.customer_order_id
WHERE o.customer_email = 'customer7@example.com'"""))
def q_j2(spark, d):
    o = td.customer_orders(spark, d).select("customer_order_id", "customer_email", "order_date")
    i = td.order_items(spark, d).select("order_item_id", "customer_order_id", "product_id")
    return C.orders_by_email(o, i, "customer7@example.com")


@register("j9_orphan_items", oracle(f"{PROD}, {ITEMS}\n" + """
SELECT order_item_id, product_id FROM order_items
WHERE product_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM products p WHERE p.is_active AND p.product_id = order_items.product_id)"""))
def q_j9(spark, d):
    parents = _products(spark, d).filter("is_active")
    items = td.order_items(spark, d).select("order_item_id", "product_id")
    return C.orphans(items, parents, "product_id", "product_id")


@register("j9_cascade_delete", oracle(f"WITH {CO}, {ITEMS}\n" + """
SELECT order_item_id, customer_order_id FROM order_items
WHERE customer_order_id NOT IN (SELECT customer_order_id FROM customer_orders WHERE status = 'pending')"""))
def q_j9_cascade(spark, d):
    deleted = td.customer_orders(spark, d).filter(F.col("status") == "pending").select("customer_order_id")
    items = td.order_items(spark, d).select("order_item_id", "customer_order_id")
    return C.cascade_delete(items, deleted, "customer_order_id")


@register("m1_dedupe_products", oracle(PROD + """
SELECT * FROM products p WHERE product_id = (SELECT MIN(product_id) FROM products q WHERE q.name = p.name)""",
                                       doubles=PROD_DOUBLES, bigints=("stock_quantity",)))
def q_m1(spark, d):
    return D.dedupe_products(_products(spark, d))["products"]


@register("w2_id_mapping", PROD + """
SELECT product_id AS old_id, keep_id FROM (
  SELECT product_id, MIN(product_id) OVER (PARTITION BY name) AS keep_id FROM products) t
WHERE product_id <> keep_id""")
def q_w2(spark, d):
    return D.id_mapping(_products(spark, d))


@register("m1_items_repointed", oracle(f"{PROD}, {ITEMS}\n" + """
, keep AS (SELECT name, MIN(product_id) AS keep_id FROM products GROUP BY name)
SELECT i.order_item_id, COALESCE(k.keep_id, i.product_id) AS product_id, i.quantity
FROM order_items i LEFT JOIN products p ON p.product_id = i.product_id
LEFT JOIN keep k ON k.name = p.name""", bigints=("quantity",)))
def q_m1_items(spark, d):
    items = td.order_items(spark, d).select("order_item_id", "product_id", "quantity")
    return D.dedupe_products(_products(spark, d), items)["items"]


@register("m1_report", f"{PROD}, {ITEMS}\n" + """
, keep AS (SELECT name, MIN(product_id) AS keep_id FROM products GROUP BY name)
SELECT 'products_before' AS metric, COUNT(*) AS value FROM products
UNION ALL SELECT 'products_after', COUNT(*) FROM keep
UNION ALL SELECT 'products_deleted', (SELECT COUNT(*) FROM products) - (SELECT COUNT(*) FROM keep)
UNION ALL SELECT 'items_repointed', COUNT(*) FROM order_items i JOIN products p ON p.product_id = i.product_id
          JOIN keep k ON k.name = p.name AND k.keep_id <> p.product_id""")
def q_m1_report(spark, d):
    items = td.order_items(spark, d).select("order_item_id", "product_id")
    return D.dedupe_products(_products(spark, d), items)["report"]


@register("m1_dedupe_sum_stock", PROD + """
SELECT MIN(product_id) AS product_id, name, CAST(SUM(stock_quantity) AS BIGINT) AS stock_quantity
FROM products GROUP BY name""")
def q_m1_sum(spark, d):
    return D.dedupe_products(_products(spark, d), sum_stock=True)["products"] \
        .select("product_id", "name", "stock_quantity")


def _nameless(spark, d):
    return _products(spark, d).withColumn("name", F.when(F.col("product_id") % 9 != 0, F.col("name")))


_NAMELESS = PROD + ", q AS (SELECT * REPLACE (CASE WHEN product_id % 9 <> 0 THEN name END AS name) FROM products)"


@register("m1_nameless_products", _NAMELESS + """
SELECT MIN(product_id) AS product_id, name, CAST(SUM(stock_quantity) AS BIGINT) AS stock_quantity FROM q GROUP BY name""")
def q_m1_nameless(spark, d):
    """Products without a name are a group of their own; none vanishes."""
    return D.dedupe_products(_nameless(spark, d), sum_stock=True)["products"].select("product_id", "name", "stock_quantity")


@register("w2_nameless_mapping", _NAMELESS + """
, k AS (SELECT name, MIN(product_id) AS keep_id FROM q GROUP BY name)
SELECT q.product_id AS old_id, k.keep_id FROM q JOIN k ON k.name IS NOT DISTINCT FROM q.name WHERE q.product_id <> k.keep_id""")
def q_w2_nameless(spark, d):
    return D.id_mapping(_nameless(spark, d))


def _image_map(spark, d):
    """name -> URL for every part; the names of small parts are changed so that
    they match no product (unmatched), as do the nation names."""
    p = td.read_table(spark, d, "part").select(
        F.when(F.col("p_size") > 45, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" spare"))).alias("name"))
    n = td.read_table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return p.unionByName(n).select("name", F.concat(F.lit("https://img.example/"),
                                                    F.regexp_replace("name", " ", "-")).alias("image_url"))


IMG_SQL = """img AS (SELECT name, 'https://img.example/' || replace(name, ' ', '-') AS image_url FROM (
  SELECT CASE WHEN p_size > 45 THEN p_name ELSE p_name || ' spare' END AS name FROM part UNION ALL SELECT n_name FROM nation) t)"""


@register("m2_assign_images", PROD + f", {IMG_SQL}\n" + """
SELECT p.product_id, COALESCE(m.url, p.image_url) AS image_url, p.updated_at
FROM products p LEFT JOIN (SELECT name, MAX(image_url) AS url FROM img GROUP BY name) m ON m.name = p.name""")
def q_m2(spark, d):
    return C.assign_images(_products(spark, d), _image_map(spark, d),
                           as_of="2024-06-01 00:00:00")["products"].select("product_id", "image_url", "updated_at")


@register("m2_unmatched_names", PROD + f", {IMG_SQL}\n" + """
SELECT DISTINCT name FROM img WHERE name NOT IN (SELECT name FROM products)""")
def q_m2_unmatched(spark, d):
    return C.assign_images(_products(spark, d), _image_map(spark, d))["unmatched"]


@register("m2_report", PROD + f", {IMG_SQL}\n" + """
SELECT COUNT(*) AS updated_rows FROM products WHERE name IN (SELECT name FROM img)""")
def q_m2_report(spark, d):
    return C.assign_images(_products(spark, d), _image_map(spark, d))["report"]


@register("m3_stock_labels", PROD + """
SELECT product_id, stock_quantity,
       CASE WHEN stock_quantity <= 0 THEN 'out_of_stock' WHEN stock_quantity < 10 THEN 'low_stock'
            ELSE 'in_stock' END AS stock_label,
       CASE WHEN stock_quantity >= 100 THEN 'good' WHEN stock_quantity >= 30 THEN 'moderate'
            ELSE 'low' END AS stock_band
FROM products""")
def q_m3(spark, d):
    return C.with_stock_labels(_products(spark, d)).select(
        "product_id", F.col("stock_quantity").cast("bigint").alias("stock_quantity"),
        "stock_label", "stock_band")


@register("m3_low_stock", oracle(PROD + "SELECT * FROM products WHERE stock_quantity < 10",
                                 doubles=PROD_DOUBLES, bigints=("stock_quantity",)))
def q_m3_low(spark, d):
    return C.low_stock(_products(spark, d), 10)


@register("m4_high_value_orders", oracle(SO + "SELECT * FROM so WHERE subtotal_amount > 400000",
                                         doubles=("subtotal_amount", "tax_rate", "shipping_cost"),
                                         texts=("order_date",), bigints=("quantity",)))
def q_m4(spark, d):
    return C.high_value_orders(td.sales_orders(spark, d), 400000)


@register("t4_not_in_kept", PROD + """
SELECT product_id FROM products
WHERE product_id NOT IN (SELECT MIN(product_id) FROM products GROUP BY name)""")
def q_t4(spark, d):
    p = _products(spark, d)
    return C.not_in(p, D.keep_ids(p), "product_id", "keep_id").select("product_id")


@register("a26_next_id", SO + "SELECT CAST(COALESCE(MAX(order_id), 0) AS BIGINT) AS next_base FROM so")
def q_a26(spark, d):
    return I.next_id(td.sales_orders(spark, d), "order_id")


@register("w4_dense_ids", f"WITH {CO}, so AS ({td.SALES_ORDERS_SQL})\n" + """
SELECT customer_order_id,
       (SELECT COALESCE(MAX(order_id), 0) FROM so)
         + ROW_NUMBER() OVER (ORDER BY order_date, customer_order_id) AS new_id
FROM customer_orders""")
def q_w4(spark, d):
    co = td.customer_orders(spark, d).select("customer_order_id", "order_date")
    base = I.next_id(td.sales_orders(spark, d), "order_id")
    return I.dense_ids(co, ["order_date", "customer_order_id"], "new_id", base=base) \
        .select("customer_order_id", "new_id")
