"""Domain tables derived from the driver's TPC-H-like test tables.

Each builder reads the given parquet tables (so its work grows with them)
and returns a DataFrame in a schema of :mod:`shopfloor.schemas`.  The
``*_SQL`` strings build the same tables in DuckDB for the oracle check;
their text is kept next to the Spark code so the two cannot drift apart.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MONEY, RATE

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Fixed time used where the domain model needs a creation timestamp.
AS_OF = "2024-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------------------
# orders (the reference's central table)
# ---------------------------------------------------------------------------

def sales_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` in the reference schema, one row per test order.

    Line items are pre-aggregated per order before the join (map-side
    partial aggregation, so a hot order key costs one row per partition),
    and the aggregate is already hash-partitioned on the join key.
    """
    li = (read_table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.sum("l_quantity").cast("int").alias("quantity"),
               F.max("l_tax").cast(RATE).alias("tax_rate")))
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    subtotal = F.col("o_totalprice").cast(MONEY)
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(li, o.o_orderkey == li.l_orderkey, "left")
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.when(F.col("o_orderstatus") == "F", "Order Finished")
                 .when(F.col("o_orderstatus") == "O", "Pending")
                 .otherwise("processing").alias("status"),
                F.col("c_name").alias("customer_name"),
                F.col("o_orderdate").cast("date").alias("order_date"),
                F.col("quantity"),
                subtotal.alias("subtotal_amount"),
                F.col("tax_rate"),
                (subtotal * F.lit(0.005).cast("decimal(4,3)")).cast(MONEY).alias("shipping_cost"),
                F.col("c_mktsegment").alias("category"),
                F.col("o_orderpriority").alias("subcategory")))


SALES_ORDERS_SQL = """
WITH li AS (SELECT l_orderkey, CAST(SUM(l_quantity) AS INT) AS quantity,
                   CAST(MAX(l_tax) AS DECIMAL(6,4)) AS tax_rate
            FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey AS order_id,
       CASE o.o_orderstatus WHEN 'F' THEN 'Order Finished' WHEN 'O' THEN 'Pending'
            ELSE 'processing' END AS status,
       c.c_name AS customer_name, CAST(o.o_orderdate AS DATE) AS order_date, li.quantity,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS subtotal_amount, li.tax_rate,
       CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * CAST(0.005 AS DECIMAL(4,3)) AS DECIMAL(18,2))
         AS shipping_cost,
       c.c_mktsegment AS category, o.o_orderpriority AS subcategory
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN li ON li.l_orderkey = o.o_orderkey
"""


def sales_orders_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_orders`` with deterministic defects for the quality rules.

    The clean adapter has no five-key duplicates, empty strings, negative
    values or tax rates above 100 %.  This variant keeps every row and
    injects them by key: a copy of every 97th order (id + 10^9, a five-key
    duplicate), blank names on every 101st, negative quantities on every
    103rd, missing statuses on every 107th, tax above 1 on every 109th.
    """
    base = sales_orders(spark, sf_dir)
    oid = F.col("order_id")
    # one pass over the base table: every 97th row is emitted twice
    copies = F.explode(F.when(oid % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return base.select("*", copies.alias("_copy")).select(
        (oid + F.col("_copy") * F.lit(10 ** 9)).alias("order_id"),
        F.when(oid % 107 == 0, F.lit(None).cast("string")).otherwise(F.col("status")).alias("status"),
        F.when(oid % 101 == 0, F.lit("")).otherwise(F.col("customer_name")).alias("customer_name"),
        "order_date",
        F.when(oid % 103 == 0, -F.col("quantity")).otherwise(F.col("quantity")).alias("quantity"),
        "subtotal_amount",
        F.when(oid % 109 == 0, (F.col("tax_rate") + F.lit(1)).cast(RATE))
         .otherwise(F.col("tax_rate")).alias("tax_rate"),
        "shipping_cost", "category", "subcategory")


SALES_ORDERS_DIRTY_SQL = f"""
WITH so AS ({SALES_ORDERS_SQL}),
damaged AS (
  SELECT order_id,
         CASE WHEN order_id % 107 = 0 THEN NULL ELSE status END AS status,
         CASE WHEN order_id % 101 = 0 THEN '' ELSE customer_name END AS customer_name,
         order_date,
         CASE WHEN order_id % 103 = 0 THEN -quantity ELSE quantity END AS quantity,
         subtotal_amount,
         CASE WHEN order_id % 109 = 0 THEN CAST(tax_rate + 1 AS DECIMAL(6,4)) ELSE tax_rate END AS tax_rate,
         shipping_cost, category, subcategory
  FROM so)
SELECT * FROM damaged
UNION ALL
SELECT order_id + 1000000000 AS order_id, status, customer_name, order_date, quantity,
       subtotal_amount, tax_rate, shipping_cost, category, subcategory
FROM damaged WHERE order_id % 97 = 0
"""


# ---------------------------------------------------------------------------
# store tables
# ---------------------------------------------------------------------------

def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog from ``part``.  Only a few dozen distinct names exist, so
    the de-duplication job has plenty of work."""
    p = read_table(spark, sf_dir, "part")
    ts = F.lit(AS_OF).cast("timestamp_ntz")
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        F.lit(None).cast("string").alias("image_url"),
        F.col("p_size").alias("stock_quantity"),
        (F.col("p_size") % 10 != 0).alias("is_active"),
        ts.alias("created_at"),
        ts.alias("updated_at"))


PRODUCTS_SQL = f"""
SELECT p_partkey AS product_id, p_name AS name, p_brand AS description, p_type AS category,
       p_brand AS subcategory, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
       CAST(NULL AS VARCHAR) AS image_url, p_size AS stock_quantity,
       (p_size % 10 <> 0) AS is_active,
       TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
FROM part
"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_items`` from ``lineitem`` priced from the catalog.

    ``(l_orderkey, l_linenumber)`` is not unique in the test data, so the
    item id is the line's rank in a global order over all its columns
    (dense ids: range sort + per-partition offsets, no window per order,
    so a huge order is spread over many tasks).
    """
    from ..operators.ids import dense_ids
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    ranked = dense_ids(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                 "l_extendedprice", "l_shipdate"),
                       ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                        "l_extendedprice", "l_shipdate"], "order_item_id", base=0)
    price = F.col("p_retailprice").cast(MONEY)
    qty = F.col("l_quantity").cast("int")
    return (ranked.join(p, ranked.l_partkey == p.p_partkey, "left")
            .select(
                "order_item_id",
                F.col("l_orderkey").alias("customer_order_id"),
                F.col("l_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                price.alias("product_price"),
                qty.alias("quantity"),
                (price * qty).cast(MONEY).alias("subtotal"),
                F.col("l_shipdate").alias("created_at")))


ORDER_ITEMS_SQL = """
SELECT ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                                   l_extendedprice, l_shipdate) AS order_item_id,
       l_orderkey AS customer_order_id, l_partkey AS product_id, p_name AS product_name,
       CAST(p_retailprice AS DECIMAL(18,2)) AS product_price, CAST(l_quantity AS INT) AS quantity,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS INT) AS DECIMAL(18,2)) AS subtotal,
       l_shipdate AS created_at
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
"""


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer_orders`` from orders joined to customer and nation."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sub = F.col("o_totalprice").cast(MONEY)
    tax = (sub * F.lit("0.08").cast("decimal(3,2)")).cast(MONEY)
    ship = F.when(sub >= 100, F.lit(0)).otherwise(F.lit(10)).cast(MONEY)
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(
                F.col("o_orderkey").alias("customer_order_id"),
                F.col("c_name").alias("customer_name"),
                F.concat(F.lit("customer"), F.col("c_custkey"), F.lit("@example.com")).alias("customer_email"),
                F.lit(None).cast("string").alias("customer_phone"),
                F.concat(F.col("c_custkey"), F.lit(" Main Street")).alias("shipping_address"),
                F.col("n_name").alias("shipping_city"),
                F.lit(None).cast("string").alias("shipping_state"),
                F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("shipping_zip"),
                F.col("n_name").alias("shipping_country"),
                sub.alias("subtotal_amount"), tax.alias("tax_amount"), ship.alias("shipping_cost"),
                (sub + tax + ship).cast(MONEY).alias("total_amount"),
                F.when(F.col("o_orderstatus") == "F", "delivered")
                 .when(F.col("o_orderstatus") == "O", "pending")
                 .otherwise("processing").alias("status"),
                F.lit("simulated").alias("payment_method"),
                F.lit("completed").alias("payment_status"),
                F.col("o_orderdate").alias("order_date"),
                F.col("o_orderpriority").alias("notes"),
                F.concat(F.lit("u"), F.col("o_custkey")).alias("session_id")))


CUSTOMER_ORDERS_SQL = """
SELECT o_orderkey AS customer_order_id, c_name AS customer_name,
       'customer' || CAST(c_custkey AS VARCHAR) || '@example.com' AS customer_email,
       CAST(NULL AS VARCHAR) AS customer_phone,
       CAST(c_custkey AS VARCHAR) || ' Main Street' AS shipping_address,
       n_name AS shipping_city, CAST(NULL AS VARCHAR) AS shipping_state,
       lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS shipping_zip, n_name AS shipping_country,
       CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal_amount,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.08 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS tax_amount,
       CAST(CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) >= 100 THEN 0 ELSE 10 END AS DECIMAL(18,2)) AS shipping_cost,
       CAST(CAST(o_totalprice AS DECIMAL(18,2))
            + CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.08 AS DECIMAL(3,2)) AS DECIMAL(18,2))
            + CAST(CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) >= 100 THEN 0 ELSE 10 END AS DECIMAL(18,2))
            AS DECIMAL(18,2)) AS total_amount,
       CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status,
       'simulated' AS payment_method, 'completed' AS payment_status,
       o_orderdate AS order_date, o_orderpriority AS notes, 'u' || CAST(o_custkey AS VARCHAR) AS session_id
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
"""


def cart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart actions from the ``events`` stream.

    click -> add (1..5 units), purchase -> update (-1..4 units, <= 0
    removes), error -> remove, signup -> clear; a view is an action that
    carts don't know.  The product is the ``k`` of the event's JSON properties.
    """
    e = read_table(spark, sf_dir, "events")
    base = F.floor(F.col("value")).cast("int")
    action = (F.when(F.col("event_type") == "click", "add")
              .when(F.col("event_type") == "purchase", "update")
              .when(F.col("event_type") == "error", "remove")
              .when(F.col("event_type") == "signup", "clear").otherwise("view"))
    qty = (F.when(F.col("event_type") == "click", base % 5 + 1)
           .when(F.col("event_type") == "purchase", base % 6 - 1))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("session_id"), F.col("event_id").alias("seq"), action.alias("action"),
        F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("long")).alias("product_id"),
        qty.alias("quantity"))


CART_EVENTS_SQL = """
SELECT 'u' || CAST(user_id AS VARCHAR) AS session_id, event_id AS seq,
       CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'update'
                       WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'clear' ELSE 'view' END AS action,
       CASE WHEN event_type <> 'signup' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS product_id,
       CASE event_type WHEN 'click' THEN CAST(FLOOR(value) AS INT) % 5 + 1
                       WHEN 'purchase' THEN CAST(FLOOR(value) AS INT) % 6 - 1 END AS quantity
FROM events
"""


# ---------------------------------------------------------------------------
# order commands (JSON text, as a message queue would carry them)
# ---------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def order_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, action, data)`` commands from ``events``.

    signup -> create_order (every 10th lacks ``quantity`` and is rejected),
    click -> update_order of the status (every 13th has no field),
    purchase -> update_order of quantity (every 20th is -1) and shipping
    (every 7th is JSON null), error -> delete_order, view -> get_order (a
    read command, not applied).  Target id = user_id * 100 + k.
    """
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    oid = (F.col("user_id") * 100 + k).cast("string")
    cents = F.floor(F.col("value") * 100).cast("long")
    money = F.concat((cents / 100).cast("long").cast("string"), F.lit("."),
                     F.lpad((cents % 100).cast("string"), 2, "0"))
    seg = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (k % 5 + 1).cast("int"))
    create = F.concat(
        F.lit('{"customer_name": "Customer#'), F.col("user_id").cast("string"), F.lit('", '),
        F.when(k % 10 != 0, F.concat(F.lit('"quantity": "'), (k % 50 + 1).cast("string"), F.lit('", ')))
         .otherwise(F.lit("")),
        F.lit('"subtotal_amount": "'), money, F.lit('", "category": "'), seg,
        F.lit('", "subcategory": "web"}'))
    status = F.when(k % 13 == 0, F.concat(F.lit('{"order_id": "'), oid, F.lit('"}'))) \
        .otherwise(F.concat(F.lit('{"order_id": "'), oid, F.lit('", "status": "shipped"}')))
    qty = F.concat(F.lit('{"order_id": "'), oid, F.lit('", "quantity": "'), (k % 20 - 1).cast("string"),
                   F.lit('", "shipping_cost": '),
                   F.when(k % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), money, F.lit('"'))),
                   F.lit("}"))
    only_id = F.concat(F.lit('{"order_id": "'), oid, F.lit('"}'))
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(et == "signup", "create_order").when(et == "click", "update_order")
         .when(et == "purchase", "update_order").when(et == "error", "delete_order")
         .otherwise("get_order").alias("action"),
        F.when(et == "signup", create).when(et == "click", status).when(et == "purchase", qty)
         .otherwise(only_id).alias("data"))


ORDER_COMMANDS_SQL = """
SELECT event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'create_order' WHEN 'click' THEN 'update_order'
            WHEN 'purchase' THEN 'update_order' WHEN 'error' THEN 'delete_order' ELSE 'get_order' END AS action,
       CASE event_type
         WHEN 'signup' THEN '{"customer_name": "Customer#' || CAST(user_id AS VARCHAR) || '", '
              || CASE WHEN k % 10 <> 0 THEN '"quantity": "' || CAST(k % 50 + 1 AS VARCHAR) || '", ' ELSE '' END
              || '"subtotal_amount": "' || money || '", "category": "'
              || ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][CAST(k % 5 + 1 AS INT)]
              || '", "subcategory": "web"}'
         WHEN 'click' THEN CASE WHEN k % 13 = 0 THEN '{"order_id": "' || oid || '"}'
                                ELSE '{"order_id": "' || oid || '", "status": "shipped"}' END
         WHEN 'purchase' THEN '{"order_id": "' || oid || '", "quantity": "' || CAST(k % 20 - 1 AS VARCHAR)
              || '", "shipping_cost": ' || CASE WHEN k % 7 = 0 THEN 'null' ELSE '"' || money || '"' END || '}'
         ELSE '{"order_id": "' || oid || '"}' END AS data
FROM (SELECT *, CAST(user_id * 100 + k AS VARCHAR) AS oid,
             CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS money
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                   CAST(FLOOR(value * 100) AS BIGINT) AS cents FROM events) a) b
"""


# ---------------------------------------------------------------------------
# checkout requests: one per cart session, customer data from ``customer``
# ---------------------------------------------------------------------------

def checkout_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One checkout per session of :func:`cart_events` (session 'u<id>'
    belongs to customer <id>).  Customers with a negative balance give a
    malformed e-mail (rejected by the customer-info rules); BUILDING
    customers pay by card."""
    sessions = (read_table(spark, sf_dir, "events").select("user_id").distinct())
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = sessions.join(c, sessions.user_id == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("session_id"),
        F.col("user_id").alias("seq"),
        F.col("c_name").alias("customer_name"),
        F.when(F.col("c_acctbal") >= 0,
               F.concat(F.lit("customer"), F.col("c_custkey"), F.lit("@example.com")))
         .otherwise(F.concat(F.lit("customer"), F.col("c_custkey"), F.lit("(at)example"))).alias("customer_email"),
        F.lit(None).cast("string").alias("customer_phone"),
        F.concat(F.col("c_custkey"), F.lit(" Main Street")).alias("shipping_address"),
        F.col("n_name").alias("shipping_city"),
        F.lit(None).cast("string").alias("shipping_state"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("shipping_zip"),
        F.lit(None).cast("string").alias("shipping_country"),
        F.lit(None).cast("string").alias("notes"),
        F.when(F.col("c_mktsegment") == "BUILDING", "card").otherwise("simulated").alias("payment_method"))


CHECKOUT_REQUESTS_SQL = """
SELECT 'u' || CAST(user_id AS VARCHAR) AS session_id, user_id AS seq, c_name AS customer_name,
       CASE WHEN c_acctbal >= 0 THEN 'customer' || CAST(c_custkey AS VARCHAR) || '@example.com'
            ELSE 'customer' || CAST(c_custkey AS VARCHAR) || '(at)example' END AS customer_email,
       CAST(NULL AS VARCHAR) AS customer_phone, CAST(c_custkey AS VARCHAR) || ' Main Street' AS shipping_address,
       n_name AS shipping_city, CAST(NULL AS VARCHAR) AS shipping_state,
       lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS shipping_zip, CAST(NULL AS VARCHAR) AS shipping_country,
       CAST(NULL AS VARCHAR) AS notes,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'card' ELSE 'simulated' END AS payment_method
FROM (SELECT DISTINCT user_id FROM events) s JOIN customer ON user_id = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
"""
