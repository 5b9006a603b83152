"""Registered cart and checkout queries.

The DuckDB oracle folds each (session, product) action stream with a
recursive CTE (session clears copied into every product stream of the
session) -- a different formulation from the Spark fast path / streaming
fold it checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import carts as K
from ..sources import testdata as td
from . import checkout as CK
from .registered import register

AS_OF = "2024-06-01 00:00:00"
AS_OF_DATE = "2024-06-01"

_ADD_REASON = ("CASE WHEN NOT s.ex THEN 'product not found' WHEN NOT s.active THEN 'product not available' "
               "WHEN s.quantity IS NULL OR s.quantity <= 0 THEN 'quantity must be positive' "
               "WHEN s.stock IS NULL OR s.stock < f.qty + s.quantity THEN 'insufficient stock' END")
_UPD_REASON = ("CASE WHEN s.quantity IS NULL OR s.quantity <= 0 THEN NULL "
               "WHEN f.qty = 0 THEN 'product not in cart' "
               "WHEN NOT s.ex OR s.stock IS NULL OR s.stock < s.quantity THEN 'insufficient stock' END")

CART_FOLD = f"""WITH RECURSIVE products AS ({td.PRODUCTS_SQL}), cart_events AS ({td.CART_EVENTS_SQL}),
pairs AS (SELECT DISTINCT session_id, product_id FROM cart_events WHERE action <> 'clear'),
stream AS (
  SELECT session_id, product_id, seq, action, quantity FROM cart_events WHERE action <> 'clear'
  UNION ALL
  SELECT p.session_id, p.product_id, c.seq, 'clear', NULL FROM cart_events c
  JOIN pairs p ON p.session_id = c.session_id WHERE c.action = 'clear'),
s AS (SELECT st.*, ROW_NUMBER() OVER (PARTITION BY st.session_id, st.product_id ORDER BY st.seq) AS rn,
             pr.stock_quantity AS stock, COALESCE(pr.is_active, false) AS active, pr.product_id IS NOT NULL AS ex
      FROM stream st LEFT JOIN products pr ON pr.product_id = st.product_id),
f AS (
  SELECT session_id, product_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS qty, CAST(NULL AS VARCHAR) AS reason
  FROM pairs
  UNION ALL
  SELECT f.session_id, f.product_id, s.rn,
    CASE WHEN s.action IN ('clear', 'remove') THEN 0
         WHEN s.action = 'add' THEN CASE WHEN ({_ADD_REASON}) IS NULL THEN f.qty + s.quantity ELSE f.qty END
         WHEN s.action = 'update' THEN CASE WHEN s.quantity IS NULL OR s.quantity <= 0 THEN 0
                                            WHEN ({_UPD_REASON}) IS NULL THEN s.quantity ELSE f.qty END
         ELSE f.qty END,
    CASE WHEN s.action IN ('clear', 'remove') THEN NULL
         WHEN s.action = 'add' THEN {_ADD_REASON}
         WHEN s.action = 'update' THEN {_UPD_REASON}
         ELSE 'unknown action' END
  FROM f JOIN s ON s.session_id = f.session_id AND s.product_id = f.product_id AND s.rn = f.rn + 1),
lines AS (SELECT session_id, product_id, CAST(arg_max(qty, rn) AS INT) AS quantity FROM f
          GROUP BY session_id, product_id HAVING arg_max(qty, rn) > 0)
"""

_PRICED = """
, priced AS (SELECT l.session_id, l.product_id, l.quantity, p.name AS product_name, p.price AS product_price,
                    CAST(p.price * l.quantity AS DECIMAL(18,2)) AS subtotal
             FROM lines l LEFT JOIN products p ON p.product_id = l.product_id),
tot AS (SELECT session_id, CAST(SUM(subtotal) AS DECIMAL(18,2)) AS subtotal, CAST(SUM(quantity) AS BIGINT) AS item_count,
               COUNT(*) AS line_count FROM priced GROUP BY session_id),
totals AS (SELECT session_id, subtotal, CAST(0.08 AS DECIMAL(6,4)) AS tax_rate,
                  CAST(subtotal * CAST(0.08 AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS tax_amount,
                  CAST(CASE WHEN subtotal >= 100 THEN 0 ELSE 10 END AS DECIMAL(18,2)) AS shipping_cost,
                  CAST(subtotal + subtotal * CAST(0.08 AS DECIMAL(6,4))
                       + CAST(CASE WHEN subtotal >= 100 THEN 0 ELSE 10 END AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total,
                  item_count, line_count FROM tot),
valid AS (SELECT l.session_id, bool_and(COALESCE(p.stock_quantity >= l.quantity, false)) AS ok, COUNT(*) AS line_count
          FROM lines l LEFT JOIN products p ON p.product_id = l.product_id GROUP BY l.session_id)
"""

_CHECKOUT = f"""
, customer_orders AS ({td.CUSTOMER_ORDERS_SQL}), order_items AS ({td.ORDER_ITEMS_SQL}),
so AS ({td.SALES_ORDERS_SQL}), req AS ({td.CHECKOUT_REQUESTS_SQL}),
dec AS (SELECT r.*, v.ok, v.line_count,
          array_to_string(list_filter([
            CASE WHEN length(COALESCE(customer_name, '')) < 2 THEN 'customer_name_min_2' END,
            CASE WHEN NOT COALESCE(regexp_matches(customer_email, '{S.EMAIL_PATTERN}'), false)
                 THEN 'customer_email_invalid' END,
            CASE WHEN length(COALESCE(shipping_address, '')) < 5 THEN 'shipping_address_min_5' END,
            CASE WHEN length(COALESCE(shipping_city, '')) < 2 THEN 'shipping_city_min_2' END,
            CASE WHEN length(COALESCE(shipping_zip, '')) < 3 THEN 'shipping_zip_min_3' END],
            lambda x: x IS NOT NULL), ',') AS info
        FROM req r LEFT JOIN valid v ON v.session_id = r.session_id),
decided AS (SELECT *, CASE WHEN line_count IS NULL THEN 'Cart is empty'
                           WHEN info <> '' THEN 'invalid customer info: ' || info
                           WHEN NOT ok THEN 'insufficient stock' END AS reason FROM dec),
heads AS (SELECT d.*, t.subtotal, t.tax_rate, t.tax_amount, t.shipping_cost, t.total, t.line_count AS n_lines,
                 (SELECT MAX(customer_order_id) FROM customer_orders)
                   + ROW_NUMBER() OVER (ORDER BY d.seq, d.session_id) AS customer_order_id
          FROM decided d JOIN totals t ON t.session_id = d.session_id WHERE d.reason IS NULL),
acc AS (SELECT p.*, h.seq, h.customer_order_id, h.customer_name, h.tax_rate,
               CAST(h.shipping_cost / h.n_lines AS DECIMAL(18,2)) AS shipping_share
        FROM priced p JOIN heads h ON h.session_id = p.session_id)
"""


def _lines(spark, d):
    return K.fold_carts(td.cart_events(spark, d), td.products(spark, d))


@register("c1_cart_lines", CART_FOLD + "SELECT session_id, product_id, CAST(quantity AS BIGINT) AS quantity FROM lines")
def q_c1(spark, d):
    return _lines(spark, d)


@register("c1_cart_outcomes", CART_FOLD + """
SELECT s.session_id, s.seq, s.action, s.product_id, f.reason IS NULL AS accepted, f.reason
FROM s JOIN f ON f.session_id = s.session_id AND f.product_id = s.product_id AND f.rn = s.rn
WHERE s.action <> 'clear'
UNION ALL
SELECT session_id, seq, action, product_id, true, NULL FROM cart_events WHERE action = 'clear'""")
def q_c1_out(spark, d):
    return K.cart_event_outcomes(td.cart_events(spark, d), td.products(spark, d))


@register("c2_cart_totals", CART_FOLD + _PRICED + """
SELECT session_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax_rate AS DOUBLE) AS tax_rate,
       CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(shipping_cost AS DOUBLE) AS shipping_cost,
       CAST(total AS DOUBLE) AS total, item_count, line_count FROM totals""")
def q_c2(spark, d):
    return K.cart_totals(K.price_lines(_lines(spark, d), td.products(spark, d)))


@register("j8_priced_lines", CART_FOLD + _PRICED + """
SELECT session_id, product_id, CAST(quantity AS BIGINT) AS quantity, product_name,
       CAST(product_price AS DOUBLE) AS product_price, CAST(subtotal AS DOUBLE) AS subtotal FROM priced""")
def q_j8(spark, d):
    return K.price_lines(_lines(spark, d), td.products(spark, d)).drop("product_image")


@register("c3_validate_carts", CART_FOLD + _PRICED + """
SELECT session_id, ok, line_count, CASE WHEN NOT ok THEN 'insufficient stock' END AS reason FROM valid""")
def q_c3(spark, d):
    return K.validate_carts(_lines(spark, d), td.products(spark, d))


@register("p19_stock_check", CART_FOLD + """
SELECT l.session_id, l.product_id, CAST(l.quantity AS BIGINT) AS quantity, p.product_id IS NOT NULL AS found,
       COALESCE(p.is_active, false) AS purchasable, COALESCE(p.stock_quantity >= l.quantity, false) AS stock_ok
FROM lines l LEFT JOIN products p ON p.product_id = l.product_id""")
def q_p19(spark, d):
    return K.stock_check(_lines(spark, d), td.products(spark, d))


def _checkout(spark, d, exact_split=False):
    """Snapshot mode: the oracle below validates against starting stock."""
    return CK.checkout(_lines(spark, d), td.checkout_requests(spark, d), td.products(spark, d),
                       td.customer_orders(spark, d), td.order_items(spark, d), td.sales_orders(spark, d),
                       as_of=AS_OF, exact_split=exact_split, mode="snapshot")


C4_COLUMNS = ("customer_order_id", "customer_name", "customer_email", "shipping_city", "shipping_country",
              "subtotal_amount", "tax_amount", "shipping_cost", "total_amount", "status", "payment_method",
              "payment_status", "order_date", "session_id")

_C4 = f"""
SELECT customer_order_id, customer_name, customer_email, shipping_city, COALESCE(shipping_country, 'USA') AS shipping_country,
       CAST(subtotal AS DOUBLE) AS subtotal_amount, CAST(tax_amount AS DOUBLE) AS tax_amount,
       CAST(shipping_cost AS DOUBLE) AS shipping_cost, CAST(total AS DOUBLE) AS total_amount, 'pending' AS status,
       payment_method, CASE WHEN payment_method = 'simulated' THEN 'completed' ELSE 'pending' END AS payment_status,
       TIMESTAMP '{AS_OF}' AS order_date, session_id
FROM heads"""


@register("c4_customer_orders_new", CART_FOLD + _PRICED + _CHECKOUT + _C4)
def q_c4(spark, d):
    return _checkout(spark, d)["customer_orders_new"].select(*C4_COLUMNS)


_C5 = f"""
SELECT (SELECT MAX(order_item_id) FROM order_items) + ROW_NUMBER() OVER (ORDER BY customer_order_id, product_id)
         AS order_item_id,
       customer_order_id, product_id, product_name, CAST(product_price AS DOUBLE) AS product_price,
       CAST(quantity AS BIGINT) AS quantity, CAST(subtotal AS DOUBLE) AS subtotal, TIMESTAMP '{AS_OF}' AS created_at
FROM acc"""


@register("c5_order_items_new", CART_FOLD + _PRICED + _CHECKOUT + _C5)
def q_c5(spark, d):
    return _checkout(spark, d)["order_items_new"]


@register("c6_stock_after_checkout", CART_FOLD + _PRICED + _CHECKOUT + """
, dl AS (SELECT product_id, seq, -quantity AS delta,
                ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY seq) AS rn FROM acc),
g AS (SELECT product_id, CAST(0 AS BIGINT) AS rn, CAST(stock_quantity AS BIGINT) AS stock FROM products
      WHERE product_id IN (SELECT product_id FROM dl)
      UNION ALL
      SELECT g.product_id, dl.rn, CASE WHEN g.stock + dl.delta >= 0 THEN g.stock + dl.delta ELSE g.stock END
      FROM g JOIN dl ON dl.product_id = g.product_id AND dl.rn = g.rn + 1),
fin AS (SELECT product_id, arg_max(stock, rn) AS stock FROM g GROUP BY product_id)
SELECT p.product_id, CAST(COALESCE(fin.stock, p.stock_quantity) AS BIGINT) AS stock_quantity
FROM products p LEFT JOIN fin ON fin.product_id = p.product_id""")
def q_c6(spark, d):
    return _checkout(spark, d)["products"].select(
        "product_id", F.col("stock_quantity").cast("bigint").alias("stock_quantity"))


_C7 = f"""
SELECT (SELECT MAX(order_id) FROM so) + ROW_NUMBER() OVER (ORDER BY seq, product_id) AS order_id,
       'Order Finished' AS status, customer_name, '{AS_OF_DATE}' AS order_date, CAST(quantity AS BIGINT) AS quantity,
       CAST(subtotal AS DOUBLE) AS subtotal_amount, CAST(tax_rate AS DOUBLE) AS tax_rate,
       CAST(shipping_share AS DOUBLE) AS shipping_cost, 'Store Order' AS category, product_name AS subcategory
FROM acc"""


@register("c7_orders_new", CART_FOLD + _PRICED + _CHECKOUT + _C7)
def q_c7(spark, d):
    return _checkout(spark, d)["orders_new"]


_C8 = """
SELECT session_id, seq, reason FROM decided WHERE reason IS NOT NULL"""


@register("c8_checkout_rejects", CART_FOLD + _PRICED + _CHECKOUT + _C8)
def q_c8(spark, d):
    return _checkout(spark, d)["rejects"]


@register("w6_shipping_exact_split", CART_FOLD + _PRICED + """
, sh AS (SELECT l.session_id, l.product_id, t.shipping_cost, t.line_count,
                CAST(t.shipping_cost / t.line_count AS DECIMAL(18,2)) AS share,
                MIN(l.product_id) OVER (PARTITION BY l.session_id) AS first_pid
         FROM lines l JOIN totals t ON t.session_id = l.session_id)
SELECT session_id, product_id,
       CAST(CASE WHEN product_id = first_pid THEN share + (shipping_cost - share * line_count) ELSE share END
            AS DOUBLE) AS shipping_share
FROM sh""")
def q_w6(spark, d):
    lines = _lines(spark, d)
    totals = K.cart_totals(K.price_lines(lines, td.products(spark, d)))
    return K.shipping_shares(lines, totals, exact_split=True).select("session_id", "product_id", "shipping_share")


# ---------------------------------------------------------------------------
# sequential checkout: carts compete for stock in checkout order
# ---------------------------------------------------------------------------

_SEQ = """
, elig AS (SELECT session_id, seq FROM decided WHERE line_count IS NOT NULL AND info = ''),
pidx AS (SELECT product_id, ROW_NUMBER() OVER (ORDER BY product_id) AS ix FROM (SELECT DISTINCT product_id FROM lines) t),
carts AS (SELECT e.session_id, e.seq, ROW_NUMBER() OVER (ORDER BY e.seq, e.session_id) AS n,
                 list({'ix': p.ix, 'q': CAST(l.quantity AS BIGINT)}) AS items
          FROM elig e JOIN lines l ON l.session_id = e.session_id JOIN pidx p ON p.product_id = l.product_id
          GROUP BY e.session_id, e.seq),
init AS (SELECT list(CAST(pr.stock_quantity AS BIGINT) ORDER BY p.ix) AS st
         FROM pidx p LEFT JOIN products pr ON pr.product_id = p.product_id),
rec AS (
  SELECT CAST(0 AS BIGINT) AS n, (SELECT st FROM init) AS st, CAST(NULL AS BOOLEAN) AS ok
  UNION ALL
  SELECT c.n,
         CASE WHEN COALESCE(list_bool_and(list_transform(c.items, lambda x: r.st[x.ix] >= x.q)), false)
              THEN list_transform(r.st, lambda s, j: s - COALESCE(list_sum(list_transform(
                     list_filter(c.items, lambda x: x.ix = j), lambda x: x.q)), 0))
              ELSE r.st END,
         COALESCE(list_bool_and(list_transform(c.items, lambda x: r.st[x.ix] >= x.q)), false)
  FROM rec r JOIN carts c ON c.n = r.n + 1)
"""


@register("c3_sequential_acceptance", CART_FOLD + _PRICED + _CHECKOUT + _SEQ + """
SELECT c.session_id, c.seq, r.ok AS accepted FROM carts c JOIN rec r ON r.n = c.n""")
def q_c3_seq(spark, d):
    reqs = td.checkout_requests(spark, d)
    from ..functions import rules as R
    eligible = reqs.filter(F.size(R.violations(R.customer_info_rules(reqs.schema))) == 0)
    return K.sequential_acceptance(_lines(spark, d), eligible, td.products(spark, d))


# decisions of the recursion above, and what they make
_SEQ_CHECKOUT = """
, seq_ok AS (SELECT c.session_id, r.ok FROM carts c JOIN rec r ON r.n = c.n),
seq_decided AS (SELECT d.* EXCLUDE (ok, reason),
                       CASE WHEN line_count IS NULL THEN 'Cart is empty'
                            WHEN info <> '' THEN 'invalid customer info: ' || info
                            WHEN NOT s.ok THEN 'insufficient stock' END AS reason
                FROM decided d LEFT JOIN seq_ok s ON s.session_id = d.session_id),
seq_heads AS (SELECT d.*, t.subtotal, t.tax_rate, t.tax_amount, t.shipping_cost, t.total, t.line_count AS n_lines,
                     (SELECT MAX(customer_order_id) FROM customer_orders)
                       + ROW_NUMBER() OVER (ORDER BY d.seq, d.session_id) AS customer_order_id
              FROM seq_decided d JOIN totals t ON t.session_id = d.session_id WHERE d.reason IS NULL),
seq_acc AS (SELECT p.*, h.seq, h.customer_order_id, h.customer_name, h.tax_rate,
                   CAST(h.shipping_cost / h.n_lines AS DECIMAL(18,2)) AS shipping_share
            FROM priced p JOIN seq_heads h ON h.session_id = p.session_id)
"""


def _seq_checkout(spark, d):
    return CK.checkout(_lines(spark, d), td.checkout_requests(spark, d), td.products(spark, d),
                       td.customer_orders(spark, d), td.order_items(spark, d), td.sales_orders(spark, d),
                       as_of=AS_OF, mode="sequential")


def _seq_sql(select, table):
    return CART_FOLD + _PRICED + _CHECKOUT + _SEQ + _SEQ_CHECKOUT + select.replace(f"FROM {table}", f"FROM seq_{table}")


@register("c4_customer_orders_sequential", _seq_sql(_C4, "heads"))
def q_c4_seq(spark, d):
    return _seq_checkout(spark, d)["customer_orders_new"].select(*C4_COLUMNS)


@register("c5_order_items_sequential", _seq_sql(_C5, "acc"))
def q_c5_seq(spark, d):
    return _seq_checkout(spark, d)["order_items_new"]


@register("c7_orders_sequential", _seq_sql(_C7, "acc"))
def q_c7_seq(spark, d):
    return _seq_checkout(spark, d)["orders_new"]


@register("c8_rejects_sequential", _seq_sql(_C8, "decided"))
def q_c8_seq(spark, d):
    return _seq_checkout(spark, d)["rejects"]


@register("c6_stock_after_sequential", CART_FOLD + _PRICED + _CHECKOUT + _SEQ + """
, fin AS (SELECT st FROM rec ORDER BY n DESC LIMIT 1)
SELECT p.product_id, CAST(COALESCE(fin.st[x.ix], p.stock_quantity) AS BIGINT) AS stock_quantity
FROM products p LEFT JOIN pidx x ON x.product_id = p.product_id, fin""")
def q_c6_seq(spark, d):
    return _seq_checkout(spark, d)["products"].select("product_id", F.col("stock_quantity").cast("bigint").alias("stock_quantity"))
