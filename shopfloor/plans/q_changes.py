"""Registered change-set queries (D1-D12, J6, J7, W5, F11, R2 batch form).

Change inputs are derived from the test tables (mostly ``events``), so
their volume grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import changes as CH
from ..sources import testdata as td
from .registered import CO, PROD, SO, oracle, register

AS_OF = "2024-06-01 00:00:00"
AS_OF_DATE = "2024-06-01"
ORDER_DOUBLES = ("subtotal_amount", "tax_rate", "shipping_cost")
ORDER_CASTS = dict(doubles=ORDER_DOUBLES, texts=("order_date",), bigints=("quantity",))
CMD = f"cmd AS ({td.ORDER_COMMANDS_SQL})"
SQL_TYPES = {"order_date": "DATE", "quantity": "INTEGER", "subtotal_amount": "DECIMAL(18,2)",
             "tax_rate": "DECIMAL(6,4)", "shipping_cost": "DECIMAL(18,2)"}


def _events(spark, d):
    return td.read_table(spark, d, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long"))


EV = ("ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")


# ---------------------------------------------------------------------------
# R2 (batch form) / D2 / D4 / D6: order commands in sequence order
# ---------------------------------------------------------------------------

def _cmd_sql(constraints=True, cmd=CMD):
    """DuckDB twin of apply_order_commands, written with windows and
    arg_max instead of the Spark aggregate/join formulation."""
    f_all = S.ORDER_FIELDS
    has = lambda f: f"json_exists(data, '$.{f}')"
    val = lambda f: f"json_extract_string(data, '$.{f}')"
    bad = " OR ".join(f"COALESCE({has(f)} AND {val(f)} IS NOT NULL AND TRY_CAST({val(f)} AS {t}) IS NULL, false)"
                      for f, t in SQL_TYPES.items())
    null = " OR ".join(f"({has(f)} AND {val(f)} IS NULL)" for f in f_all)
    negative = " OR ".join(f"COALESCE(TRY_CAST({val(f)} AS {t}) < 0, false)" for f, t in SQL_TYPES.items() if f != "order_date")
    broken = (f"WHEN action IN ('create_order', 'update_order') AND ({null}) THEN 'NULL not allowed'\n"
              f"    WHEN action IN ('create_order', 'update_order') AND ({negative}) THEN 'negative value'") if constraints else ""
    any_field = " OR ".join(has(f) for f in f_all)
    miss_req = " OR ".join(f"NOT {has(f)}" for f in CH.CREATE_REQUIRED)

    def create_val(f):
        if f == "order_date":
            return f"COALESCE(TRY_CAST({val(f)} AS DATE), DATE '{AS_OF_DATE}') AS {f}"
        v = val(f)
        if f in CH.CREATE_DEFAULTS:
            v = f"CASE WHEN {has(f)} THEN {v} ELSE '{CH.CREATE_DEFAULTS[f]}' END"
        t = SQL_TYPES.get(f)
        return f"TRY_CAST({v} AS {t}) AS {f}" if t else f"{v} AS {f}"

    patch_cols = ", ".join(f"arg_max({{'v': {val(f)}}}, pos) FILTER (WHERE {has(f)}) AS p_{f}" for f in f_all)
    new_cols = ", ".join(
        (f"CASE WHEN p.p_{f} IS NOT NULL THEN TRY_CAST(p.p_{f}.v AS {SQL_TYPES[f]}) ELSE s.{f} END AS {f}"
         if f in SQL_TYPES else f"CASE WHEN p.p_{f} IS NOT NULL THEN p.p_{f}.v ELSE s.{f} END AS {f}")
        for f in f_all)
    return f"""
WITH so AS ({td.SALES_ORDERS_SQL}), {cmd},
c AS (SELECT ROW_NUMBER() OVER (ORDER BY seq NULLS FIRST, action, data) AS pos, seq, action, data, TRY_CAST({val('order_id')} AS BIGINT) AS oid FROM cmd),
chk AS (SELECT *, CASE
    WHEN seq IS NULL THEN 'no seq'
    WHEN action IN ('get_order', 'get_stats', 'search_orders') THEN 'read-only action (not applied)'
    WHEN action IS NULL OR action NOT IN ('create_order', 'update_order', 'delete_order')
      THEN 'Unknown action: ' || COALESCE(action, 'null')
    WHEN action IN ('update_order', 'delete_order') AND COALESCE(oid, 0) = 0 THEN 'order_id is required'
    WHEN action = 'update_order' AND NOT ({any_field}) THEN 'No fields to update'
    WHEN action = 'create_order' AND ({miss_req}) THEN 'missing required field'
    WHEN action IN ('create_order', 'update_order') AND ({bad}) THEN 'invalid value'
    {broken}
  END AS reason FROM c),
ok AS (SELECT * FROM chk WHERE reason IS NULL),
created AS (SELECT (SELECT COALESCE(MAX(order_id), 0) FROM so) + ROW_NUMBER() OVER (ORDER BY pos) AS order_id,
                   pos, seq, data FROM ok WHERE action = 'create_order'),
state AS (SELECT order_id, status, customer_name, order_date, quantity, subtotal_amount, tax_rate,
                 shipping_cost, category, subcategory, -1 AS born FROM so
          UNION ALL
          SELECT order_id, {', '.join(create_val(f) for f in f_all)}, pos AS born FROM created),
dels AS (SELECT d.pos, d.seq, d.oid, s.born FROM ok d LEFT JOIN state s ON s.order_id = d.oid
         WHERE d.action = 'delete_order'),
died AS (SELECT oid, MIN(pos) AS died FROM dels WHERE born IS NOT NULL AND pos > born GROUP BY oid),
ups AS (SELECT u.pos, u.seq, u.oid, u.data, s.born, dd.died FROM ok u LEFT JOIN state s ON s.order_id = u.oid
        LEFT JOIN died dd ON dd.oid = u.oid WHERE u.action = 'update_order'),
applied AS (SELECT * FROM ups WHERE born IS NOT NULL AND pos > born AND pos < COALESCE(died, 4611686018427387904)),
patch AS (SELECT oid, {patch_cols} FROM applied GROUP BY oid)
"""


_SELECT_TARGET = f"""
SELECT s.order_id, {', '.join(
    (f"CASE WHEN p.p_{f} IS NOT NULL THEN TRY_CAST(p.p_{f}.v AS {SQL_TYPES[f]}) ELSE s.{f} END AS {f}"
     if f in SQL_TYPES else f"CASE WHEN p.p_{f} IS NOT NULL THEN p.p_{f}.v ELSE s.{f} END AS {f}")
    for f in S.ORDER_FIELDS)}
FROM state s LEFT JOIN patch p ON p.oid = s.order_id
WHERE s.order_id NOT IN (SELECT oid FROM died)"""

_CMD_TARGET = _cmd_sql() + _SELECT_TARGET

_SELECT_CHANGES = f"""
SELECT seq, order_id, action, severity, data, TIMESTAMP '{AS_OF}' AS timestamp FROM (
  SELECT seq, order_id, 'created' AS action, 'success' AS severity, data FROM created
  UNION ALL SELECT seq, oid, 'updated', 'info', data FROM applied
  UNION ALL SELECT d.seq, d.oid, 'deleted', 'warning', NULL FROM dels d JOIN died x ON x.oid = d.oid AND x.died = d.pos
) t"""

_CMD_CHANGES = _cmd_sql() + _SELECT_CHANGES

_SELECT_REJECTS = """
SELECT seq, action, oid AS order_id, reason FROM chk WHERE reason IS NOT NULL
UNION ALL
SELECT d.seq, 'delete_order', d.oid, 'Order not found' FROM dels d LEFT JOIN died x ON x.oid = d.oid
WHERE x.died IS NULL OR x.died <> d.pos
UNION ALL
SELECT seq, 'update_order', oid, 'Order not found' FROM ups
WHERE NOT (born IS NOT NULL AND pos > born AND pos < COALESCE(died, 4611686018427387904))"""

_CMD_REJECTS = _cmd_sql() + _SELECT_REJECTS


def _apply_cmds(spark, d):
    return CH.apply_order_commands(td.sales_orders(spark, d), td.order_commands(spark, d), as_of=AS_OF)


@register("r2_commands_target", oracle(_CMD_TARGET, **ORDER_CASTS))
def q_r2_target(spark, d):
    return _apply_cmds(spark, d)["target"]


@register("r2_commands_target_unconstrained", oracle(_cmd_sql(constraints=False) + _SELECT_TARGET, **ORDER_CASTS))
def q_r2_target_free(spark, d):
    """A table without constraints: a present null sets NULL."""
    return CH.apply_order_commands(td.sales_orders(spark, d), td.order_commands(spark, d), as_of=AS_OF,
                                   constraints=False)["target"]


# Commands as a queue may bring them: some without a place, several with the same one.
_QUEUE_CMD = f"""raw AS ({td.ORDER_COMMANDS_SQL}),
cmd AS (SELECT CASE WHEN seq % 17 <> 0 THEN seq // 40 END AS seq, action, data FROM raw)"""


def _apply_queue(spark, d):
    cmds = td.order_commands(spark, d).withColumn("seq", F.when(F.col("seq") % 17 != 0, F.expr("seq div 40")))
    return CH.apply_order_commands(td.sales_orders(spark, d), cmds, as_of=AS_OF)


@register("r2_queue_target", oracle(_cmd_sql(cmd=_QUEUE_CMD) + _SELECT_TARGET, **ORDER_CASTS))
def q_r2_queue_target(spark, d):
    """Commands without a place or sharing one: table."""
    return _apply_queue(spark, d)["target"]


@register("r2_queue_changes", _cmd_sql(cmd=_QUEUE_CMD) + _SELECT_CHANGES)
def q_r2_queue_changes(spark, d):
    return _apply_queue(spark, d)["changes"]


@register("r2_queue_rejects", _cmd_sql(cmd=_QUEUE_CMD) + _SELECT_REJECTS)
def q_r2_queue_rejects(spark, d):
    return _apply_queue(spark, d)["rejects"]


@register("r2_queue_report", _cmd_sql(cmd=_QUEUE_CMD) + f"""
SELECT action, COUNT(*) AS count FROM ({_SELECT_CHANGES}) x GROUP BY action
UNION ALL SELECT 'rejected', COUNT(*) FROM ({_SELECT_REJECTS}) y""")
def q_r2_queue_report(spark, d):
    """Every command is counted once: created, updated, deleted or rejected."""
    return _apply_queue(spark, d)["report"]


@register("r2_commands_changes", _CMD_CHANGES)
def q_r2_changes(spark, d):
    return _apply_cmds(spark, d)["changes"]


@register("r2_commands_rejects", _CMD_REJECTS)
def q_r2_rejects(spark, d):
    return _apply_cmds(spark, d)["rejects"]


# ---------------------------------------------------------------------------
# Create with required fields and dense ids
# ---------------------------------------------------------------------------

def _new_orders(spark, d):
    co = td.customer_orders(spark, d)
    return co.select(
        "customer_order_id",
        F.lit("pending").alias("status"), "customer_name",
        F.col("order_date").cast("date").alias("order_date"),
        F.when(F.col("customer_order_id") % 11 != 0, (F.col("customer_order_id") % 7 + 1).cast("int"))
         .alias("quantity"),
        "subtotal_amount", F.lit("0.08").cast(S.RATE).alias("tax_rate"), "shipping_cost",
        F.lit(S.STORE_ORDER_CATEGORY).alias("category"), F.col("shipping_city").alias("subcategory"))


_NEW_ORDERS_SQL = f"""{CO}, so AS ({td.SALES_ORDERS_SQL}),
new_rows AS (SELECT customer_order_id, 'pending' AS status, customer_name, CAST(order_date AS DATE) AS order_date,
       CASE WHEN customer_order_id % 11 <> 0 THEN CAST(customer_order_id % 7 + 1 AS INT) END AS quantity,
       subtotal_amount, CAST(0.08 AS DECIMAL(6,4)) AS tax_rate, shipping_cost,
       'Store Order' AS category, shipping_city AS subcategory
FROM customer_orders)"""


@register("d1_create_orders", oracle(f"WITH {_NEW_ORDERS_SQL}\n" + """
SELECT (SELECT MAX(order_id) FROM so) + ROW_NUMBER() OVER (ORDER BY order_date, customer_order_id) AS order_id,
       status, customer_name, order_date, quantity, subtotal_amount, tax_rate, shipping_cost, category, subcategory
FROM new_rows WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in S.ORDER_FIELDS),
                                     **ORDER_CASTS))
def q_d1(spark, d):
    r = CH.create_rows(td.sales_orders(spark, d), _new_orders(spark, d), "order_id",
                       ["order_date", "customer_order_id"],
                       required=S.ORDER_FIELDS)
    return r["created"]


@register("d1_create_rejects", f"WITH {_NEW_ORDERS_SQL}\n" + """
SELECT customer_order_id, 'missing: quantity' AS reason FROM new_rows WHERE quantity IS NULL""")
def q_d1_rej(spark, d):
    r = CH.create_rows(td.sales_orders(spark, d), _new_orders(spark, d), "order_id",
                       ["order_date", "customer_order_id"],
                       required=S.ORDER_FIELDS)
    return r["rejects"].select("customer_order_id", "reason")


# ---------------------------------------------------------------------------
# D3: full replace
# ---------------------------------------------------------------------------

def _replacements(spark, d):
    so = td.sales_orders(spark, d)
    unknown = (F.col("subcategory") == "5-LOW") & (F.col("category") == "BUILDING")
    return so.select(
        F.when(unknown, F.col("order_id") + 10 ** 9).otherwise(F.col("order_id")).alias("order_id"),
        F.lit("delivered").alias("status"), *[c for c in so.columns if c not in ("order_id", "status", "shipping_cost")],
        F.lit(0).cast(S.MONEY).alias("shipping_cost"))


_D3_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in S.ORDER_FIELDS if c not in ("status", "shipping_cost"))


@register("d3_replace_orders", oracle(SO + """
SELECT order_id, CASE WHEN fits THEN 'delivered' ELSE status END AS status, customer_name, order_date, quantity,
       subtotal_amount, tax_rate, CASE WHEN fits THEN CAST(0 AS DECIMAL(18,2)) ELSE shipping_cost END AS shipping_cost,
       category, subcategory
FROM (SELECT *, NOT (subcategory = '5-LOW' AND category = 'BUILDING') """ + f"AND {_D3_WHOLE} AS fits FROM so) t", **ORDER_CASTS))
def q_d3(spark, d):
    return CH.replace_rows(td.sales_orders(spark, d), _replacements(spark, d), "order_id", required=S.ORDER_FIELDS)["target"]


@register("d3_replace_not_found", SO + """
SELECT order_id + 1000000000 AS order_id FROM so WHERE subcategory = '5-LOW' AND category = 'BUILDING' AND """ + _D3_WHOLE)
def q_d3_nf(spark, d):
    return CH.replace_rows(td.sales_orders(spark, d), _replacements(spark, d), "order_id", required=S.ORDER_FIELDS)["not_found"]


@register("d3_replace_rejects", SO + f"""
SELECT CASE WHEN subcategory = '5-LOW' AND category = 'BUILDING' THEN order_id + 1000000000 ELSE order_id END AS order_id
FROM so WHERE NOT ({_D3_WHOLE})""")
def q_d3_rej(spark, d):
    return CH.replace_rows(td.sales_orders(spark, d), _replacements(spark, d), "order_id",
                           required=S.ORDER_FIELDS)["rejects"].select("order_id")


# ---------------------------------------------------------------------------
# Product patches, NULL = leave
# ---------------------------------------------------------------------------

def _product_patches(spark, d):
    e = _events(spark, d)
    return e.select(
        F.when(F.col("event_type") == "error", F.col("k") + 5000).otherwise(F.col("k") * 7).alias("product_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", F.col("value")).cast(S.MONEY).alias("price"),
        F.when(F.col("event_type") == "purchase", F.floor("value")).cast("int").alias("stock_quantity"))


_PATCH_SQL = f"""{EV}, patches AS (
  SELECT CASE WHEN event_type = 'error' THEN k + 5000 ELSE k * 7 END AS product_id, event_id AS seq,
         CAST(CASE WHEN event_type = 'click' THEN value END AS DECIMAL(18,2)) AS price,
         CAST(CASE WHEN event_type = 'purchase' THEN FLOOR(value) END AS INT) AS stock_quantity
  FROM ev)"""


@register("d5_patch_products", oracle(PROD + f", {_PATCH_SQL}" + f"""
, last AS (SELECT product_id, arg_max(price, seq) FILTER (WHERE price IS NOT NULL) AS price,
                  arg_max(stock_quantity, seq) FILTER (WHERE stock_quantity IS NOT NULL) AS stock_quantity,
                  COUNT(*) FILTER (WHERE price IS NOT NULL OR stock_quantity IS NOT NULL) AS nn
           FROM patches GROUP BY product_id)
SELECT p.product_id, p.name, COALESCE(l.price, p.price) AS price,
       COALESCE(l.stock_quantity, p.stock_quantity) AS stock_quantity,
       CASE WHEN COALESCE(l.nn, 0) > 0 THEN TIMESTAMP '{AS_OF}' ELSE p.updated_at END AS updated_at
FROM products p LEFT JOIN last l ON l.product_id = p.product_id""",
                                      doubles=("price",), bigints=("stock_quantity",)))
def q_d5(spark, d):
    r = CH.patch_products(td.products(spark, d), _product_patches(spark, d), as_of=AS_OF)
    return r["target"].select("product_id", "name", "price", "stock_quantity", "updated_at")


@register("d5_patch_not_found", PROD + f", {_PATCH_SQL}\n" + """
SELECT DISTINCT product_id FROM patches WHERE product_id NOT IN (SELECT product_id FROM products)""")
def q_d5_nf(spark, d):
    return CH.patch_products(td.products(spark, d), _product_patches(spark, d))["not_found"]


_UNPLACED = "CASE WHEN seq % 13 <> 0 THEN seq // 30 END AS seq"


def _unplaced(changes):
    return changes.withColumn("seq", F.when(F.col("seq") % 13 != 0, F.expr("seq div 30")))


_D5_QUEUE = f"""{_PATCH_SQL}, q AS (SELECT product_id, {_UNPLACED}, price, stock_quantity FROM patches)"""


@register("d5_queue_patches", oracle(PROD + f", {_D5_QUEUE}" + f"""
, last AS (SELECT product_id, arg_max(price, {{'s': seq, 'v': price}}) FILTER (WHERE price IS NOT NULL) AS price,
                  arg_max(stock_quantity, {{'s': seq, 'v': stock_quantity}}) FILTER (WHERE stock_quantity IS NOT NULL) AS stock_quantity,
                  COUNT(*) FILTER (WHERE price IS NOT NULL OR stock_quantity IS NOT NULL) AS nn
           FROM q WHERE seq IS NOT NULL GROUP BY product_id)
SELECT p.product_id, COALESCE(l.price, p.price) AS price, COALESCE(l.stock_quantity, p.stock_quantity) AS stock_quantity,
       CASE WHEN COALESCE(l.nn, 0) > 0 THEN TIMESTAMP '{AS_OF}' ELSE p.updated_at END AS updated_at
FROM products p LEFT JOIN last l ON l.product_id = p.product_id""", doubles=("price",), bigints=("stock_quantity",)))
def q_d5_queue(spark, d):
    """Patches without a place change nothing, those that share one are ordered by value."""
    out = CH.patch_products(td.products(spark, d), _unplaced(_product_patches(spark, d)), as_of=AS_OF)
    return out["target"].select("product_id", "price", "stock_quantity", "updated_at")


@register("d5_queue_rejects", oracle(f"WITH {_D5_QUEUE}\n" + """
SELECT product_id, seq, price, stock_quantity, 'no seq' AS reason FROM q WHERE seq IS NULL""",
                                     doubles=("price",), bigints=("stock_quantity",)))
def q_d5_queue_rejects(spark, d):
    return CH.patch_products(td.products(spark, d), _unplaced(_product_patches(spark, d)))["rejects"]


# ---------------------------------------------------------------------------
# deletes
# ---------------------------------------------------------------------------

def _delete_ids(spark, d):
    gone = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    return td.read_table(spark, d, "lineitem").select(
        F.when(gone, F.col("l_orderkey")).otherwise(F.col("l_orderkey") + 10 ** 9).alias("order_id"))


_DEL_SQL = """del AS (SELECT CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_orderkey ELSE l_orderkey + 1000000000 END
  AS order_id FROM lineitem)"""


@register("d6_delete_orders", oracle(SO + f", {_DEL_SQL}\n"
                                     "SELECT * FROM so WHERE order_id NOT IN (SELECT order_id FROM del)",
                                     **ORDER_CASTS))
def q_d6(spark, d):
    return CH.delete_rows(td.sales_orders(spark, d), _delete_ids(spark, d), "order_id")["target"]


@register("d6_delete_not_found", SO + f", {_DEL_SQL}\n"
          "SELECT DISTINCT order_id FROM del WHERE order_id NOT IN (SELECT order_id FROM so)")
def q_d6_nf(spark, d):
    return CH.delete_rows(td.sales_orders(spark, d), _delete_ids(spark, d), "order_id")["not_found"]


@register("d10_soft_delete", PROD + f"""
SELECT product_id, CASE WHEN product_id IN (SELECT p_partkey FROM part WHERE p_size > 48) THEN false
                        ELSE is_active END AS is_active,
       CASE WHEN product_id IN (SELECT p_partkey FROM part WHERE p_size > 48) THEN TIMESTAMP '{AS_OF}'
            ELSE updated_at END AS updated_at
FROM products""")
def q_d10(spark, d):
    ids = td.read_table(spark, d, "part").select(
        F.when(F.col("p_size") > 48, F.col("p_partkey")).otherwise(F.col("p_partkey") + 10 ** 9).alias("product_id"))
    return CH.soft_delete(td.products(spark, d), ids, as_of=AS_OF).select("product_id", "is_active", "updated_at")


# ---------------------------------------------------------------------------
# Bulk status from id text; D8 with domain check
# ---------------------------------------------------------------------------

def _id_texts(spark, d):
    e = _events(spark, d)
    return e.select(F.concat((F.col("user_id") * 100 + F.col("k")).cast("string"), F.lit(", "),
                             F.col("k").cast("string"), F.lit(",x, "), (F.col("k") + 1).cast("string"),
                             F.lit("b")).alias("ids"))


_IDS_SQL = f"""{EV}, ids AS (
  SELECT DISTINCT unnest([user_id * 100 + k, k, k + 1]) AS order_id FROM ev)"""


@register("f11_ids_from_text", f"WITH {_IDS_SQL}\nSELECT order_id FROM ids")
def q_f11(spark, d):
    return CH.ids_from_text(_id_texts(spark, d)).distinct()


@register("d7_bulk_status", oracle(SO + f", {_IDS_SQL}\n" + """
SELECT order_id, CASE WHEN order_id IN (SELECT order_id FROM ids) THEN 'shipped' ELSE status END AS status
FROM so"""))
def q_d7(spark, d):
    return CH.set_status(td.sales_orders(spark, d), CH.ids_from_text(_id_texts(spark, d)),
                         "shipped")["target"].select("order_id", "status")


@register("d7_bulk_status_report", SO + f", {_IDS_SQL}\n"
          "SELECT COUNT(*) AS updated_rows FROM so WHERE order_id IN (SELECT order_id FROM ids)")
def q_d7_rep(spark, d):
    return CH.set_status(td.sales_orders(spark, d), CH.ids_from_text(_id_texts(spark, d)), "shipped")["report"]


def _status_changes(spark, d):
    e = _events(spark, d)
    st = (F.when(F.col("event_type") == "click", "shipped").when(F.col("event_type") == "purchase", "Delivered")
          .when(F.col("event_type") == "error", "cancelled").when(F.col("event_type") == "signup", "returned")
          .otherwise("processing"))
    return e.select((F.col("user_id") * 100 + F.col("k")).alias("customer_order_id"),
                    F.col("event_id").alias("seq"), st.alias("status"))


_STATUS_SQL = f"""{EV}, ch AS (
  SELECT user_id * 100 + k AS customer_order_id, event_id AS seq,
         CASE event_type WHEN 'click' THEN 'shipped' WHEN 'purchase' THEN 'Delivered' WHEN 'error' THEN 'cancelled'
              WHEN 'signup' THEN 'returned' ELSE 'processing' END AS status FROM ev)"""


@register("d8_customer_order_status", f"WITH {CO}, {_STATUS_SQL}\n" + """
, good AS (SELECT customer_order_id, arg_max(status, seq) AS new_status FROM ch
           WHERE status IN ('pending', 'processing', 'shipped', 'delivered', 'cancelled') GROUP BY customer_order_id)
SELECT o.customer_order_id, COALESCE(g.new_status, o.status) AS status
FROM customer_orders o LEFT JOIN good g ON g.customer_order_id = o.customer_order_id""")
def q_d8(spark, d):
    return CH.set_customer_order_status(td.customer_orders(spark, d), _status_changes(spark, d))["target"] \
        .select("customer_order_id", "status")


@register("d8_status_rejects", f"WITH {_STATUS_SQL}\n" + """
SELECT customer_order_id, seq, status, 'invalid status' AS reason FROM ch
WHERE status NOT IN ('pending', 'processing', 'shipped', 'delivered', 'cancelled')""")
def q_d8_rej(spark, d):
    return CH.set_customer_order_status(td.customer_orders(spark, d), _status_changes(spark, d))["rejects"]


_D8_QUEUE = f"{_STATUS_SQL}, q AS (SELECT customer_order_id, {_UNPLACED}, status FROM ch)"
_D8_DOMAIN = "('pending', 'processing', 'shipped', 'delivered', 'cancelled')"


@register("d8_queue_status", f"WITH {CO}, {_D8_QUEUE}\n" + f"""
, good AS (SELECT customer_order_id, MAX({{'s': seq, 'v': status}}).v AS new_status FROM q
           WHERE status IN {_D8_DOMAIN} AND seq IS NOT NULL GROUP BY customer_order_id)
SELECT o.customer_order_id, COALESCE(g.new_status, o.status) AS status
FROM customer_orders o LEFT JOIN good g ON g.customer_order_id = o.customer_order_id""")
def q_d8_queue(spark, d):
    return CH.set_customer_order_status(td.customer_orders(spark, d), _unplaced(_status_changes(spark, d)))["target"] \
        .select("customer_order_id", "status")


@register("d8_queue_rejects", f"WITH {_D8_QUEUE}\n" + f"""
SELECT customer_order_id, seq, status, CASE WHEN status NOT IN {_D8_DOMAIN} THEN 'invalid status' ELSE 'no seq' END AS reason
FROM q WHERE status NOT IN {_D8_DOMAIN} OR seq IS NULL""")
def q_d8_queue_rejects(spark, d):
    return CH.set_customer_order_status(td.customer_orders(spark, d), _unplaced(_status_changes(spark, d)))["rejects"]


# ---------------------------------------------------------------------------
# Guarded stock deltas (fast combinable path + streaming fold)
# ---------------------------------------------------------------------------

def _stock_deltas(spark, d):
    e = _events(spark, d)
    delta = (F.when(F.col("event_type") == "purchase", -F.floor("value"))
             .when(F.col("event_type") == "click", -(F.floor("value") % 5 + 1))
             .otherwise(F.lit(10)))
    return e.select((F.col("k") + 100 * (F.col("user_id") % 20)).alias("product_id"),
                    F.col("event_id").alias("seq"), delta.cast("long").alias("delta"))


_DELTAS_SQL = f"""{EV}, deltas AS (
  SELECT k + 100 * (user_id % 20) AS product_id, event_id AS seq,
         CAST(CASE event_type WHEN 'purchase' THEN -FLOOR(value) WHEN 'click' THEN -(FLOOR(value) % 5 + 1)
              ELSE 10 END AS BIGINT) AS delta
  FROM ev)"""

_FOLD_SQL = f"""WITH RECURSIVE {_DELTAS_SQL},
products AS ({td.PRODUCTS_SQL}),
d AS (SELECT product_id, seq, delta, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY seq) AS rn FROM deltas
      WHERE product_id IN (SELECT product_id FROM products)),
f AS (SELECT product_id, CAST(0 AS BIGINT) AS rn, CAST(stock_quantity AS BIGINT) AS stock, CAST(NULL AS BOOLEAN) AS applied
      FROM products WHERE product_id IN (SELECT product_id FROM d)
      UNION ALL
      SELECT f.product_id, d.rn, CASE WHEN f.stock + d.delta >= 0 THEN f.stock + d.delta ELSE f.stock END,
             f.stock + d.delta >= 0
      FROM f JOIN d ON d.product_id = f.product_id AND d.rn = f.rn + 1)
"""


@register("d9_stock_deltas", _FOLD_SQL + """
, fin AS (SELECT product_id, arg_max(stock, rn) AS stock FROM f GROUP BY product_id)
SELECT p.product_id, CAST(COALESCE(fin.stock, p.stock_quantity) AS BIGINT) AS stock_quantity
FROM products p LEFT JOIN fin ON fin.product_id = p.product_id""")
def q_d9(spark, d):
    r = CH.apply_stock_deltas(td.products(spark, d), _stock_deltas(spark, d), as_of=AS_OF)
    return r["target"].select("product_id", F.col("stock_quantity").cast("bigint").alias("stock_quantity"))


@register("d9_stock_decisions", _FOLD_SQL + """
SELECT d.product_id, d.seq, d.delta, f.applied FROM d JOIN f ON f.product_id = d.product_id AND f.rn = d.rn
UNION ALL
SELECT product_id, seq, delta, false FROM deltas WHERE product_id NOT IN (SELECT product_id FROM products)""")
def q_d9_dec(spark, d):
    return CH.apply_stock_deltas(td.products(spark, d), _stock_deltas(spark, d))["decisions"]


# ---------------------------------------------------------------------------
# Create products; D12 / J7 / W5: upsert from a file, last wins
# ---------------------------------------------------------------------------

def _new_products(spark, d):
    s = td.read_table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("_src"), F.col("s_name").alias("name"),
        F.lit("supplier bundle").alias("description"), F.lit("BUNDLE").alias("category"),
        F.lit("supplier").alias("subcategory"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).cast(S.MONEY).alias("price"),
        F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("int").alias("stock_quantity"),
        F.lit(None).cast("boolean").alias("is_active"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("updated_at"))


@register("d11_create_products", oracle(PROD + """
SELECT (SELECT MAX(product_id) FROM products) + ROW_NUMBER() OVER (ORDER BY s_suppkey) AS product_id,
       s_name AS name, CAST(s_acctbal AS DECIMAL(18,2)) AS price, 0 AS stock_quantity, true AS is_active
FROM supplier WHERE s_acctbal >= 0""", doubles=("price",), bigints=("stock_quantity",)))
def q_d11(spark, d):
    r = CH.create_rows(td.products(spark, d), _new_products(spark, d), "product_id", ["_src"],
                       required=["name", "price"], defaults={"stock_quantity": 0, "is_active": True})
    return r["created"].select("product_id", "name", "price", "stock_quantity", "is_active")


def _import_rows(spark, d):
    """An import file: one row per event, keyed by an existing order
    (updates) or, for signups, a new key; several rows per key."""
    e = _events(spark, d)
    key = F.when(F.col("event_type") == "signup", F.col("user_id") * 100 + F.col("k") + 10 ** 6) \
        .otherwise(F.col("user_id") * 100 + F.col("k"))
    return e.select(
        key.alias("order_id"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"), F.concat(F.lit("Customer#"), F.col("user_id")).alias("customer_name"),
        F.to_date("ts").alias("order_date"), F.col("k").cast("int").alias("quantity"),
        F.col("value").cast(S.MONEY).alias("subtotal_amount"), F.lit(0).cast(S.RATE).alias("tax_rate"),
        F.lit(0).cast(S.MONEY).alias("shipping_cost"), F.lit("IMPORT").alias("category"),
        F.col("props").alias("subcategory"))


_IMPORT_SQL = f"""{EV}, src AS (
  SELECT CASE WHEN event_type = 'signup' THEN user_id * 100 + k + 1000000 ELSE user_id * 100 + k END AS order_id,
         event_id AS seq, event_type AS status, 'Customer#' || CAST(user_id AS VARCHAR) AS customer_name,
         CAST(ts AS DATE) AS order_date, CAST(k AS INT) AS quantity, CAST(value AS DECIMAL(18,2)) AS subtotal_amount,
         CAST(0 AS DECIMAL(6,4)) AS tax_rate, CAST(0 AS DECIMAL(18,2)) AS shipping_cost,
         'IMPORT' AS category, props AS subcategory FROM ev),
last AS (SELECT * EXCLUDE (rn, seq) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn FROM src) t WHERE rn = 1)"""


@register("w5_last_per_key", oracle(f"WITH {_IMPORT_SQL}\nSELECT * FROM last", **ORDER_CASTS))
def q_w5(spark, d):
    return CH.last_per_key(_import_rows(spark, d), "order_id", "seq").drop("seq")


@register("d12_upsert", oracle(SO + f", {_IMPORT_SQL}\n" + """
SELECT * FROM so WHERE order_id NOT IN (SELECT order_id FROM last)
UNION ALL SELECT * FROM last""", **ORDER_CASTS))
def q_d12(spark, d):
    return CH.upsert(td.sales_orders(spark, d), _import_rows(spark, d), "order_id", seq="seq")["target"]


@register("d12_upsert_report", SO + f", {_IMPORT_SQL}\n" + """
SELECT COUNT(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM so)) AS inserted,
       COUNT(*) FILTER (WHERE order_id IN (SELECT order_id FROM so)) AS updated FROM last""")
def q_d12_rep(spark, d):
    return CH.upsert(td.sales_orders(spark, d), _import_rows(spark, d), "order_id", seq="seq")["report"].drop("rejected")


@register("d12_queue_report", SO + f", {_IMPORT_SQL}\n" + """
, q AS (SELECT * REPLACE (CASE WHEN seq % 13 <> 0 THEN seq // 30 END AS seq) FROM src),
k AS (SELECT DISTINCT order_id FROM q WHERE seq IS NOT NULL)
SELECT COUNT(*) FILTER (WHERE order_id NOT IN (SELECT order_id FROM so)) AS inserted,
       COUNT(*) FILTER (WHERE order_id IN (SELECT order_id FROM so)) AS updated,
       (SELECT COUNT(*) FROM q WHERE seq IS NULL) AS rejected FROM k""")
def q_d12_queue_rep(spark, d):
    """Every file row without a place is counted as rejected."""
    return CH.upsert(td.sales_orders(spark, d), _unplaced(_import_rows(spark, d)), "order_id", seq="seq")["report"]


@register("p17_create_rejects", f"WITH {_NEW_ORDERS_SQL}\n" + """
, v AS (SELECT customer_order_id, CASE WHEN customer_order_id % 5 = 0 THEN -quantity ELSE quantity END AS quantity,
               CASE WHEN customer_order_id % 9 <> 0 THEN subtotal_amount ELSE -1 END AS subtotal_amount FROM new_rows)
SELECT customer_order_id, concat_ws('; ', CASE WHEN quantity IS NULL THEN 'missing: quantity' END,
         CASE WHEN quantity < 0 OR subtotal_amount < 0 THEN 'negative: ' || concat_ws(',', CASE WHEN quantity < 0 THEN 'quantity' END,
              CASE WHEN subtotal_amount < 0 THEN 'subtotal_amount' END) END) AS reason
FROM v WHERE quantity IS NULL OR quantity < 0 OR subtotal_amount < 0""")
def q_p17_create(spark, d):
    """Creates that break a NOT NULL or >= 0 constraint, with all that they break."""
    i = F.col("customer_order_id")
    rows = (_new_orders(spark, d).withColumn("quantity", F.when(i % 5 == 0, -F.col("quantity")).otherwise(F.col("quantity")))
            .withColumn("subtotal_amount", F.when(i % 9 != 0, F.col("subtotal_amount")).otherwise(F.lit(-1).cast(S.MONEY))))
    out = CH.create_rows(td.sales_orders(spark, d), rows, "order_id", ["order_date", "customer_order_id"],
                         required=["customer_name", "quantity", "subtotal_amount"], not_negative=S.NUMERIC_FIELDS)
    return out["rejects"].select("customer_order_id", "reason")


_DELTA_SQL = _CMD_TARGET.replace("\nSELECT s.order_id,", ", new_t AS (SELECT s.order_id,", 1) + """)
, touched AS (SELECT oid, MAX(seq) AS lseq FROM (SELECT oid, seq FROM applied UNION ALL SELECT order_id, seq FROM created) u
              GROUP BY oid)
SELECT n.order_id, 'upsert' AS op, t.lseq AS seq, n.status, n.customer_name, CAST(n.order_date AS VARCHAR) AS order_date,
       CAST(n.quantity AS BIGINT) AS quantity, CAST(n.subtotal_amount AS DOUBLE) AS subtotal_amount,
       CAST(n.tax_rate AS DOUBLE) AS tax_rate, CAST(n.shipping_cost AS DOUBLE) AS shipping_cost, n.category, n.subcategory
FROM new_t n JOIN touched t ON t.oid = n.order_id
UNION ALL
SELECT d.oid, 'delete', k.seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM died d JOIN state s ON s.order_id = d.oid AND s.born = -1 JOIN dels k ON k.oid = d.oid AND k.pos = d.died"""


@register("r2_commands_delta", _DELTA_SQL)
def q_r2_delta(spark, d):
    """The batch's touched rows only (what a MERGE or the change log takes)."""
    return _apply_cmds(spark, d)["delta"]


# -- W4 / D2: ids of creates agree in table, feed and delta ----------------

def _create_commands(spark, d):
    """One create command per line item, in no order."""
    li = td.read_table(spark, d, "lineitem")
    payload = F.concat(F.lit('{"customer_name": "c'), "l_suppkey", F.lit('", "quantity": "'), F.col("l_quantity").cast("int"),
                       F.lit('", "subtotal_amount": "'), F.col("l_extendedprice").cast("decimal(18,2)"),
                       F.lit('", "category": "'), "l_partkey", F.lit('", "subcategory": "'), "l_linenumber", F.lit('"}'))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"),
                     F.lit("create_order").alias("action"), payload.alias("data"))


@register("w4_create_ids_agree", SO + """
, c AS (SELECT l_orderkey * 10 + l_linenumber AS seq,
               '{"customer_name": "c' || l_suppkey || '", "quantity": "' || CAST(l_quantity AS INT) || '", "subtotal_amount": "'
               || CAST(l_extendedprice AS DECIMAL(18,2)) || '", "category": "' || l_partkey || '", "subcategory": "'
               || l_linenumber || '"}' AS payload, CAST(l_extendedprice AS DECIMAL(18,2)) AS subtotal FROM lineitem),
n AS (SELECT (SELECT MAX(order_id) FROM so) + ROW_NUMBER() OVER (ORDER BY seq, payload) AS order_id, seq, subtotal FROM c)
SELECT order_id, seq, CAST(subtotal AS DOUBLE) AS in_table, CAST(subtotal AS DOUBLE) AS in_feed,
       CAST(subtotal AS DOUBLE) AS in_delta FROM n""")
def q_w4_agree(spark, d):
    out = CH.apply_order_commands(td.sales_orders(spark, d), _create_commands(spark, d), as_of="2024-06-01 00:00:00")
    feed = out["changes"].select("order_id", "seq", F.get_json_object("data", "$.subtotal_amount").cast("decimal(18,2)")
                                 .alias("in_feed"))
    table = out["target"].select("order_id", F.col("subtotal_amount").alias("in_table"))
    delta = out["delta"].select("order_id", F.col("subtotal_amount").alias("in_delta"))
    return feed.join(table, "order_id", "left").join(delta, "order_id", "left")
