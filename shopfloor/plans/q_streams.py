"""Registered streaming queries.

Each runs a real Structured Streaming query with ``availableNow`` over the
test tables (file source), writes to a sink under the shared checkpoint
folder, waits for it, and returns the sink read back as a DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import changes as CH
from ..sources import files as FS
from ..sources import testdata as td
from ..streaming import daily as DY
from ..streaming import jobs as J
from .q_changes import _CMD_CHANGES, _CMD_TARGET, ORDER_CASTS
from .q_carts import CART_FOLD
from .registered import SO, oracle, register

AS_OF = "2024-06-01 00:00:00"
ORDERS_SRC = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, " \
             "o_orderdate timestamp_ntz, o_orderpriority string"
EVENTS_SRC = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _orders_stream(spark, d):
    """Stream of the ``orders`` table mapped to the order schema (stream-
    static join with ``customer``)."""
    o = J.file_stream(spark, d, ORDERS_SRC, glob="orders.parquet")
    c = td.read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", "Order Finished").when(F.col("o_orderstatus") == "O", "Pending")
         .otherwise("processing").alias("status"),
        F.col("c_name").alias("customer_name"),
        F.col("o_totalprice").cast(S.MONEY).alias("subtotal_amount"),
        F.col("c_mktsegment").alias("category"))


def _run_append(spark, df, name, mode="append"):
    base = J.run_dir(spark, name)
    out = os.path.join(base, "out")
    q = (df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", os.path.join(base, "ckpt")).option("path", out)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@register("r1_dashboard_stream", SO + """
SELECT 'total' AS dimension, 'all' AS value, COUNT(*) AS order_count, CAST(SUM(subtotal_amount) AS DOUBLE) AS revenue FROM so
UNION ALL SELECT 'status', status, COUNT(*), CAST(SUM(subtotal_amount) AS DOUBLE) FROM so GROUP BY status
UNION ALL SELECT 'category', category, COUNT(*), CAST(SUM(subtotal_amount) AS DOUBLE) FROM so GROUP BY category""")
def q_r1(spark, d):
    agg = J.dashboard_counts(_orders_stream(spark, d))
    base = J.run_dir(spark, "dashboard")
    out = os.path.join(base, "out")
    q = J.start_dashboard(agg, out, os.path.join(base, "ckpt"), trigger={"availableNow": True})
    q.awaitTermination()
    return FS.read_latest(spark, out, "dashboard")


@register("r7_daily_summary_stream", """
WITH e AS (SELECT * FROM events), wm AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS w FROM e)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS status, COUNT(*) AS event_count,
       CAST(SUM(CAST(value AS DECIMAL(38,10))) AS DOUBLE) AS amount
FROM e GROUP BY 1, 2
HAVING CAST(MIN(date_trunc('day', ts)) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT w FROM wm)""")
def q_r7(spark, d):
    ev = J.file_stream(spark, d, EVENTS_SRC, glob="events.parquet")
    res = _run_append(spark, J.daily_summary(ev), "daily")
    return res.select(F.col("day").cast("string").alias("day"), "status", "event_count", "amount")


@register("r7_summary_events", """
WITH e AS (SELECT * FROM events), wm AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS w FROM e)
SELECT 'report.daily_summary' AS event_type, 'shopfloor' AS source, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
       event_type AS status, COUNT(*) AS event_count
FROM e GROUP BY date_trunc('day', ts), event_type
HAVING CAST(MIN(date_trunc('day', ts)) + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT w FROM wm)""")
def q_r7_events(spark, d):
    """The closed days as report.daily_summary envelopes."""
    ev = J.file_stream(spark, d, EVENTS_SRC, glob="events.parquet")
    out = J.daily_summary_events(_run_append(spark, J.daily_summary(ev), "daily-events"), F.lit(AS_OF).cast("timestamp"))
    return out.select("event_type", "source", F.get_json_object("data", "$.day").alias("day"),
                      F.get_json_object("data", "$.status").alias("status"),
                      F.get_json_object("data", "$.event_count").cast("long").alias("event_count"))


# Events in five deliveries, each eleventh two deliveries later than its neighbours.
_LATE = """d AS (SELECT *, event_id * 3 // (SELECT MAX(event_id) + 1 FROM events) + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 0 END AS n FROM events),
b AS (SELECT n, MAX(MAX(ts)) OVER (ORDER BY n) - INTERVAL 1 HOUR AS w FROM d GROUP BY n),
e AS (SELECT d.event_type AS status, value, date_trunc('day', ts) AS day0, n FROM d),
placed AS (SELECT e.*, COALESCE(day0 + INTERVAL 1 DAY <= (SELECT MAX(w) FROM b WHERE b.n < e.n), FALSE) AS late FROM e),
ends AS (SELECT MAX(w) AS w FROM b)"""


@register("r7_late_rows", f"""WITH {_LATE}
SELECT CASE WHEN late THEN 'correction' ELSE 'closed' END AS part, strftime(day0, '%Y-%m-%d') AS day, status, COUNT(*) AS event_count,
       CAST(SUM(CAST(value AS DECIMAL(38,10))) AS DOUBLE) AS amount
FROM placed WHERE day0 + INTERVAL 1 DAY <= (SELECT w FROM ends) GROUP BY late, day0, status""")
def q_r7_late(spark, d):
    """Days as they were closed, and what rows that came later add to them: together all rows of closed days."""
    base = J.run_dir(spark, "daily-late")
    src, state = os.path.join(base, "in"), os.path.join(base, "state")
    ev = td.read_table(spark, d, "events")
    top = ev.agg(F.max("event_id")).first()[0] + 1
    n = F.expr(f"event_id * 3 div {top}") + F.when(F.col("event_id") % 11 == 0, 2).otherwise(0)
    for i in range(5):
        ev.where(n == i).write.mode("append").parquet(src)
        rows = spark.readStream.schema(ev.schema).parquet(src).select(
            J.event_time("ts").alias("t"), F.col("event_type").alias("status"), F.col("value").alias("amount"))
        DY.start_daily_summary(rows, state, trigger={"availableNow": True}).awaitTermination()
    closed = DY.closed_days(spark, state).withColumn("part", F.lit("closed"))
    late = DY.corrections(spark, state).withColumn("part", F.lit("correction"))
    return closed.unionByName(late).groupBy("part", F.col("day").cast("string").alias("day"), "status").agg(
        F.sum("event_count").alias("event_count"), F.sum("amount").cast("double").alias("amount"))


def _command_stream_target(spark, d):
    base = J.run_dir(spark, "commands")
    src = os.path.join(base, "queue")
    td.order_commands(spark, d).write.json(src)            # the queued messages
    cmds = J.file_stream(spark, src, "seq long, action string, data string", fmt="json")
    q = J.start_command_stream(spark, cmds, os.path.join(base, "state"), td.sales_orders(spark, d),
                               as_of=AS_OF, trigger={"availableNow": True})
    q.awaitTermination()
    return J.current_orders(spark, os.path.join(base, "state"))


@register("r2_changelog_stream_view", oracle(_CMD_TARGET, **ORDER_CASTS))
def q_r2_log(spark, d):
    """The command stream in the changelog layout: per batch only touched
    rows are written; the view overlays them on the snapshot."""
    base = J.run_dir(spark, "changelog")
    src = os.path.join(base, "queue")
    td.order_commands(spark, d).write.json(src)
    cmds = J.file_stream(spark, src, "seq long, action string, data string", fmt="json")
    snap = td.sales_orders(spark, d)
    q = J.start_command_stream(spark, cmds, os.path.join(base, "state"), snap, as_of=AS_OF,
                               trigger={"availableNow": True}, layout="changelog")
    q.awaitTermination()
    return J.changelog_view(spark, os.path.join(base, "state"), snap)


def _redelivered(spark, d):
    """The queue in three deliveries, each message once to three times: again in
    the same delivery, again in a later one."""
    base = J.run_dir(spark, "redelivered")
    src = os.path.join(base, "queue")
    cmds = td.order_commands(spark, d).withColumn("sent_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    top = cmds.agg(F.max("seq")).first()[0] + 1
    third = F.expr(f"seq * 3 div {top}")
    schema = "seq long, action string, data string, sent_at timestamp"
    snap = os.path.join(base, "snapshot")
    td.sales_orders(spark, d).write.parquet(snap)          # searched by each trigger, so built once
    snap = spark.read.parquet(snap)
    for n in range(3):
        new = cmds.where(third == n)
        again = new.where(F.col("seq") % 3 == 0).unionByName(cmds.where((third < n) & (F.col("seq") % 2 == 0)))
        new.unionByName(again).write.mode("append").json(src)
        q = J.start_command_stream(spark, J.file_stream(spark, src, schema, fmt="json"), os.path.join(base, "state"), snap,
                                   as_of=AS_OF, trigger={"availableNow": True}, layout="changelog", message_id="seq")
        q.awaitTermination()
    return os.path.join(base, "state"), snap


@register("r2_redelivered_stream_view", oracle(_CMD_TARGET, **ORDER_CASTS))
def q_r2_redelivered(spark, d):
    """Messages delivered up to three times over three triggers give the table of the plain queue."""
    state, snap = _redelivered(spark, d)
    return J.changelog_view(spark, state, snap)


@register("r2_redelivered_changes", _CMD_CHANGES)
def q_r2_redelivered_changes(spark, d):
    state, _ = _redelivered(spark, d)
    return spark.read.parquet(os.path.join(state, "changes")).drop("batch")


@register("r2_command_stream_target", oracle(_CMD_TARGET, **ORDER_CASTS))
def q_r2s(spark, d):
    return _command_stream_target(spark, d)


_DIFF_SQL = _CMD_TARGET.replace("\nSELECT s.order_id,", ", new_t AS (SELECT s.order_id,", 1) + """)
SELECT COALESCE(o.order_id, n.order_id) AS order_id,
       CASE WHEN o.order_id IS NULL THEN 'created' WHEN n.order_id IS NULL THEN 'deleted' ELSE 'updated' END AS action,
       o.status AS old_status, n.status AS new_status
FROM so o FULL OUTER JOIN new_t n ON o.order_id = n.order_id
WHERE o.order_id IS NULL OR n.order_id IS NULL
   OR o.status IS DISTINCT FROM n.status OR o.customer_name IS DISTINCT FROM n.customer_name
   OR o.order_date IS DISTINCT FROM n.order_date OR o.quantity IS DISTINCT FROM n.quantity
   OR o.subtotal_amount IS DISTINCT FROM n.subtotal_amount OR o.tax_rate IS DISTINCT FROM n.tax_rate
   OR o.shipping_cost IS DISTINCT FROM n.shipping_cost OR o.category IS DISTINCT FROM n.category
   OR o.subcategory IS DISTINCT FROM n.subcategory"""


def _diff(spark, d):
    new = CH.apply_order_commands(td.sales_orders(spark, d), td.order_commands(spark, d), as_of=AS_OF)["target"]
    return J.diff_snapshots(td.sales_orders(spark, d), new, ts=F.lit(AS_OF).cast("timestamp_ntz"))


@register("r4_snapshot_diff", _DIFF_SQL.replace("       o.status AS old_status", f"""       CASE WHEN o.order_id IS NULL
            THEN 'success' WHEN n.order_id IS NULL THEN 'warning' ELSE 'info' END AS severity,
       TIMESTAMP '{AS_OF}' AS timestamp, o.status AS old_status""", 1))
def q_r4(spark, d):
    return _diff(spark, d).drop("row")


_PAYLOAD = {"status": "string", "customer_name": "string", "order_date": "string", "quantity": "bigint",
            "subtotal_amount": "double", "tax_rate": "double", "shipping_cost": "double", "category": "string",
            "subcategory": "string", "old_status": "string", "new_status": "string"}
_ROW_SQL = """n.customer_name, CAST(n.order_date AS VARCHAR) AS order_date, CAST(n.quantity AS BIGINT) AS quantity,
       CAST(n.subtotal_amount AS DOUBLE) AS subtotal_amount, CAST(n.tax_rate AS DOUBLE) AS tax_rate,
       CAST(n.shipping_cost AS DOUBLE) AS shipping_cost, n.category, n.subcategory"""


@register("r5_change_events", _DIFF_SQL.replace(
    "SELECT COALESCE(o.order_id, n.order_id) AS order_id,",
    f", diff AS (SELECT COALESCE(o.order_id, n.order_id) AS order_id, {_ROW_SQL},", 1)
    + f""")
SELECT 'order.' || action AS event_type, TIMESTAMP '{AS_OF}' AS timestamp, 'shopfloor' AS source, order_id,
       new_status AS status, customer_name, order_date, quantity, subtotal_amount, tax_rate, shipping_cost, category,
       subcategory, NULL AS old_status, NULL AS new_status FROM diff
UNION ALL
SELECT 'order.status_changed', TIMESTAMP '{AS_OF}', 'shopfloor', order_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       NULL, old_status, new_status FROM diff WHERE action = 'updated' AND old_status IS DISTINCT FROM new_status""")
def q_r5(spark, d):
    ev = J.change_events(_diff(spark, d), F.lit(AS_OF).cast("timestamp_ntz"))
    return ev.select("event_type", "timestamp", "source", _payload("order_id", "bigint"),
                     *[_payload(c, t) for c, t in _PAYLOAD.items()])


def _payload(name, kind):
    return F.get_json_object("data", f"$.{name}").cast(kind).alias(name)


@register("r5_bulk_status_events", SO + """
, asked AS (SELECT event_id AS batch_id, user_id * 100 + CAST(json_extract(props, '$.k') AS BIGINT) AS a,
                   CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events),
hits AS (SELECT batch_id, COUNT(*) AS n FROM (SELECT batch_id, a AS id FROM asked UNION SELECT batch_id, b FROM asked) u
         WHERE id IN (SELECT order_id FROM so) GROUP BY batch_id)
SELECT 'order.bulk_status_update' AS event_type, asked.batch_id, '[' || a || ',' || b || ']' AS order_ids,
       'shipped' AS new_status, COALESCE(n, 0) AS updated_count
FROM asked LEFT JOIN hits ON hits.batch_id = asked.batch_id""")
def q_r5_bulk(spark, d):
    k = F.get_json_object("props", "$.k")
    asked = td.read_table(spark, d, "events").select(
        F.col("event_id").alias("batch_id"),
        F.concat((F.col("user_id") * 100 + k.cast("long")).cast("string"), F.lit(", x, "), k).alias("ids"))
    ev = J.bulk_status_events(asked, td.sales_orders(spark, d), "shipped", F.lit(AS_OF).cast("timestamp_ntz"))
    return ev.select("event_type", "batch_id", _payload("order_ids", "string"), _payload("new_status", "string"),
                     _payload("updated_count", "bigint"))


@register("r6_high_value_alerts_stream", SO + """
SELECT 'order.high_value' AS event_type, order_id, 'shopfloor' AS source, CAST(subtotal_amount AS DOUBLE) AS amount,
       customer_name AS customer FROM so WHERE subtotal_amount > 450000""")
def q_r6(spark, d):
    alerts = J.high_value_alerts(_orders_stream(spark, d), 450000, F.current_timestamp())
    return _run_append(spark, alerts, "alerts").select("event_type", _payload("order_id", "bigint"), "source", _payload("amount", "double"),
                                                         _payload("customer", "string"))


@register("r6_low_stock_alerts", f"WITH products AS ({td.PRODUCTS_SQL})\n" + """
SELECT 'inventory.low_stock' AS event_type, product_id, name AS product, CAST(stock_quantity AS BIGINT) AS current_stock,
       CAST(5 AS BIGINT) AS threshold FROM products
WHERE stock_quantity < 5""")
def q_r6_low(spark, d):
    al = J.low_stock_alerts(td.products(spark, d), 5, F.lit(AS_OF).cast("timestamp_ntz"))
    return al.select("event_type", "product_id", _payload("product", "string"), _payload("current_stock", "bigint"),
                     _payload("threshold", "bigint"))


def _cart_actions_stream(spark, d):
    return _cart_actions(J.file_stream(spark, d, EVENTS_SRC, glob="events.parquet"))


def _cart_actions(ev):
    base = F.floor(F.col("value")).cast("int")
    et = F.col("event_type")
    return (ev.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("session_id"), F.col("event_id").alias("seq"),
        F.when(et == "click", "add").when(et == "purchase", "update").when(et == "error", "remove")
         .when(et == "signup", "clear").otherwise("view").alias("action"),
        F.when(et != "signup", F.get_json_object("props", "$.k").cast("long")).alias("product_id"),
        F.when(et == "click", base % 5 + 1).when(et == "purchase", base % 6 - 1).alias("quantity"),
        F.col("ts")))


@register("r8_cart_state_stream", CART_FOLD + """
, last_ts AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS session_id, MAX(ts) AS ts FROM events GROUP BY user_id),
wm AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS w FROM events)
SELECT l.session_id, l.product_id, CAST(l.quantity AS BIGINT) AS quantity
FROM lines l JOIN last_ts t ON t.session_id = l.session_id
WHERE t.ts + INTERVAL 7 DAY >= (SELECT w FROM wm)     -- carts idle 7 days by the end expire""")
def q_r8(spark, d):
    """Cart lines as left by the stateful stream: for each session the rows
    of the last trigger that emitted it, unless that emission is the
    7-day expiry.  Update mode appends each trigger's changes to parquet."""
    st = J.cart_state_stream(_cart_actions_stream(spark, d), td.products(spark, d))
    base = J.run_dir(spark, "carts")
    out = os.path.join(base, "out")

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
    q = (st.writeStream.outputMode("update").option("checkpointLocation", os.path.join(base, "ckpt"))
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    emitted = spark.read.parquet(out)
    last = emitted.groupBy("session_id").agg(F.max("batch_id").alias("batch_id"))
    return (emitted.join(last, ["session_id", "batch_id"]).filter(~F.col("expired") & F.col("quantity").isNotNull())
            .select("session_id", "product_id", F.col("quantity").cast("bigint").alias("quantity")))


# Weekly sessions in five deliveries: each fifth action comes one delivery later
# than its neighbours, each seventh a second time.
_DELIVERED = """SELECT event_id, user_id, ts, 'u' || user_id || '-' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS session_id,
       event_id * 4 // (SELECT MAX(event_id) + 1 FROM events) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS delivery FROM events"""
_TRIGGERS_SQL = CART_FOLD.replace("cart_events AS (", f"""delivered AS ({_DELIVERED}),
cart_events AS (SELECT d.session_id, e.* EXCLUDE (session_id) FROM delivered d JOIN (""", 1).replace(
    "),\npairs AS", ") e ON e.seq = d.event_id),\npairs AS", 1).replace("\ns AS (SELECT st.*", """\nplaced AS (
  SELECT st.*, delivery, MIN(CASE WHEN action <> 'view' THEN delivery END) OVER (PARTITION BY st.session_id, st.product_id
         ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
  FROM stream st JOIN delivered d ON d.event_id = st.seq),
s AS (SELECT st.*""", 1).replace("FROM stream st LEFT JOIN", "FROM (SELECT * FROM placed WHERE later IS NULL OR later >= delivery) st LEFT JOIN", 1)


def _cart_triggers(spark, d):
    base = J.run_dir(spark, "cart-triggers")
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    top = td.read_table(spark, d, "events").agg(F.max("event_id")).first()[0] + 1
    i = F.col("seq")
    acts = _cart_actions(td.read_table(spark, d, "events")).withColumn(
        "session_id", F.concat("session_id", F.lit("-"), F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")))
    delivery = F.expr(f"seq * 4 div {top}") + F.when(i % 5 == 0, 1).otherwise(0)

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
    for n in range(5):
        acts.where((delivery == n) | ((i % 7 == 0) & (delivery == n - 1))).write.mode("append").parquet(src)
        st = J.cart_state_stream(spark.readStream.schema(acts.schema).parquet(src), td.products(spark, d), delay="10 days")
        q = (st.writeStream.outputMode("update").option("checkpointLocation", os.path.join(base, "ckpt"))
             .foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out)


@register("r8_cart_state_triggers", _TRIGGERS_SQL + """
, last_ts AS (SELECT session_id, MAX(ts) AS ts FROM delivered GROUP BY session_id),
wm AS (SELECT MAX(ts) - INTERVAL 10 DAY AS w FROM events)
SELECT l.session_id, l.product_id, CAST(l.quantity AS BIGINT) AS quantity, t.ts + INTERVAL 7 DAY <= (SELECT w FROM wm) AS expired
FROM lines l JOIN last_ts t ON t.session_id = l.session_id""")
def q_r8_triggers(spark, d):
    """Carts over five triggers, with clears, expired sessions, older event times in
    later deliveries, actions delivered twice, and some too late to be applied."""
    emitted = _cart_triggers(spark, d)
    last = emitted.groupBy("session_id").agg(F.max("batch_id").alias("batch_id"))
    return (emitted.join(last, ["session_id", "batch_id"]).filter(F.col("quantity").isNotNull())
            .select("session_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"), "expired"))
