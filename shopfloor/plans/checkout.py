"""A batch of checkouts as one job with five outputs.

C3 validation -> C4 customer orders, C5 order items, C6 guarded stock
decrement, C7 one ``orders`` row per line, and the rejects.  The accepted,
priced lines feed four outputs, so they are checkpointed once to the
shared checkpoint folder (reliable: a lost executor does not re-derive
different ids).

Stock semantics: by default carts compete in checkout order, each
validated against the stock left by the carts accepted before it, as when
the reference checks each checkout against the live table.  The snapshot
mode validates all carts against the starting stock instead; decrements
then run with the reference's guard (never below zero) and every skipped
decrement is reported (N8: the reference stores such an order anyway).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import rules as R
from ..functions.columns import as_of_date, as_of_timestamp, payment_status
from ..operators import carts as K
from ..operators.changes import apply_stock_deltas
from ..operators.ids import dense_ids, next_id
from ..session import checkpoint_dir


def checkout(lines: DataFrame, requests: DataFrame, products: DataFrame, customer_orders: DataFrame,
             order_items: DataFrame, orders: DataFrame, as_of: str | None = None,
             exact_split: bool = False, reliable: bool = True,
             mode: str = "sequential") -> dict[str, DataFrame]:
    """Turn cart lines + checkout requests into the store tables.

    ``lines``: (session_id, product_id, quantity), e.g. from
    :func:`shopfloor.operators.carts.fold_carts`.  ``requests``: the
    ``CHECKOUT_REQUESTS`` schema (one per session; ``seq`` orders them).
    ``mode="sequential"`` (default, the reference's semantics) accepts
    carts in checkout order only when all their lines fit the stock left
    by earlier accepted carts (:func:`carts.sequential_acceptance`);
    ``mode="snapshot"`` validates every cart against the starting stock
    in one pass and lets the guarded decrement catch oversell (reported).
    Returns ``customer_orders_new``, ``order_items_new``, ``products``
    (stock after), ``orders_new``, ``rejects`` and ``report``.
    """
    ts = as_of_timestamp(as_of)
    if reliable:
        # the folded lines feed pricing, validation and all outputs:
        # materialise them once in the shared checkpoint folder
        checkpoint_dir(lines.sparkSession)
        lines = lines.checkpoint(eager=True)
    priced = K.price_lines(lines, products)
    totals = K.cart_totals(priced)
    rules = R.customer_info_rules(requests.schema)
    req = requests.withColumn("_info_errors", R.violations(rules))
    if mode == "sequential":
        # only carts that pass the other checks compete for stock
        eligible = req.filter(F.size("_info_errors") == 0).select(*requests.columns)
        acc = K.sequential_acceptance(lines, eligible, products)
        valid = (lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("line_count"))
                 .join(acc.select("session_id", F.col("accepted").alias("ok")), "session_id", "left")
                 .withColumn("ok", F.coalesce("ok", F.lit(True)))
                 .withColumn("reason", F.when(~F.col("ok"), F.lit("insufficient stock"))))
    else:
        valid = K.validate_carts(lines, products)

    # One decision per request
    dec = (req.join(valid, "session_id", "left")
           .withColumn("reason", F.when(F.col("line_count").isNull(), F.lit("Cart is empty"))
                       .when(F.size("_info_errors") > 0,
                             F.concat(F.lit("invalid customer info: "), F.array_join("_info_errors", ",")))
                       .otherwise(F.col("reason"))))
    rejects = dec.filter(F.col("reason").isNotNull()).select("session_id", "seq", "reason")
    accepted = dec.filter(F.col("reason").isNull()).select(*requests.columns)

    # C4: customer orders, ids max + 1 ... in request order
    heads = accepted.join(totals, "session_id")
    heads = dense_ids(heads, ["seq", "session_id"], "customer_order_id",
                      base=next_id(customer_orders, "customer_order_id"))
    co_new = heads.select(
        "customer_order_id", "customer_name", "customer_email", "customer_phone", "shipping_address",
        "shipping_city", "shipping_state", "shipping_zip",
        F.coalesce("shipping_country", F.lit("USA")).alias("shipping_country"),
        F.col("subtotal").alias("subtotal_amount"), "tax_amount", "shipping_cost",
        F.col("total").alias("total_amount"), F.lit("pending").alias("status"),
        F.coalesce("payment_method", F.lit("simulated")).alias("payment_method"),
        payment_status(F.coalesce("payment_method", F.lit("simulated"))).alias("payment_status"),
        ts.alias("order_date"), "notes", "session_id")

    # Everything below is built on first access: asking only for the
    # customer orders does not materialise the lines or assign item ids.
    def acc_lines():
        al = (priced.join(heads.select("session_id", "seq", "customer_order_id", "customer_name",
                                       "tax_rate", "shipping_cost", "line_count"), "session_id"))
        al = K.shipping_shares(al.drop("shipping_cost", "line_count"),
                               totals.join(heads.select("session_id"), "session_id"),
                               exact_split=exact_split)
        if reliable:          # used by C5, C6 and C7: materialise once
            checkpoint_dir(lines.sparkSession)
            al = al.checkpoint(eager=True)
        return al

    def items_new(o):
        items = dense_ids(o["_acc_lines"].select("customer_order_id", "product_id", "product_name",
                                                 "product_price", "quantity", "subtotal"),
                          ["customer_order_id", "product_id"], "order_item_id",
                          base=next_id(order_items, "order_item_id"))
        return items.select("order_item_id", "customer_order_id", "product_id", "product_name",
                            "product_price", F.col("quantity").cast("int").alias("quantity"),
                            "subtotal", ts.alias("created_at"))

    def stock(o):           # C6: guarded decrement in checkout order
        deltas = o["_acc_lines"].select("product_id", "seq",
                                        (-F.col("quantity")).alias("delta"))
        return apply_stock_deltas(products, deltas, as_of=as_of)

    def orders_new(o):      # C7: one orders row per line
        orows = dense_ids(o["_acc_lines"].select("seq", "product_id", "customer_name", "quantity", "subtotal",
                                                 "tax_rate", "shipping_share", "product_name"),
                          ["seq", "product_id"], "order_id", base=next_id(orders, "order_id"))
        return orows.select(
            "order_id", F.lit(S.STORE_ORDER_STATUS).alias("status"), "customer_name",
            as_of_date(as_of).alias("order_date"), F.col("quantity").cast("int").alias("quantity"),
            F.col("subtotal").alias("subtotal_amount"), F.col("tax_rate").cast(S.RATE).alias("tax_rate"),
            F.col("shipping_share").alias("shipping_cost"), F.lit(S.STORE_ORDER_CATEGORY).alias("category"),
            F.col("product_name").alias("subcategory"))

    def report(o):
        return (co_new.agg(F.lit("orders_created").alias("metric"), F.count(F.lit(1)).alias("value"))
                .unionByName(rejects.agg(F.lit("checkouts_rejected").alias("metric"),
                                         F.count(F.lit(1)).alias("value")))
                .unionByName(o["_stock"]["decisions"].agg(F.lit("decrements_skipped").alias("metric"),
                                                          F.count_if(~F.col("applied")).alias("value"))))

    return LazyOutputs(
        {"customer_orders_new": co_new, "rejects": rejects},
        {"_acc_lines": lambda o: acc_lines(), "order_items_new": items_new, "_stock": stock,
         "products": lambda o: o["_stock"]["target"], "orders_new": orders_new, "report": report})


class LazyOutputs(dict):
    """A dict of job outputs whose expensive members are built on first
    access (and once).  Keys starting with ``_`` are shared internals."""

    def __init__(self, ready: dict, builders: dict):
        super().__init__(ready)
        self._builders = builders

    def __getitem__(self, key):
        if not dict.__contains__(self, key) and key in self._builders:
            dict.__setitem__(self, key, self._builders[key](self))
        return dict.__getitem__(self, key)

    def __contains__(self, key):
        return dict.__contains__(self, key) or key in self._builders

    def keys(self):
        return [k for k in list(dict.keys(self)) + list(self._builders) if not k.startswith("_")]
