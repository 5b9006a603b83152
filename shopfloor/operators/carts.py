"""Carts and checkout.

Cart actions per session arrive as rows ``(session_id, seq, action,
product_id, quantity)`` with action add | update | remove | clear.  The
reference applies them one by one to a cart kept in a web session; here a
whole batch of carts is folded at once.

C1 fold semantics (per session, in ``seq`` order):
* add q: product must exist and be active, q > 0, and the new line
  quantity (old + q) must not exceed stock; otherwise rejected.
* update q: q <= 0 removes the line; otherwise the line must exist and
  q must not exceed stock (activity is not re-checked); else rejected.
* remove: drops the line (no error if absent); clear: empties the cart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .._shipping import ship_by_value as _ship_by_value
from ..functions.columns import line_subtotal, shipping_tier
from ..session import checkpoint_dir
from .prefix import BLOCK_ROWS, in_blocks, running_sums


# The Python fold below runs inside executors; ship this module's code by
# value so executors do not need the package installed.
_ship_by_value(__name__)


# ---------------------------------------------------------------------------
# the sequential step, shared by the streaming fold and the tests
# ---------------------------------------------------------------------------

def cart_step(lines: dict, action: str, pid, q, exists: bool, active: bool, stock) -> str | None:
    """Apply one action to ``lines`` (product -> quantity) in place.

    Returns None when accepted, else the rejection reason."""
    if action == "clear":
        lines.clear()
        return None
    if action == "remove":
        lines.pop(pid, None)
        return None
    if action == "add":
        if not exists:
            return "product not found"
        if not active:
            return "product not available"
        if q is None or q <= 0:
            return "quantity must be positive"
        new = lines.get(pid, 0) + q
        if stock is None or stock < new:
            return "insufficient stock"
        lines[pid] = new
        return None
    if action == "update":
        if q is None or q <= 0:
            lines.pop(pid, None)
            return None
        if pid not in lines:
            return "product not in cart"
        if not exists or stock is None or stock < q:
            return "insufficient stock"
        lines[pid] = q
        return None
    return "unknown action"


_OUTCOME_SCHEMA = "session_id string, seq long, action string, product_id long, accepted boolean, reason string"
_LINES_SCHEMA = "session_id string, product_id long, quantity int"


def _fold_lines(batches, emit_lines: bool):
    """Stream rows sorted by key, then order; the state is one cart line.

    Between two clears of a session (an epoch) the actions on one product
    depend on each other alone."""
    import pandas as pd
    cur, lines = None, {}
    out = []

    def flush():
        out.extend((cur[0], pid, q) for pid, q in lines.items())

    for pdf in batches:
        res = []
        for r in pdf.itertuples(index=False):
            pid = None if pd.isna(r.product_id) else int(r.product_id)
            key = (r.session_id, r.epoch, pid)
            if key != cur:
                flush()
                cur, lines = key, {}
            q = None if pd.isna(r.quantity) else int(r.quantity)
            stock = None if pd.isna(r.p_stock) else int(r.p_stock)
            why = cart_step(lines, r.action, pid, q, bool(r.p_exists), bool(r.p_active), stock)
            if not emit_lines:
                res.append((r.session_id, int(r.seq), r.action, pid, why is None, why))
        if emit_lines:
            yield pd.DataFrame(out, columns=["session_id", "product_id", "quantity"])
            out = []
        else:
            out = []
            yield pd.DataFrame(res, columns=["session_id", "seq", "action", "product_id", "accepted", "reason"]).astype({"product_id": "Int64"})
    flush()
    if emit_lines and out:
        yield pd.DataFrame(out, columns=["session_id", "product_id", "quantity"])


def _with_product(events: DataFrame, products: DataFrame) -> DataFrame:
    p = products.select(F.col("product_id").alias("_pid"), F.col("stock_quantity").alias("_stock"),
                        F.col("is_active").alias("_active"), F.lit(True).alias("_exists"))
    return (events.join(p, events.product_id == p._pid, "left").drop("_pid")
            .withColumn("_exists", F.coalesce("_exists", F.lit(False)))
            .withColumn("_active", F.coalesce("_active", F.lit(False))))


LINE = ["session_id", "epoch", "product_id"]


def _sorted_fold(ev: DataFrame, emit_lines: bool) -> DataFrame:
    n = max(1, int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    cols = ["session_id", "epoch", "seq", "action", "product_id", "quantity",
            F.col("_stock").alias("p_stock"), F.col("_active").alias("p_active"),
            F.col("_exists").alias("p_exists")]
    # total order (ties on seq broken by the row itself): a recomputed task
    # after a lost executor folds the rows in exactly the same order
    srt = ev.select(*cols).repartition(n, *LINE).sortWithinPartitions(*LINE, "seq", "action", "quantity")
    return srt.mapInPandas(lambda it: _fold_lines(it, emit_lines),
                           _LINES_SCHEMA if emit_lines else _OUTCOME_SCHEMA)


def with_epochs(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``events`` with ``epoch``: the clears of the session up to each action.

    Order: seq, then action, product and quantity.  The clears are counted by
    blocks, so a session with very many actions is counted by many tasks."""
    order = ["session_id", "seq", "action", "product_id", "quantity"]
    return running_sums(in_blocks(events, order, block_rows), ["session_id"],
                        epoch=F.when(F.col("action") == "clear", 1)).drop("_pid", "_blk", "_row")


def cart_event_outcomes(events: DataFrame, products: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per action: accepted or the rejection reason (exact sequential fold).

    A clear empties the whole cart, so it ends an epoch; within an epoch the
    products of a session don't influence each other.  Rows are therefore
    hash-partitioned by (session, epoch, product), sorted by ``seq`` and
    folded by a streaming ``mapInPandas`` that keeps one cart line in memory.
    Clears are accepted as they are; actions without a ``seq`` are rejected.
    """
    cols = ["session_id", "seq", "action", "product_id", "quantity"]
    unplaced = events.filter(F.col("seq").isNull()).select(
        "session_id", "seq", "action", "product_id", F.lit(False).alias("accepted"), F.lit("no seq").alias("reason"))
    placed = events.filter(F.col("seq").isNotNull()).select(*cols)
    clears = placed.filter(F.col("action") == "clear").select(
        "session_id", "seq", "action", "product_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"))
    rest = with_epochs(placed, block_rows).filter(F.col("action").isNull() | (F.col("action") != "clear"))
    folded = _sorted_fold(_with_product(rest, products), emit_lines=False)
    return folded.unionByName(clears).unionByName(unplaced)


def fold_carts(events: DataFrame, products: DataFrame) -> DataFrame:
    """The cart lines ``(session_id, product_id, quantity)`` after all actions.

    Only the actions after a session's last clear count, and there each
    product is a case of its own.

    Fast path (exact, set-based): when a (session, product) can never hit
    the stock limit -- its largest update plus all its adds fit in stock
    -- the fold reduces to "state after the last reset", computed with
    combinable aggregates and joins of one row per key:
    L = last unconditional reset (remove, update <= 0);
    F = first valid add after L (before it updates are rejected: absent);
    U = last update from F on (at equal seq adds come first, then removes,
    then updates by quantity);
    quantity = q(U) + adds after U, or the adds after L when no U.
    The (session, product) pairs where stock may bind go through the
    streaming sequential fold instead (same semantics, exact); the other
    products of their sessions don't.  Actions without a ``seq`` are left
    out (:func:`cart_event_outcomes` rejects them).
    """
    ev = events.filter(F.col("seq").isNotNull())
    clears = (ev.filter(F.col("action") == "clear").groupBy(F.col("session_id").alias("_s"))
              .agg(F.max("seq").alias("_clear")))
    # at equal seq an add comes before a clear, the other actions after it
    after = (F.col("seq") > F.col("_clear")) | ((F.col("seq") == F.col("_clear")) & (F.col("action") > "clear"))
    ev = (ev.join(clears, F.col("session_id").eqNullSafe(F.col("_s")), "left")
          .filter((F.col("_clear").isNull() | after) & F.col("action").isin("add", "update", "remove") & F.col("product_id").isNotNull())
          .select("session_id", "seq", "action", "product_id", "quantity"))
    items = _with_product(ev, products)
    key = ["session_id", "product_id"]
    is_add = (F.col("action") == "add") & (F.col("quantity") > 0)
    is_upd = (F.col("action") == "update") & (F.col("quantity") > 0)
    is_reset = (F.col("action") == "remove") | ((F.col("action") == "update")
                                                & F.coalesce(F.col("quantity") <= 0, F.lit(True)))
    k1 = items.groupBy(*key).agg(
        F.max(F.when(is_reset, F.col("seq"))).alias("_L"),
        F.coalesce(F.sum(F.when(is_add, F.col("quantity"))), F.lit(0)).alias("_adds"),
        F.coalesce(F.max(F.when(is_upd, F.col("quantity"))), F.lit(0)).alias("_maxupd"),
        F.first("_stock").alias("_stock"), F.first("_active").alias("_active"),
        F.first("_exists").alias("_exists"))
    sellable = F.col("_exists") & F.col("_active")
    risky = F.col("_maxupd") + F.col("_adds") > F.coalesce(F.col("_stock"), F.lit(-1))
    risky_keys = k1.filter(sellable & risky).select(*key)
    safe = k1.filter(sellable & ~risky).select(*key, "_L")

    # round 2: first add and last update after the last reset
    after_reset = items.join(safe, key).filter(F.col("_L").isNull() | (F.col("seq") > F.col("_L")))
    k2 = after_reset.groupBy(*key).agg(
        F.first("_L").alias("_L"),
        F.min(F.when(is_add, F.col("seq"))).alias("_F"),
        F.max(F.when(is_upd, F.col("seq"))).alias("_U"))
    k2 = k2.filter(F.col("_F").isNotNull()).withColumn(
        "_U", F.when(F.col("_U") >= F.col("_F"), F.col("_U")))
    # round 3: adds after the accepted update (or after the reset)
    k3 = (after_reset.join(k2.select(*key, "_U"), key)
          .groupBy(*key).agg(
              F.coalesce(F.sum(F.when(is_add & (F.col("_U").isNull() | (F.col("seq") > F.col("_U"))), F.col("quantity"))),
                         F.lit(0)).alias("_tail"),
              F.max(F.when(is_upd & (F.col("seq") == F.col("_U")), F.col("quantity"))).alias("_qU"),
              F.first("_U").alias("_U")))
    fast = k3.select(*key, (F.when(F.col("_U").isNotNull(), F.col("_qU")).otherwise(F.lit(0))
                            + F.col("_tail")).cast("int").alias("quantity")) \
        .filter(F.col("quantity") > 0)
    slow = _sorted_fold(items.join(risky_keys, key, "left_semi").withColumn("epoch", F.lit(0).cast("long")), emit_lines=True)
    return fast.unionByName(slow)


# ---------------------------------------------------------------------------
# pricing
# ---------------------------------------------------------------------------

def price_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """J8 + F9: lines with product name, price and subtotal (left join:
    lines of unknown products keep NULL price)."""
    p = products.select("product_id", F.col("name").alias("product_name"),
                        F.col("price").alias("product_price"), F.col("image_url").alias("product_image"))
    return (lines.join(p, "product_id", "left")
            .withColumn("subtotal", line_subtotal("product_price", "quantity")))


def cart_totals(priced: DataFrame, tax_rate: str = S.CART_TAX_RATE) -> DataFrame:
    """A24 + A25 per session: subtotal, tax, shipping tier, total, units.

    Like the reference, tax and total are exact until stored as
    numeric(18,2) (N7).  Sessions without lines get no row (N6)."""
    rate = F.lit(tax_rate).cast(S.RATE)
    t = priced.groupBy("session_id").agg(F.sum("subtotal").cast("decimal(28,2)").alias("subtotal"),
                                         F.sum("quantity").cast("bigint").alias("item_count"),
                                         F.count(F.lit(1)).alias("line_count"))
    tax = F.col("subtotal") * rate
    ship = shipping_tier("subtotal")
    return t.select("session_id", F.col("subtotal").cast(S.MONEY).alias("subtotal"),
                    rate.alias("tax_rate"), tax.cast(S.MONEY).alias("tax_amount"),
                    ship.alias("shipping_cost"), (F.col("subtotal") + tax + ship).cast(S.MONEY).alias("total"),
                    "item_count", "line_count")


# ---------------------------------------------------------------------------
# validation
# ---------------------------------------------------------------------------

def stock_check(lines: DataFrame, products: DataFrame) -> DataFrame:
    """P19 + P20 per line: found, active, stock >= wanted (NULL-safe)."""
    p = products.select("product_id", F.col("stock_quantity").alias("_stock"),
                        F.col("is_active").alias("_active"))
    j = lines.join(p, "product_id", "left")
    return (j.withColumn("found", F.col("_stock").isNotNull() | F.col("_active").isNotNull())
            .withColumn("purchasable", F.coalesce(F.col("_active"), F.lit(False)))
            .withColumn("stock_ok", F.coalesce(F.col("_stock") >= F.col("quantity"), F.lit(False)))
            .drop("_stock", "_active"))


def validate_carts(lines: DataFrame, products: DataFrame) -> DataFrame:
    """One row per cart: ``ok`` when every line has enough stock
    (checkout re-checks stock, not activity -- N14) and the cart is not
    empty; ``reason`` otherwise.  ``bool_and`` over the cart's lines."""
    chk = stock_check(lines, products)
    return (chk.groupBy("session_id")
            .agg(F.bool_and("stock_ok").alias("ok"), F.count(F.lit(1)).alias("line_count"))
            .withColumn("reason", F.when(~F.col("ok"), F.lit("insufficient stock"))))


# ---------------------------------------------------------------------------
# Derived rows
# ---------------------------------------------------------------------------

def shipping_shares(lines: DataFrame, totals: DataFrame, exact_split: bool = False) -> DataFrame:
    """The cart's shipping spread over its lines as numeric(18,2).

    Default: shipping / lines, each rounded (10 / 3 -> 3.33 x 3, a cent is
    lost, as in the reference).  ``exact_split``: the first line (by
    product id) takes the remainder.  The line count comes from the cart
    totals (an aggregate), not a window, so a huge cart is not one task.
    """
    j = lines.join(totals.select("session_id", F.col("shipping_cost").alias("_ship"), "line_count"),
                   "session_id")
    share = (F.col("_ship") / F.col("line_count")).cast(S.MONEY)
    if not exact_split:
        return j.withColumn("shipping_share", share).drop("_ship")
    first = j.groupBy("session_id").agg(F.min("product_id").alias("_first"))
    j = j.join(first, "session_id")
    rest = (F.col("_ship") - share * F.col("line_count")).cast(S.MONEY)
    return j.withColumn("shipping_share", F.when(F.col("product_id") == F.col("_first"), share + rest)
                        .otherwise(share).cast(S.MONEY)).drop("_ship", "_first")


# ---------------------------------------------------------------------------
# C3, sequential: carts compete for stock in checkout order
# ---------------------------------------------------------------------------

BOUND_ROUNDS = 4                # rounds of bounds before the rest is decided by groups


def connected_groups(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected group.

    ``edges`` (a, b) are strings.  Every node is joined with the smallest
    neighbour of its neighbours until each group is a star, which takes about
    log n rounds, also for a chain; neighbours are never gathered."""
    checkpoint_dir(edges.sparkSession)
    known = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint(eager=True)
    state = None
    while True:
        # large star: the greater neighbours of a node go to its smallest
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        known = small.checkpoint(eager=True)
        now = tuple(known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = known.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
    return known.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _decide_groups(batches):
    """Stream the lines of undecided carts sorted by group, then checkout order;
    the state is what the group's accepted carts took of each product."""
    import pandas as pd
    group, taken, cart, lines, out = None, {}, None, [], []

    def decide():
        if cart is None:
            return
        ok = all(stock is not None and lo + taken.get(p, 0) + q <= stock for p, q, lo, stock in lines)
        if ok:
            for p, q, *_ in lines:
                taken[p] = taken.get(p, 0) + q
        out.append((*cart, ok))

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if (r.session_id, r.seq) != cart or r.label != group:
                decide()
                cart, lines = (r.session_id, r.seq), []
                if r.label != group:
                    group, taken = r.label, {}
            lines.append((int(r.product_id), int(r.q), int(r.lo), None if pd.isna(r.stock) else int(r.stock)))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "seq", "accepted"])
            out.clear()
    decide()
    if out:
        yield pd.DataFrame(out, columns=["session_id", "seq", "accepted"])


def sequential_acceptance(lines: DataFrame, requests: DataFrame, products: DataFrame,
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact checkout-order semantics: cart k is accepted iff every line
    fits the stock left after the carts accepted before it (as when each
    checkout is validated against the live table).

    Bounds first: per line, ``lo`` = demand of earlier ACCEPTED carts on the
    product and ``hi`` = demand of earlier carts not rejected.  A cart whose
    lines all fit under ``hi`` is accepted, one with a line over stock under
    ``lo`` is rejected.  Both are running sums over blocks, so a product that
    most carts want is summed by many tasks.  After ``BOUND_ROUNDS`` rounds
    the undecided carts (chains that wait for each other) are split into
    connected groups by the products they share; groups don't influence each
    other, and each is decided in checkout order by a streaming pass over
    its undecided lines.  Only products whose total demand exceeds stock take
    part; the rest always fit.  Returns ``(session_id, seq, accepted)``.
    """
    spark = lines.sparkSession
    checkpoint_dir(spark)
    req = requests.select("session_id", "seq")
    p = products.select("product_id", F.col("stock_quantity").cast("long").alias("_stock"))
    L = (lines.join(req, "session_id").join(p, "product_id", "left")
         .select("session_id", "seq", "product_id", F.col("quantity").cast("long").alias("q"), "_stock"))
    demand = L.groupBy("product_id").agg(F.sum("q").alias("_demand"), F.first("_stock").alias("_stock"))
    binding = demand.filter(F.col("_stock").isNull() | (F.col("_demand") > F.col("_stock"))).select("product_id")
    Lb = in_blocks(L.join(binding, "product_id", "left_semi"), ["product_id", "seq", "session_id"], block_rows)
    status = (L.select("session_id", "seq").distinct()
              .join(Lb.select("session_id").distinct().withColumn("_b", F.lit(True)), "session_id", "left")
              .select("session_id", "seq",
                      F.when(F.col("_b").isNull(), F.lit("a")).otherwise(F.lit("u")).alias("st"))
              .checkpoint(eager=True))

    def bounded():
        x = running_sums(Lb.join(status, ["session_id", "seq"]), ["product_id"],
                         _lo=F.when(F.col("st") == "a", F.col("q")), _hi=F.when(F.col("st") != "r", F.col("q")))
        undecided = x.filter(F.col("st") == "u")            # its own quantity is in _hi
        return undecided.withColumn("_hi", F.col("_hi") - F.col("q"))

    for _ in range(BOUND_ROUNDS):
        if status.filter(F.col("st") == "u").isEmpty():
            break
        fits_hi = F.coalesce(F.col("_hi") + F.col("q") <= F.col("_stock"), F.lit(False))
        fails_lo = F.coalesce(F.col("_lo") + F.col("q") > F.col("_stock"), F.lit(True))
        dec = (bounded().groupBy("session_id")
               .agg(F.bool_and(fits_hi).alias("_acc"), F.bool_or(fails_lo).alias("_rej")))
        status = (status.join(dec, "session_id", "left")
                  .select("session_id", "seq",
                          F.when(F.col("st") != "u", F.col("st")).when(F.col("_acc"), F.lit("a"))
                           .when(F.col("_rej"), F.lit("r")).otherwise(F.lit("u")).alias("st"))
                  .checkpoint(eager=True))
    decided = status.filter(F.col("st") != "u").select("session_id", "seq", (F.col("st") == "a").alias("accepted"))
    if status.filter(F.col("st") == "u").isEmpty():
        return decided
    rest = bounded().select("session_id", "seq", "product_id", "q", F.col("_lo").alias("lo"), F.col("_stock").alias("stock")).checkpoint(eager=True)
    cart = F.concat(F.lit("s"), "session_id")
    groups = connected_groups(rest.select(cart.alias("a"), F.concat(F.lit("p"), F.col("product_id").cast("string")).alias("b")))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    folded = (rest.join(groups, cart == F.col("node")).select("label", "session_id", "seq", "product_id", "q", "lo", "stock")
              .repartition(n, "label").sortWithinPartitions("label", "seq", "session_id", "product_id")
              .mapInPandas(_decide_groups, "session_id string, seq long, accepted boolean"))
    return decided.unionByName(folded)
