import random
from decimal import Decimal

from domain_rows import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopfloor import schemas as S
from shopfloor.operators import carts as K
from shopfloor.operators.prefix import in_blocks, running_sums

CART_SCHEMA = "session_id string, seq long, action string, product_id long, quantity int"

# FIXTURES.md section 5
CART_EVENTS = [
    ("a", 1, "add", 2, 1), ("a", 2, "add", 2, 2), ("a", 3, "update", 2, 3),
    ("b", 1, "add", 1, 1), ("b", 2, "add", 10, 2), ("b", 3, "remove", 10, None),
    ("c", 1, "add", 3, 1), ("c", 2, "clear", None, None),
    ("d", 1, "add", 5, 31),
    ("e", 1, "add", 2, 1), ("e", 2, "add", 8, 1), ("e", 3, "add", 10, 1),
]


def _events(spark, rows=CART_EVENTS):
    return spark.createDataFrame(rows, S.CART_EVENTS)


def test_fixture_carts(spark, products_seed):
    lines = K.fold_carts(_events(spark), products_seed)
    assert rows_of(lines) == [("a", 2, 3), ("b", 1, 1), ("e", 2, 1), ("e", 8, 1), ("e", 10, 1)]
    tot = {r.session_id: r for r in K.cart_totals(K.price_lines(lines, products_seed)).collect()}
    assert set(tot) == {"a", "b", "e"}                      # empty carts: no row (N6)
    a = tot["a"]
    assert (a.subtotal, a.tax_amount, a.shipping_cost, a.total) == \
        (Decimal("89.97"), Decimal("7.20"), Decimal("10.00"), Decimal("107.17"))
    assert tot["b"].shipping_cost == Decimal("0.00") and tot["b"].subtotal == Decimal("1299.99")
    out = {(r.session_id, r.seq): r for r in K.cart_event_outcomes(_events(spark), products_seed).collect()}
    assert not out[("d", 1)].accepted and out[("d", 1)].reason == "insufficient stock"


def test_shipping_split(spark, products_seed):
    lines = K.fold_carts(_events(spark), products_seed).filter("session_id = 'e'")
    totals = K.cart_totals(K.price_lines(lines, products_seed))
    plain = sorted(r.shipping_share for r in K.shipping_shares(lines, totals).collect())
    assert plain == [Decimal("3.33")] * 3
    exact = sorted(r.shipping_share for r in K.shipping_shares(lines, totals, exact_split=True).collect())
    assert exact == [Decimal("3.33"), Decimal("3.33"), Decimal("3.34")]


def in_order(r):
    """Session, seq, action, product, quantity; nulls first."""
    return tuple((x is not None, x) for x in r)


def brute_force(rows, stock, active, outcomes=False):
    carts, out = {}, []
    for sid, seq, action, pid, q in sorted(rows, key=in_order):
        if seq is None:
            out.append((sid, seq, action, pid, False, "no seq"))
            continue
        lines = carts.setdefault(sid, {})
        why = K.cart_step(lines, action, pid, q, pid in stock, active.get(pid, False), stock.get(pid))
        out.append((sid, seq, action, pid, why is None, why))
    return sorted(out, key=in_order) if outcomes else sorted((s, p, q) for s, l in carts.items() for p, q in l.items())


actions = st.tuples(st.sampled_from(["s1", "s2", "s3"]), st.sampled_from(["add", "add", "update", "remove", "clear"]),
                    st.integers(1, 4), st.integers(-1, 6))


@settings(max_examples=10, deadline=None)
@given(st.lists(actions, min_size=1, max_size=40))
def test_fold_matches_sequential(spark, evs):
    rows = [(sid, i, a, None if a == "clear" else pid, None if a in ("clear", "remove") else q)
            for i, (sid, a, pid, q) in enumerate(evs)]
    stock = {1: 3, 2: 100, 3: 5}            # product 4 does not exist
    active = {1: True, 2: True, 3: False}
    prods = [(p, f"p{p}", "d", "c", "s", Decimal("1.00"), None, s, active[p], None, None) for p, s in stock.items()]
    products = spark.createDataFrame(prods, S.PRODUCTS)
    got = rows_of(K.fold_carts(spark.createDataFrame(rows, S.CART_EVENTS), products))
    assert got == brute_force(rows, stock, active)


def _store(spark, stock, active):
    prods = [(p, f"p{p}", "d", "c", "s", Decimal("1.00"), None, s, active[p], None, None) for p, s in stock.items()]
    return spark.createDataFrame(prods, S.PRODUCTS)


def test_shared_and_missing_positions(spark):
    """Actions of equal seq are ordered by action, product, quantity; those without one are rejected."""
    rng = random.Random(8)
    stock, active = {1: 4, 2: 100, 3: 5}, {1: True, 2: True, 3: False}
    rows = [(rng.choice("ab"), rng.choice([None, *range(12)]), a, None if a == "clear" else rng.choice([None, 1, 2, 3, 4]),
             None if a in ("clear", "remove") else rng.choice([None, -1, 0, 1, 2, 3]))
            for a in rng.choices(["add", "update", "remove", "clear", "gift"], [9, 5, 2, 1, 1], k=400)]
    df = spark.createDataFrame(rows, CART_SCHEMA).repartition(4)
    assert rows_of(K.fold_carts(df, _store(spark, stock, active))) == brute_force(rows, stock, active)
    got = sorted((tuple(r) for r in K.cart_event_outcomes(df, _store(spark, stock, active), block_rows=5).collect()), key=in_order)
    assert got == brute_force(rows, stock, active, outcomes=True)


def test_a_session_with_most_actions_spreads_over_tasks(spark):
    rng = random.Random(9)
    stock, active = {p: 30 for p in range(1, 41)}, {p: True for p in range(1, 41)}
    rows = [("hot" if k % 8 else f"s{k % 200}", k, "clear" if k % 500 == 1 else rng.choice(["add", "add", "update", "remove"]),
             None if k % 500 == 1 else rng.randint(1, 40), None if k % 500 == 1 else rng.randint(0, 9)) for k in range(12_000)]
    df = spark.createDataFrame(rows, CART_SCHEMA)
    epochs = K.with_epochs(df, block_rows=200)
    lines = epochs.where("session_id = 'hot'").groupBy(*K.LINE).count()
    assert lines.agg(F.max("count")).first()[0] < len(rows) / 50         # a task folds lines, not the session
    got = sorted((tuple(r) for r in K.cart_event_outcomes(df, _store(spark, stock, active), block_rows=200).collect()), key=in_order)
    assert got == brute_force(rows, stock, active, outcomes=True)
    assert rows_of(K.fold_carts(df, _store(spark, stock, active))) == brute_force(rows, stock, active)


def test_running_sums_over_blocks(spark):
    rows = [("a" if k % 3 else f"s{k % 7}", k, k % 5 - 2) for k in range(500)]
    df = spark.createDataFrame(rows, "s string, k long, v long")
    got = {r.k: r.total for r in running_sums(in_blocks(df.repartition(6), ["s", "k"], 9), ["s"], total=F.col("v")).collect()}
    sums, want = {}, {}
    for s, k, v in rows:
        want[k] = sums[s] = sums.get(s, 0) + v
    assert got == want


def brute_force_checkout(carts, stock):
    """Reference semantics: each checkout validated against live stock."""
    st, acc = dict(stock), {}
    for sid, seq, lines in sorted(carts, key=lambda c: (c[1], c[0])):
        ok = all(st.get(p) is not None and st[p] >= q for p, q in lines)
        if ok:
            for p, q in lines:
                st[p] -= q
        acc[sid] = ok
    return acc


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 6)), min_size=1, max_size=3,
                         unique_by=lambda t: t[0]), min_size=1, max_size=12))
def test_sequential_checkout_matches_live_stock(spark, carts):
    stock = {1: 5, 2: 8, 3: 100}            # product 4 does not exist
    cs = [(f"s{i}", i, lines) for i, lines in enumerate(carts)]
    lines = spark.createDataFrame([(sid, p, q) for sid, _, ls in cs for p, q in ls],
                                  "session_id string, product_id long, quantity int")
    req = spark.createDataFrame([(sid, seq) for sid, seq, _ in cs], "session_id string, seq long")
    prods = spark.createDataFrame([(p, f"p{p}", None, "c", "s", Decimal("1"), None, s, True, None, None)
                                   for p, s in stock.items()], S.PRODUCTS)
    got = {r.session_id: r.accepted for r in K.sequential_acceptance(lines, req, prods).collect()}
    assert got == brute_force_checkout(cs, stock)


def _contend(spark, carts, stock, **kw):
    lines = spark.createDataFrame([(sid, p, q) for sid, _, ls in carts for p, q in ls], "session_id string, product_id long, quantity int")
    req = spark.createDataFrame([(sid, seq) for sid, seq, _ in carts], "session_id string, seq long")
    prods = spark.createDataFrame(list(stock.items()), "product_id long, stock_quantity int")
    return {r.session_id: r.accepted for r in K.sequential_acceptance(lines, req, prods, **kw).collect()}


def test_a_long_chain_of_competing_carts(spark, monkeypatch):
    """Cart k waits for cart k - 1: 5,000 decisions that depend on each other take few rounds."""
    n, rounds = 5000, []
    checkpoint = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a, **k: rounds.append(1) or checkpoint(df, *a, **k))
    carts = [(f"s{k}", k, [(k, 1), (k + 1, 1)]) for k in range(n)]
    carts += [(f"t{k}", k, [(10 ** 6 + k % 50, 1 + k % 3)]) for k in range(600)]
    stock = {k: 1 for k in range(n + 1)} | {10 ** 6 + k: k for k in range(50)}
    assert _contend(spark, carts, stock, block_rows=64) == brute_force_checkout(carts, stock)
    assert len(rounds) <= 30


def test_groups_that_share_products(spark):
    rng = random.Random(2)
    stock = {p: rng.choice([0, 1, 3, 9]) for p in range(60)}
    carts = [(f"s{k}", rng.randint(0, 200), [(p, rng.randint(1, 3)) for p in rng.sample(range(k % 6 * 10, k % 6 * 10 + 10), rng.randint(1, 4))])
             for k in range(400)]
    assert _contend(spark, carts, stock, block_rows=7) == brute_force_checkout(carts, stock)


def test_connected_groups(spark):
    edges = [(f"a{k:04}", f"a{k + 1:04}") for k in range(300) if k % 60] + [("x", "y"), ("z", "z"), ("y", "x")]
    got = {r.node: r.label for r in K.connected_groups(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["x"] == got["y"] == "x" and all(got[f"a{k:04}"] == f"a{(k - 1) // 60 * 60 + 1:04}" for k in range(1, 300) if k % 60)


def test_checkout_totals_equal_items(spark, products_seed):
    from shopfloor.plans import checkout as CK
    lines = K.fold_carts(_events(spark), products_seed)
    req = spark.createDataFrame(
        [(s, i, "Ann Smith", "ann@example.com", None, "1 Main Street", "Springfield", None, "12345", None,
          None, "simulated") for i, s in enumerate(["a", "b", "c", "d", "e"])], S.CHECKOUT_REQUESTS)
    empty_co = spark.createDataFrame([], S.CUSTOMER_ORDERS)
    empty_items = spark.createDataFrame([], S.ORDER_ITEMS)
    empty_orders = spark.createDataFrame([], S.ORDERS)
    out = CK.checkout(lines, req, products_seed, empty_co, empty_items, empty_orders, as_of="2024-06-01 00:00:00")
    heads = {r.customer_order_id: r for r in out["customer_orders_new"].collect()}
    items = out["order_items_new"].groupBy("customer_order_id").agg(F.sum("subtotal").alias("s")).collect()
    assert {r.customer_order_id: r.s for r in items} == {k: v.subtotal_amount for k, v in heads.items()}
    assert sorted(heads) == [1, 2, 3]                                  # a, b, e; c empty, d has no lines
    assert {r.session_id: r.reason for r in out["rejects"].collect()} == {"c": "Cart is empty", "d": "Cart is empty"}
    assert sorted(r.order_id for r in out["orders_new"].collect()) == [1, 2, 3, 4, 5]
