import datetime as dt
import json
import os
import random
import re
import time
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from domain_rows import rows_of
from pyspark.sql import functions as F

from shopfloor import schemas as S
from shopfloor.operators import changes as CH
from shopfloor.session import checkpoint_dir

AS_OF = "2024-06-01 00:00:00"
CMD = "seq long, action string, data string"


def _cmds(spark, rows):
    return spark.createDataFrame([(s, a, json.dumps(d) if isinstance(d, dict) else d) for s, a, d in rows], CMD)


def test_command_fixture(spark, orders_small):
    """FIXTURES.md section 6."""
    rows = [
        (1, "create_order", {"customer_name": "Zed", "quantity": "2", "subtotal_amount": "20.00",
                             "category": "Technology", "subcategory": "Phones"}),
        (2, "update_order", {"order_id": "3", "status": "shipped"}),
        (3, "update_order", {"order_id": "5", "shipping_cost": None}),
        (4, "update_order", {"order_id": "5"}),
        (5, "delete_order", {"order_id": "8"}),
        (6, "delete_order", {"order_id": "999"}),
        (7, "create_order", {"customer_name": "Yan", "quantity": "1", "subtotal_amount": "5",
                             "category": "Furniture", "subcategory": "Chairs"}),
        (8, "update_order", {"order_id": "12", "status": "delivered"}),
        (9, "delete_order", {"order_id": "12"}),
        (10, "update_order", {"order_id": "12", "status": "late"}),
        (11, "explode_order", {"order_id": "1"}),
        (12, "create_order", {"customer_name": "NoQty", "subtotal_amount": "5", "category": "x", "subcategory": "y"}),
        (13, "update_order", {"order_id": "0", "status": "x"}),
    ]
    out = CH.apply_order_commands(orders_small, _cmds(spark, rows), as_of=AS_OF, constraints=False)
    t = {r.order_id: r for r in out["target"].collect()}
    assert 8 not in t and 12 not in t                       # deleted, incl. the one created in the batch
    z = t[11]
    assert (z.customer_name, z.status, z.tax_rate, z.shipping_cost, str(z.order_date)) == \
        ("Zed", "pending", Decimal("0.0000"), Decimal("0.00"), "2024-06-01")
    assert t[3].status == "shipped" and t[5].shipping_cost is None and t[5].status == "pending"
    rej = {r.seq: r.reason for r in out["rejects"].collect()}
    assert rej == {4: "No fields to update", 6: "Order not found", 10: "Order not found",
                   11: "Unknown action: explode_order", 12: "missing required field",
                   13: "order_id is required"}
    ch = {(r.seq, r.action, r.severity) for r in out["changes"].collect()}
    assert (1, "created", "success") in ch and (5, "deleted", "warning") in ch and (2, "updated", "info") in ch
    assert (8, "updated", "info") in ch and (9, "deleted", "warning") in ch


def test_commands_keep_the_table_constraints(spark, orders_small):
    new = {"customer_name": "Zed", "quantity": "2", "subtotal_amount": "20.00", "category": "T", "subcategory": "P"}
    rows = [(1, "create_order", new | {"quantity": "-5"}), (2, "create_order", new | {"order_date": None}),
            (3, "create_order", new | {"tax_rate": "0"}), (4, "update_order", {"order_id": "3", "status": None}),
            (5, "update_order", {"order_id": "3", "shipping_cost": "-0.01"}),
            (6, "update_order", {"order_id": "3", "quantity": "0", "note": None}),
            (7, "update_order", {"order_id": "3", "quantity": "many"}), (8, "delete_order", {"order_id": "999", "status": None})]
    out = CH.apply_order_commands(orders_small, _cmds(spark, rows), as_of=AS_OF)
    assert {r.seq: r.reason for r in out["rejects"].collect()} == {
        1: "negative value", 2: "NULL not allowed", 4: "NULL not allowed", 5: "negative value", 7: "invalid value",
        8: "Order not found"}
    t = {r.order_id: r for r in out["target"].collect()}
    before = {r.order_id: r for r in orders_small.collect()}
    assert len(t) == 11 and t[11].customer_name == "Zed" and t[3].quantity == 0 and t[3].status == before[3].status


def test_ids_from_text(spark):
    df = spark.createDataFrame([("1, 2,x, 4b",)], "ids string")
    assert [r.order_id for r in CH.ids_from_text(df).collect()] == [1, 2, 4]


def test_set_status_and_domain(spark, orders_small):
    ids = spark.createDataFrame([(1,), (2,), (2,), (77,)], "order_id long")
    out = CH.set_status(orders_small, ids, "shipped")
    assert out["report"].first().updated_rows == 2
    assert {r.order_id for r in out["target"].filter("status = 'shipped'").collect()} == {1, 2, 6}


def test_upsert_last_wins_and_idempotent(spark, orders_small):
    src = orders_small.filter("order_id IN (1, 2)").withColumn("seq", F.col("order_id")) \
        .withColumn("order_id", F.lit(1).cast("long"))
    once = CH.upsert(orders_small, src, "order_id", seq="seq")
    assert once["target"].filter("order_id = 1").first().subcategory == "Phones"   # row 2 came last
    twice = CH.upsert(once["target"], src, "order_id", seq="seq")
    assert rows_of(twice["target"]) == rows_of(once["target"])
    assert once["report"].first().updated == 1


def test_patch_products_null_leaves(spark, products_seed):
    patches = spark.createDataFrame([(2, 1, None, 5), (2, 2, Decimal("9.99"), None), (3, 1, None, None)],
                                    "product_id long, seq long, price decimal(18,2), stock_quantity int")
    out = CH.patch_products(products_seed, patches, as_of=AS_OF)["target"]
    p2 = out.filter("product_id = 2").first()
    assert (p2.price, p2.stock_quantity, str(p2.updated_at)) == (Decimal("9.99"), 5, "2024-06-01 00:00:00")
    p3 = out.filter("product_id = 3").first()
    assert str(p3.updated_at) == "2024-01-01 00:00:00"       # all-NULL patch leaves the row alone
    empty = spark.createDataFrame([], "product_id long, seq long, price decimal(18,2)")
    assert rows_of(CH.patch_products(products_seed, empty)["target"]) == rows_of(products_seed)


def _seq_fold(stock0, deltas):
    out = dict(stock0)
    for pid, seq, d in sorted(deltas, key=lambda r: r[1]):
        if pid in out and out[pid] + d >= 0:
            out[pid] += d
    return out


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(-30, 15)), min_size=1, max_size=40))
def test_stock_deltas_match_sequential(spark, ds):
    stock0 = {1: 10, 2: 1000, 3: 0}
    prods = spark.createDataFrame([(p, f"p{p}", None, "c", "s", Decimal("1"), None, s, True, None, None)
                                   for p, s in stock0.items()], S.PRODUCTS)
    deltas = [(pid, i, d) for i, (pid, d) in enumerate(ds)]
    res = CH.apply_stock_deltas(prods, spark.createDataFrame(deltas, "product_id long, seq long, delta long"))
    got = {r.product_id: r.stock_quantity for r in res["target"].collect()}
    assert got == _seq_fold(stock0, deltas)
    assert min(got.values()) >= 0


def _simulate(rows0, cmds, as_of_date="2024-06-01", constraints=True):
    """Sequential reference model: one command at a time against a dict.
    New ids continue after the largest id of the starting table (a deleted
    max id is not reused within a batch)."""
    table = {r[0]: list(r[1:]) for r in rows0}
    fields = S.ORDER_FIELDS
    next_id = max(table) if table else 0
    def broken(f, v):
        return v is None or f in S.NUMERIC_FIELDS and float(v) < 0

    for seq, action, data in sorted(cmds, key=lambda c: c[0]):
        if constraints and any(broken(f, data[f]) for f in fields if f in data):
            continue
        if action == "create_order":
            if not all(k in data for k in CH.CREATE_REQUIRED):
                continue
            next_id += 1
            row = []
            for f in fields:
                if f == "order_date":
                    row.append(data.get(f) or as_of_date)
                elif f in data:
                    row.append(data[f])
                else:
                    row.append(CH.CREATE_DEFAULTS.get(f))
            table[next_id] = row
        elif action in ("update_order", "delete_order"):
            oid = int(data.get("order_id") or 0)
            if oid == 0 or oid not in table:
                continue
            if action == "delete_order":
                del table[oid]
            else:
                for i, f in enumerate(fields):
                    if f in data:
                        table[oid][i] = data[f]
    return table


def _norm_row(r):
    out = []
    for f, v in zip(S.ORDER_FIELDS, r):
        if v is None:
            out.append(None)
        elif f in ("subtotal_amount", "shipping_cost", "tax_rate"):
            out.append(Decimal(str(v)).quantize(Decimal("0.01") if f != "tax_rate" else Decimal("0.0001")))
        elif f == "quantity":
            out.append(int(v))
        else:
            out.append(str(v))
    return tuple(out)


cmd_strategy = st.lists(st.tuples(
    st.sampled_from(["create_order", "update_order", "update_order", "delete_order", "bogus"]),
    st.integers(0, 6),                                  # target id (0 = missing)
    st.sampled_from(["status", "quantity", "shipping_cost", "customer_name"]),
    st.sampled_from(["shipped", "7", None, "3.5", "-2"]),
    st.booleans()), min_size=1, max_size=25)


@settings(max_examples=10, deadline=None)
@given(cmd_strategy, st.booleans())
def test_command_fold_matches_sequential_model(spark, spec, constraints):
    base = [(1, "pending", "A", "2020-01-01", 1, "1.00", "0.0000", "1.00", "c", "s"),
            (2, "shipped", "B", "2020-01-02", 2, "2.00", "0.0000", "2.00", "c", "s"),
            (3, "pending", "C", "2020-01-03", 3, "3.00", "0.0000", "3.00", "c", "s")]
    cmds = []
    for seq, (action, oid, field, value, full) in enumerate(spec):
        if action == "create_order":
            data = {"customer_name": "N", "quantity": "1", "subtotal_amount": "5.00",
                    "category": "x", "subcategory": "y"}
            if not full:
                data.pop("quantity")
        else:
            data = {"order_id": str(oid)} if oid else {}
            if action == "update_order":
                v = value
                if field == "quantity" and v not in (None, "7", "-2"):
                    v = "7"
                if field == "shipping_cost" and v in ("shipped",):
                    v = "3.5"
                data[field] = v
        cmds.append((seq, action, data))
    target = spark.createDataFrame(
        [(i, st_, c, dt.date.fromisoformat(d), q, Decimal(s), Decimal(t), Decimal(sh), cat, sub)
         for i, st_, c, d, q, s, t, sh, cat, sub in base], S.ORDERS)
    out = CH.apply_order_commands(target, _cmds(spark, cmds), as_of=AS_OF, constraints=constraints)["target"]
    got = {r.order_id: _norm_row([r[f] for f in S.ORDER_FIELDS]) for r in out.collect()}
    model = _simulate([(r[0], *r[1:]) for r in base], cmds, constraints=constraints)
    assert got == {k: _norm_row(v) for k, v in model.items()}


def test_stock_deltas_with_nulls_and_ties(spark, products_seed):
    """A NULL delta is not applied on either path; equal positions fold by delta."""
    rows = [(1, 1, None), (1, 2, 5), (5, 1, -20), (5, 1, -15), (5, 2, None), (5, 3, -100)]
    out = CH.apply_stock_deltas(products_seed, spark.createDataFrame(rows, "product_id long, seq long, delta long"))
    stock = {r.product_id: r.stock_quantity for r in out["target"].collect()}
    assert stock[1] == 55 and stock[5] == 10
    got = sorted((r.product_id, r.seq, r.delta if r.delta is not None else 0, r.applied) for r in out["decisions"].collect())
    assert got == [(1, 1, 0, False), (1, 2, 5, True), (5, 1, -20, True), (5, 1, -15, False), (5, 2, 0, False), (5, 3, -100, False)]


def test_one_row_per_key_without_positions(spark, orders_small):
    twice = orders_small.where("order_id = 1").unionByName(orders_small.where("order_id = 1").withColumn("quantity", F.lit(9)))
    out = CH.replace_rows(orders_small, twice, "order_id")
    assert out["target"].count() == orders_small.count()
    rows = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (2, 1, "c")], "k long, seq long, v string")
    assert [(r.k, r.v) for r in CH.last_per_key(rows, "k", "seq").collect()] == [(2, "c")]


def test_rows_without_a_position_are_rejects(spark, orders_small):
    src = orders_small.filter("order_id IN (1, 2, 3)").withColumn("seq", F.when(F.col("order_id") != 2, F.col("order_id"))) \
        .withColumn("quantity", F.lit(9))
    up = CH.upsert(orders_small, src, "order_id", seq="seq")
    assert [(r.order_id, r.reason) for r in up["rejects"].collect()] == [(2, "no seq")]
    assert tuple(up["report"].first()) == (0, 2, 1) and up["report"].columns == ["inserted", "updated", "rejected"]
    assert up["target"].count() == orders_small.count()
    new = CH.replace_rows(orders_small, src.withColumn("category", F.when(F.col("order_id") != 3, F.col("category"))), "order_id",
                          seq="seq", required=["status", "category"])
    assert sorted((r.order_id, r.reason) for r in new["rejects"].collect()) == [(2, "no seq"), (3, "missing: category")]
    assert [r.order_id for r in new["replaced"].collect()] == [1]
    assert CH.upsert(orders_small, src.drop("seq"), "order_id")["rejects"].count() == 0


def test_replace_needs_all_required_fields(spark, orders_small):
    rows = orders_small.filter("order_id IN (1, 2)").withColumn("status", F.lit("delivered")).withColumn(
        "category", F.when(F.col("order_id") == 1, F.col("category")))
    out = CH.replace_rows(orders_small, rows, "order_id", required=["status", "category"])
    assert [r.order_id for r in out["replaced"].collect()] == [1]
    assert [r.order_id for r in out["rejects"].collect()] == [2]
    assert out["target"].count() == orders_small.count()


def test_no_command_without_a_place_vanishes(spark, orders_small):
    create = {"customer_name": "N", "quantity": "1", "subtotal_amount": "5.00", "category": "x", "subcategory": "y"}
    cmds = [(None, "create_order", create), (None, "update_order", {"order_id": "1", "status": "shipped"}),
            (None, "delete_order", {"order_id": "2"}), (5, "delete_order", {"order_id": "3"}), (5, "delete_order", {"order_id": "3"}),
            (6, "update_order", {"order_id": "4", "status": "b"}), (6, "update_order", {"order_id": "4", "status": "a"}),
            (7, "create_order", create), (8, "update_order", {"order_id": "11", "status": "late"})]
    out = CH.apply_order_commands(orders_small, _cmds(spark, cmds), as_of=AS_OF, constraints=False)
    changes = rows_of(out["changes"], "seq", "order_id", "action")
    rejects = rows_of(out["rejects"], "seq", "action", "order_id", "reason")
    assert len(changes) + len(rejects) == len(cmds)
    assert changes == [(5, 3, "deleted"), (6, 4, "updated"), (6, 4, "updated"), (7, 11, "created"), (8, 11, "updated")]
    assert [r[3] for r in rejects] == ["Order not found", "no seq", "no seq", "no seq"]
    status = {r.order_id: r.status for r in out["target"].collect()}
    assert status[4] == "b" and status[11] == "late" and 3 not in status and 2 in status and len(status) == 10
    assert {r["action"]: r["count"] for r in out["report"].collect()} == {"created": 1, "updated": 3, "deleted": 1, "rejected": 4}
    assert rows_of(out["delta"], "order_id", "op", "seq") == [(3, "delete", 5), (4, "upsert", 6), (11, "upsert", 8)]


def test_patches_and_status_changes_without_a_place(spark, products_seed):
    patches = spark.createDataFrame([(1, None, 7), (2, 1, 5), (2, 1, 9), (2, 0, 50)], "product_id long, seq long, stock_quantity int")
    out = CH.patch_products(products_seed, patches, as_of=AS_OF)
    stock = {r.product_id: (r.stock_quantity, str(r.updated_at)) for r in out["target"].collect()}
    assert stock[1][0] == 50 and stock[2] == (9, AS_OF) and stock[1][1] != AS_OF
    assert rows_of(out["rejects"]) == [(1, None, 7, "no seq")] and out["report"].first()[0] == 1
    orders = spark.createDataFrame([(1, "pending"), (2, "pending")], "customer_order_id long, status string")
    ch = spark.createDataFrame([(1, None, "shipped"), (2, 3, "delivered"), (2, 3, "shipped"), (2, 9, "gone")],
                               "customer_order_id long, seq long, status string")
    out = CH.set_customer_order_status(orders, ch)
    assert rows_of(out["target"]) == [(1, "pending"), (2, "shipped")]
    assert rows_of(out["rejects"]) == [(1, None, "shipped", "no seq"), (2, 9, "gone", "invalid status")]


def test_creates_and_replacements_keep_the_constraints(spark, orders_small):
    rows = orders_small.where("order_id IN (1, 5, 7, 8)").withColumn("_src", F.col("order_id"))
    out = CH.create_rows(orders_small, rows, "order_id", ["_src"], required=["quantity"],
                         not_negative=["quantity", "subtotal_amount"])
    assert rows_of(out["rejects"], "_src", "reason") == [(7, "missing: quantity"), (8, "negative: quantity,subtotal_amount")]
    assert out["created"].count() == 2
    out = CH.replace_rows(orders_small, rows.drop("_src"), "order_id", required=["category"], not_negative=["quantity"])
    assert rows_of(out["rejects"], "order_id", "reason") == [(7, "missing: category"), (8, "negative: quantity")]


def _stock_model(stock, deltas):
    """Stock and decisions after ``deltas`` (product, seq, delta), one after the other."""
    stock, out = dict(stock), []
    for p, seq, x in sorted(deltas):
        ok = p in stock and stock[p] + x >= 0
        if ok:
            stock[p] += x
        out.append((p, seq, x, ok))
    return stock, sorted(out)


@pytest.mark.parametrize("block_rows", [1, 3, 7, 50])
def test_stock_blocks_equal_the_sequential_fold(spark, products_seed, block_rows):
    """Products that hover at 0, recover, start below 0 or share positions, in blocks of any size."""
    rng = random.Random(block_rows)
    start = {1: 0, 2: 5, 3: 40, 4: -4, 5: 10 ** 6}
    deltas = [(p, rng.randint(0, 300), rng.choice([-60, -9, -3, -1, 0, 1, 2, 8, 30])) for p in start for _ in range(400)]
    deltas += [(5, 301, -2 * 10 ** 6), (99, 1, 5)]
    products = products_seed.where("product_id <= 5").withColumn("stock_quantity", F.create_map(
        *[F.lit(x) for k in start for x in (k, start[k])])[F.col("product_id").cast("int")].cast("int"))
    out = CH.apply_stock_deltas(products, spark.createDataFrame(deltas, "product_id long, seq long, delta long").repartition(5),
                                block_rows=block_rows)
    stock, decisions = _stock_model(start, deltas)
    assert {r.product_id: r.stock_quantity for r in out["target"].collect()} == stock
    assert sorted(tuple(r) for r in out["decisions"].select("product_id", "seq", "delta", "applied").collect()) == decisions


def test_a_product_with_most_deltas_is_not_folded_in_one_task(spark):
    """One product holds nearly all deltas; only the blocks where the guard can act are opened."""
    n = 60_000
    rows = (spark.range(n).select(F.when(F.col("id") % 20 == 0, F.col("id") % 50).otherwise(F.lit(7)).alias("product_id"),
                                  F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, 3).otherwise(-3).cast("long").alias("delta"))
            .withColumn("delta", F.when(F.col("seq") == 30_001, F.lit(-10 ** 6)).otherwise(F.col("delta")))
            .withColumn("_stock0", F.lit(100).cast("long")))
    placed, blocks = CH.stock_blocks(rows, 500)
    hot = blocks.where("product_id = 7")
    assert hot.select("_pid").distinct().count() > 1 and hot.where("NOT _safe").count() == 1
    widest = placed.where("product_id = 7").groupBy("_pid", "_blk").count().agg(F.max("count")).first()[0]
    assert widest <= 500
    dec, final = CH._fold_blocks(rows, 500)
    stock, decisions = _stock_model({p: 100 for p in range(50)}, [tuple(r) for r in rows.select("product_id", "seq", "delta").collect()])
    assert sorted(tuple(r) for r in dec.collect()) == decisions
    # products all of whose blocks are safe end with their sums, the others with the fold
    assert all(stock[r.product_id] == r._new for r in final.collect())


def test_creates_are_numbered_in_place_of_the_sorted_commands(spark, orders_small):
    """Ids follow the one sorted copy over several partitions, with other commands between; the creates aren't sorted and copied again."""
    pay = '{"customer_name": "c", "quantity": "%d", "subtotal_amount": "2", "category": "x", "subcategory": "y"}'
    rows = [(f"{i * 37 % 4000}", "create_order" if i % 3 else "get_order", pay % (i * 37 % 4000)) for i in range(4000)]
    cmds = spark.createDataFrame(rows, "seq string, action string, data string").withColumn("seq", F.col("seq").cast("long")).repartition(6)
    copies, frame = [], type(cmds)
    kept, aqe = frame.checkpoint, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(aqe, "false")
    frame.checkpoint = lambda self, *a, **b: copies.append(self.columns) or kept(self, *a, **b)
    try:
        out = CH.apply_order_commands(orders_small, cmds, as_of="2024-06-01 00:00:00")
        top = orders_small.agg(F.max("order_id")).first()[0]
        expect = {top + n: s for n, s in enumerate(sorted(int(s) for s, a, _ in rows if a == "create_order"), 1)}
        for part in ("target", "delta"):
            assert {r.order_id: r.quantity for r in out[part].where(F.col("order_id") > top).collect()} == expect
        assert {r.order_id: r.seq for r in out["changes"].collect()} == expect
    finally:
        frame.checkpoint = kept
        spark.conf.unset(aqe)
    assert sum("payload" in c for c in copies) == 2        # the parsed commands, and these in order


def test_the_code_that_classifies_a_command_is_short_enough_to_be_compiled(spark, orders_small):
    """HotSpot compiles no method of over 8000 bytes; the checks of all fields in one such method ran at a fifth of the speed."""
    cmds = spark.createDataFrame([(1, "create_order", "{}")], "seq long, action string, data string").union(
        spark.range(1).selectExpr("id", "'create_order'", "'{}'"))
    frame, kept, sizes = type(cmds), type(cmds).checkpoint, []

    def measured(self, *a, **b):
        if "_reason" in self.columns and not sizes:
            text = spark._jvm.PythonSQLUtils.explainString(self._jdf.queryExecution(), "codegen")
            sizes.extend(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))
        return kept(self, *a, **b)
    frame.checkpoint = measured
    try:
        CH.apply_order_commands(orders_small, cmds)
    finally:
        frame.checkpoint = kept
    assert all(n < 8000 for n in sizes)


def _bytes_below(*tops):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for t in tops for d, _, names in os.walk(t) for f in names}


def test_a_batch_of_creates_is_copied_once_and_its_sort_leaves_no_shuffle_files(spark, orders_small):
    """Two copies with the parsed map and the shuffle between them took 250 bytes of disk for a create."""
    n = 60_000
    cmds = spark.range(n, numPartitions=6).select(
        (F.col("id") * 7919 % n).alias("seq"), F.lit("create_order").alias("action"),
        F.concat(F.lit('{"customer_name": "c'), F.xxhash64("id") % 5000, F.lit('", "quantity": "'), F.col("id") % 50,
                 F.lit('", "subtotal_amount": "'), F.col("id") % 99991, F.lit('.5", "category": "x", "subcategory": "y"}')).alias("data"))
    kept = checkpoint_dir(spark).removeprefix("file:")
    local = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    before, shuffled = _bytes_below(kept), _bytes_below(*local)
    CH.apply_order_commands(orders_small, cmds, as_of=AS_OF)
    copied = sum(v for k, v in _bytes_below(kept).items() if k not in before)
    for _ in range(40):                    # the files go in the background
        left = sum(v for k, v in _bytes_below(*local).items() if k not in shuffled and "shuffle_" in k)
        if left < 5 * n:
            break
        time.sleep(0.25)
    assert copied < 60 * n and left < 5 * n


def test_creates_edits_and_rejects_keep_one_order_over_partitions(spark, orders_small):
    """Good creates are numbered without gaps past bad ones; an edit of the same seq finds the new row, an earlier one doesn't."""
    def pay(q, **more):
        return json.dumps({"customer_name": "c", "quantity": q, "subtotal_amount": "2", "category": "x", "subcategory": "y"} | more)
    good = [s for s in range(900) if s % 3]
    ids = {s: 10 + n for n, s in enumerate(good, 1)}
    rows = [(s, "create_order", pay(str(s)) if s % 3 else pay("many")) for s in range(900)]
    rows += [(s, "update_order", json.dumps({"order_id": str(ids[s]), "status": "same"})) for s in good if s % 2]
    rows += [(s - 1, "update_order", json.dumps({"order_id": str(ids[s]), "category": "early"})) for s in good if s % 7 == 0]
    rows += [(s, "delete_order", json.dumps({"order_id": str(ids[s])})) for s in good if s % 10 == 2] * 2
    cmds = spark.createDataFrame(rows, "seq long, action string, data string").repartition(5)
    aqe = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(aqe, "false")
    try:
        out = CH.apply_order_commands(orders_small, cmds, as_of=AS_OF)
        gone = {ids[s] for s in good if s % 10 == 2}
        target = {r.order_id: (r.quantity, r.status, r.category) for r in out["target"].where("order_id > 10").collect()}
        # at equal seq "delete_order" sorts before "update_order": what is gone isn't updated
        assert target == {i: (s, "same" if s % 2 else "pending", "x") for s, i in ids.items() if i not in gone}
        assert {r.order_id: r.seq for r in out["changes"].where("action = 'created'").collect()} == {i: s for s, i in ids.items()}
        counts = {r["action"]: r["count"] for r in out["report"].collect()}
        assert counts == {"created": len(good), "updated": sum(s % 2 for s in good), "deleted": len(gone),
                          "rejected": 300 + sum(s % 7 == 0 for s in good) + len(gone)}
        assert {r.order_id for r in out["delta"].collect()} == set(target)
    finally:
        spark.conf.unset(aqe)


def test_shuffles_are_dropped_behind_one_chain_of_steps_only(spark, monkeypatch):
    """AQE may end a query with an empty side while its other stages run; on executors these waited 120 s for dropped files."""
    from shopfloor import session as SE
    key, kept, seen = SE._DROP_SHUFFLES, SE._dropping_shuffles, []
    monkeypatch.setattr(SE, "_dropping_shuffles", lambda s: seen.append(s) or kept(s))
    ids, before = spark.range(50), spark.conf.get(key, None)
    assert SE.shared_copy(ids.join(spark.range(5).where("id > 9"), "id", "left_semi"), "join").count() == 0 and not seen
    assert SE.shared_copy(ids.repartitionByRange(3, "id"), "chain").count() == 50 and len(seen) == 1
    assert spark.conf.get(key, None) == before


def test_a_batch_of_creates_alone_does_not_search_the_table(spark, orders_small):
    """The rows that edits name were searched by joins of the whole table also if there were no edits."""
    frame, kept, plans = type(orders_small), type(orders_small).checkpoint, []

    def noted(self, *a, **b):
        if "order_id" in self.columns and "_bseq" in self.columns:
            plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return kept(self, *a, **b)
    frame.checkpoint = noted
    try:
        pay = {"customer_name": "N", "quantity": "1", "subtotal_amount": "5.00", "category": "x", "subcategory": "y"}
        out = CH.apply_order_commands(orders_small, _cmds(spark, [(1, "create_order", pay)]), as_of=AS_OF)
    finally:
        frame.checkpoint = kept
    assert len(plans) == 1 and "Join" not in plans[0]
    assert out["target"].count() == orders_small.count() + 1
