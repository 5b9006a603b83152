import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from shopfloor.operators import changes as CH
from shopfloor.streaming import daily as DY
from shopfloor.streaming import jobs as J
from domain_rows import rows_of

AS_OF = "2024-06-01 00:00:00"


def _write_cmds(spark, path, rows):
    spark.createDataFrame([(s, a, json.dumps(d)) for s, a, d in rows], "seq long, action string, data string") \
        .coalesce(1).write.mode("overwrite").json(path)


def test_command_stream_two_batches_and_replay(spark, orders_small, scratch):
    b1 = [(1, "update_order", {"order_id": "3", "status": "shipped"}),
          (2, "create_order", {"customer_name": "Zed", "quantity": "2", "subtotal_amount": "20.00",
                               "category": "T", "subcategory": "P"})]
    b2 = [(3, "delete_order", {"order_id": "11"}), (4, "update_order", {"order_id": "5", "quantity": "7"})]
    queue, state = os.path.join(scratch, "queue"), os.path.join(scratch, "state")
    schema = "seq long, action string, data string"
    for i, rows in enumerate([b1, b2]):
        _write_cmds(spark, os.path.join(queue, f"part{i}"), rows)
        src = spark.readStream.schema(schema).json(os.path.join(queue, "*"))
        q = J.start_command_stream(spark, src, state, orders_small, as_of=AS_OF, trigger={"availableNow": True})
        q.awaitTermination()
    final = J.current_orders(spark, state)
    all_cmds = spark.createDataFrame([(s, a, json.dumps(d)) for s, a, d in b1 + b2], schema)
    expect = CH.apply_order_commands(orders_small, all_cmds, as_of=AS_OF)["target"]
    assert rows_of(final) == rows_of(expect)
    assert 11 not in {r.order_id for r in final.collect()}
    # replaying a committed batch is a no-op
    writer = J.command_batch_writer(spark, state, orders_small, AS_OF)
    writer(spark.createDataFrame([(9, "delete_order", json.dumps({"order_id": "1"}))], schema), 0)
    assert rows_of(J.current_orders(spark, state)) == rows_of(final)


def test_daily_summary_closes_windows(spark, scratch):
    rows = [(1, dt.datetime(2024, 1, 1, 10), "purchase", 5.0), (2, dt.datetime(2024, 1, 1, 23), "purchase", 1.0),
            (3, dt.datetime(2024, 1, 2, 12), "purchase", 2.0), (4, dt.datetime(2024, 1, 3, 9), "view", 1.0)]
    src = os.path.join(scratch, "ev")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double") \
        .write.parquet(src)
    stream = J.file_stream(spark, src, "event_id long, ts timestamp_ntz, event_type string, value double")
    out = os.path.join(scratch, "out")
    q = (J.daily_summary(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = rows_of(spark.read.parquet(out).select(F.col("day").cast("string"), "status",
                                                 "event_count", "amount"))
    # 2024-01-03 is still open (watermark = 08:00 on the 3rd)
    assert got == [("2024-01-01", "purchase", 2, 6.0), ("2024-01-02", "purchase", 1, 2.0)]


def test_cart_state_expires_after_seven_days(spark, products_seed, scratch):
    src = os.path.join(scratch, "carts")
    sch = "session_id string, seq long, action string, product_id long, quantity int, ts timestamp_ntz"
    first = [("a", 1, "add", 2, 1, dt.datetime(2024, 1, 1)), ("b", 2, "add", 3, 2, dt.datetime(2024, 1, 1))]
    later = [("b", 3, "add", 3, 1, dt.datetime(2024, 1, 9)), ("c", 4, "add", 1, 1, dt.datetime(2024, 1, 10))]
    out, ck = os.path.join(scratch, "out"), os.path.join(scratch, "ck")

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
    for i, rows in enumerate([first, later]):
        spark.createDataFrame(rows, sch).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        stream = spark.readStream.schema(sch).parquet(os.path.join(src, "*"))
        q = (J.cart_state_stream(stream, products_seed).writeStream.outputMode("update")
             .option("checkpointLocation", ck).foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()
    res = spark.read.parquet(out)
    assert rows_of(res.filter("expired"), "session_id", "product_id", "quantity") == [("a", 2, 1)]
    live = res.filter("NOT expired AND session_id = 'b'").orderBy(F.desc("batch_id")).first()
    assert live.quantity == 3


def test_dashboard_and_diff(spark, orders_small, scratch):
    agg = J.dashboard_counts(orders_small)
    got = {(r.dimension, r.value): r.order_count for r in agg.collect()}
    assert got[("total", "all")] == 10 and got[("category", "Technology")] == 5
    new = orders_small.filter("order_id <> 1").withColumn(
        "status", F.when(F.col("order_id") == 2, "delivered").otherwise(F.col("status")))
    d = {r.order_id: (r.action, r.old_status, r.new_status) for r in J.diff_snapshots(orders_small, new).collect()}
    assert d == {1: ("deleted", "Order Finished", None), 2: ("updated", "Order Finished", "delivered")}
    ev = J.change_events(J.diff_snapshots(orders_small, new), F.lit(AS_OF).cast("timestamp_ntz"))
    assert sorted(r.event_type for r in ev.collect()) == ["order.deleted", "order.status_changed", "order.updated"]


def test_changelog_layout_matches_batch(spark, orders_small, scratch):
    b1 = [(1, "update_order", {"order_id": "3", "status": "shipped"}),
          (2, "create_order", {"customer_name": "Zed", "quantity": "2", "subtotal_amount": "20.00",
                               "category": "T", "subcategory": "P"}),
          (3, "delete_order", {"order_id": "10"})]
    b2 = [(4, "delete_order", {"order_id": "11"}), (5, "update_order", {"order_id": "5", "quantity": "7"}),
          (6, "create_order", {"customer_name": "Yan", "quantity": "1", "subtotal_amount": "5",
                               "category": "F", "subcategory": "C"}),
          (7, "update_order", {"order_id": "12", "status": "late"})]
    queue, state = os.path.join(scratch, "queue"), os.path.join(scratch, "state")
    schema = "seq long, action string, data string"
    for i, rows in enumerate([b1, b2]):
        _write_cmds(spark, os.path.join(queue, f"part{i}"), rows)
        src = spark.readStream.schema(schema).json(os.path.join(queue, "*"))
        q = J.start_command_stream(spark, src, state, orders_small, as_of=AS_OF,
                                   trigger={"availableNow": True}, layout="changelog")
        q.awaitTermination()
    view = J.changelog_view(spark, state, orders_small)
    all_cmds = spark.createDataFrame([(s, a, json.dumps(d)) for s, a, d in b1 + b2], schema)
    expect = CH.apply_order_commands(orders_small, all_cmds, as_of=AS_OF)["target"]
    assert rows_of(view) == rows_of(expect)
    log = spark.read.parquet(os.path.join(state, "changelog"))
    assert log.count() <= 6                      # only touched rows are written


def test_compact_changelog(spark, orders_small, scratch):
    queue, state = os.path.join(scratch, "queue"), os.path.join(scratch, "state")
    _write_cmds(spark, os.path.join(queue, "p0"), [(1, "delete_order", {"order_id": "1"}),
                                                   (2, "update_order", {"order_id": "2", "status": "x"})])
    src = spark.readStream.schema("seq long, action string, data string").json(os.path.join(queue, "*"))
    J.start_command_stream(spark, src, state, orders_small, as_of=AS_OF, trigger={"availableNow": True},
                           layout="changelog").awaitTermination()
    out = os.path.join(scratch, "snapshot2")
    J.compact_changelog(spark, state, orders_small, out)
    snap = spark.read.parquet(out)
    assert snap.count() == 9 and snap.filter("order_id = 2").first().status == "x"


NEW = {"customer_name": "Zed", "quantity": "2", "subtotal_amount": "20.00", "category": "T", "subcategory": "P"}
CMDS = "seq long, action string, data string"


def _batch(spark, *rows):
    return spark.createDataFrame([(s, a, json.dumps(d)) for s, a, d in rows], CMDS)


@pytest.mark.parametrize("layout", ["snapshot", "changelog"])
def test_ids_are_never_given_twice(spark, orders_small, scratch, layout):
    """Deleting the highest id, or creating and deleting within one batch, frees no id."""
    base = os.path.join(scratch, layout)
    write = J.command_batch_writer(spark, base, orders_small, AS_OF) if layout == "snapshot" else \
        J.changelog_batch_writer(spark, base, orders_small, AS_OF)
    write(_batch(spark, (1, "delete_order", {"order_id": "10"})), 0)
    write(_batch(spark, (2, "create_order", NEW), (3, "delete_order", {"order_id": "11"})), 1)
    write(_batch(spark, (4, "create_order", NEW)), 2)
    final = J.current_orders(spark, base) if layout == "snapshot" else J.changelog_view(spark, base, orders_small)
    assert sorted(r.order_id for r in final.collect()) == [*range(1, 10), 12]


@pytest.mark.parametrize("layout", ["snapshot", "changelog"])
def test_an_unreadable_manifest_fails_the_batch(spark, orders_small, scratch, layout):
    base = os.path.join(scratch, layout)
    write = J.command_batch_writer(spark, base, orders_small, AS_OF) if layout == "snapshot" else \
        J.changelog_batch_writer(spark, base, orders_small, AS_OF)
    write(_batch(spark, (1, "create_order", NEW)), 0)
    manifest = os.path.join(base, "_manifests", "batch=0")
    for name in os.listdir(manifest):
        if name.endswith(".json"):
            with open(os.path.join(manifest, name), "w") as f:
                f.write("not json")
            crc = os.path.join(manifest, f".{name}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    with pytest.raises(Exception):
        write(_batch(spark, (2, "create_order", NEW)), 1)
    assert not os.path.exists(os.path.join(base, "_manifests", "batch=1"))


def test_cart_state_shows_emptied_carts_over_triggers(spark, products_seed, scratch):
    """A clear in a later trigger replaces the lines before; an older event time doesn't bring the expiry forward."""
    src, out, ck = (os.path.join(scratch, n) for n in ("clears", "clears-out", "clears-ck"))
    sch = "session_id string, seq long, action string, product_id long, quantity int, ts timestamp_ntz"
    parts = [[("a", 1, "add", 2, 1, dt.datetime(2024, 1, 2)), ("b", 2, "add", 3, 2, dt.datetime(2024, 1, 2))],
             [("a", 3, "clear", None, None, dt.datetime(2024, 1, 2)), ("b", 4, "add", 3, 1, dt.datetime(2024, 1, 1, 23, 30))],
             [("c", 5, "add", 1, 1, dt.datetime(2024, 1, 9, 0, 45))]]

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, sch).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        stream = spark.readStream.schema(sch).parquet(os.path.join(src, "*"))
        q = (J.cart_state_stream(stream, products_seed).writeStream.outputMode("update")
             .option("checkpointLocation", ck).foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()
    res = spark.read.parquet(out)
    last = res.filter("session_id = 'a' AND NOT expired").orderBy(F.desc("batch_id")).first()
    assert (last.product_id, last.quantity) == (None, None)
    # the watermark ends at 23:45 on 8 January: past b's older event plus 7 days, not past its newest
    assert res.filter("session_id = 'b' AND expired").count() == 0
    assert res.filter("session_id = 'b'").orderBy(F.desc("batch_id")).first().quantity == 3


def test_event_payloads(spark, orders_small):
    ts = F.lit(AS_OF).cast("timestamp_ntz")
    new = orders_small.filter("order_id <> 1").withColumn(
        "status", F.when(F.col("order_id") == 2, "delivered").otherwise(F.col("status")))
    ev = {r.event_type: json.loads(r.data) for r in
          J.change_events(J.diff_snapshots(orders_small, new, ts=ts), ts, source="shop").collect()}
    assert ev["order.deleted"] == {"order_id": 1}
    assert ev["order.status_changed"] == {"order_id": 2, "old_status": "Order Finished", "new_status": "delivered"}
    assert ev["order.updated"]["status"] == "delivered" and "customer_name" in ev["order.updated"]
    asked = spark.createDataFrame([(1, "1, 2, x, 2"), (2, ""), (3, None)], "batch_id long, ids string")
    bulk = {r.batch_id: json.loads(r.data) for r in J.bulk_status_events(asked, orders_small, "shipped", ts).collect()}
    assert bulk[1] == {"order_ids": [1, 2, 2], "new_status": "shipped", "updated_count": 2}
    assert bulk[2]["updated_count"] == bulk[3]["updated_count"] == 0
    day = spark.createDataFrame([(dt.date(2024, 1, 1), "click", 3, 4.5)], "day date, status string, event_count long, amount double")
    (row,) = J.daily_summary_events(day, ts).collect()
    assert row.event_type == "report.daily_summary"
    assert json.loads(row.data) == {"day": "2024-01-01", "status": "click", "event_count": 3, "amount": 4.5}


def test_daily_summary_accounts_for_late_rows(spark, scratch):
    """Closed days plus corrections are all rows of closed days; rows without a time go to the late rows."""
    src, state = os.path.join(scratch, "late-in"), os.path.join(scratch, "late-state")
    sch = "t timestamp, status string, amount double"

    def at(day, hour=0):
        return dt.datetime(2024, 1, day, hour)
    parts = [[(at(1, 5), "a", 1.0), (at(1, 6), None, 2.0), (at(2, 0), "a", 4.0)],      # watermark 1 January 23:00: nothing closes
             [(at(1, 23), "a", 8.0), (at(2, 1), "a", 16.0)],                            # in time; closes the first
             [(at(1, 4), "a", 32.0), (at(1, 4), "b", 64.0), (None, "a", 1.0), (at(3, 2), "a", 2.0)],
             [(at(2, 9), "a", 128.0)], []]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, sch).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        stream = spark.readStream.schema(sch).parquet(os.path.join(src, "*"))
        DY.start_daily_summary(stream, state, trigger={"availableNow": True}).awaitTermination()
    closed = rows_of(DY.closed_days(spark, state), F.col("day").cast("string"), "status", "event_count", F.col("amount").cast("int"))
    assert closed == [("2024-01-01", "a", 2, 9), ("2024-01-01", None, 1, 2), ("2024-01-02", "a", 2, 20)]
    late = rows_of(DY.corrections(spark, state), F.col("day").cast("string"), "status", "event_count", F.col("amount").cast("int"))
    assert late == [("2024-01-01", "a", 1, 32), ("2024-01-01", "b", 1, 64), ("2024-01-02", "a", 1, 128)]
    assert spark.read.parquet(os.path.join(state, "late")).where("t IS NULL").count() == 1
    man = spark.read.json(os.path.join(state, "_manifests")).agg(F.sum("rows"), F.sum("late_rows")).first()
    assert tuple(man) == (10, 4)
    # a replayed batch whose manifest exists changes nothing
    DY.summary_batch_writer(spark, state)(spark.createDataFrame(parts[0], sch), 0)
    assert DY.closed_days(spark, state).count() == 3
    ev = DY.correction_events(DY.corrections(spark, state), F.lit(AS_OF).cast("timestamp_ntz")).first()
    assert ev.event_type == "report.daily_summary_correction" and json.loads(ev.data)["event_count"] == 1
