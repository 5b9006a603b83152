
from domain_rows import product_rows, rows_of
from pyspark.sql import functions as F

from shopfloor import schemas as S
from shopfloor.operators import catalog as C
from shopfloor.operators import dedupe as D
from shopfloor.operators import ids as I


def test_search_and_listing(spark, products_seed):
    hits = C.search_products(products_seed, term="desk", min_price=30, max_price=499.99)
    assert [r.name for r in hits.collect()] == ["Desk Lamp", "Standing Desk"]
    # % and _ act as wildcards unless escaped (as in the reference)
    assert C.search_products(products_seed, term="_").count() == 10
    assert C.search_products(products_seed, term="_", escape=True).count() == 0
    assert [r.category for r in C.active_categories(products_seed).collect()] == \
        ["Electronics", "Furniture", "Stationery"]


def test_lookup_and_missing(spark, products_seed):
    ids = spark.createDataFrame([(2,), (2,), (99,)], "product_id long")
    assert rows_of(C.lookup(products_seed, ids, "product_id"), "product_id") == [(2,)]
    assert rows_of(C.missing_ids(products_seed, ids, "product_id")) == [(99,)]


def test_dedupe_products_repairs_items(spark):
    rows = product_rows() + product_rows(id_offset=10)
    products = spark.createDataFrame(rows, S.PRODUCTS)
    items = spark.createDataFrame([(1, 100, 2), (2, 100, 12), (3, 101, 20)],
                                  "order_item_id long, customer_order_id long, product_id long")
    out = D.dedupe_products(products, items)
    assert out["products"].count() == 10
    assert sorted(r.product_id for r in out["products"].collect()) == list(range(1, 11))
    assert rows_of(out["items"], "order_item_id", "product_id") == [(1, 2), (2, 2), (3, 10)]
    rep = {r.metric: r.value for r in out["report"].collect()}
    assert rep == {"products_before": 20, "products_after": 10, "products_deleted": 10, "items_repointed": 2}
    summed = D.dedupe_products(products, sum_stock=True)["products"]
    assert summed.filter("product_id = 2").first().stock_quantity == 400


def test_assign_images(spark, products_seed):
    m = spark.createDataFrame([("Desk Lamp", "http://x/lamp.png"), ("Nope", "http://x/nope.png")],
                              "name string, image_url string")
    out = C.assign_images(products_seed, m, as_of="2024-06-01 00:00:00")
    assert out["products"].filter("product_id = 8").first().image_url == "http://x/lamp.png"
    assert rows_of(out["unmatched"]) == [("Nope",)]
    assert out["report"].first().updated_rows == 1


def test_orders_with_items_nested(spark):
    orders = spark.createDataFrame([(1,), (2,)], "customer_order_id long")
    items = spark.range(25).select((F.col("id") + 1).alias("order_item_id"),
                                   F.lit(1).cast("long").alias("customer_order_id"))
    nested = C.orders_with_item_arrays(orders, items, orders).collect()
    lists = {r.customer_order_id: [x.order_item_id for x in r["items"]] for r in nested}
    assert len(nested) == 2 and lists == {1: list(range(1, 26)), 2: []}
    assert C.orders_with_item_arrays(orders, items, orders.limit(0)).count() == 0
    flat = C.orders_with_items(orders, items)
    assert flat.count() == 26


def test_dense_ids_contiguous(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    out = I.dense_ids(df, ["k"], "new_id", base=100)
    got = [(r.k, r.new_id) for r in out.orderBy("k").collect()]
    assert got == [(k, 101 + k) for k in range(1000)]
    base = spark.createDataFrame([(41,)], "order_id long")
    out2 = I.dense_ids(df.limit(3), ["k"], "x", base=I.next_id(base, "order_id"))
    assert sorted(r.x for r in out2.collect()) == [42, 43, 44]


def test_cascade_and_orphans(spark):
    parents = spark.createDataFrame([(1,), (2,)], "customer_order_id long")
    kids = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "id long, customer_order_id long")
    assert rows_of(C.orphans(kids, parents, "customer_order_id", "customer_order_id"), "id") == [(12,)]
    gone = spark.createDataFrame([(2,)], "customer_order_id long")
    assert rows_of(C.cascade_delete(kids, gone, "customer_order_id"), "id") == [(10,), (12,), (13,)]


def test_dense_ids_hold_at_size(spark):
    """Unsorted rows, many or few partitions, a small advisory size: no id is lost or doubled."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))
                                     .alias("pad")).repartition(13, "pad")
    for conf in ({"spark.sql.shuffle.partitions": "200"}, {"spark.sql.shuffle.partitions": "16"},
                 {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
                  "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
        old = {k: spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            out = I.dense_ids(df, ["k"], "new_id", base=0)
            assert out.where("new_id != k + 1").count() == 0
            r = out.agg(F.count("*").alias("n"), F.count_distinct("new_id").alias("d"), F.max("new_id").alias("m")).first()
            assert (r.n, r.d, r.m) == (200_000,) * 3
        finally:
            for k, v in old.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_products_without_a_name_stay(spark, products_seed):
    rows = products_seed.withColumn("name", F.when(F.col("product_id") > 3, F.col("name")))
    out = D.dedupe_products(rows.unionByName(rows.withColumn("product_id", F.col("product_id") + 100)))
    report = {r.metric: r.value for r in out["report"].collect()}
    assert report == {"products_before": 20, "products_after": 8, "products_deleted": 12}
    assert rows_of(out["products"], "product_id") == [(1,), (4,), (5,), (6,), (7,), (8,), (9,), (10,)]
