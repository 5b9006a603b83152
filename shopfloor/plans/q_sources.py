"""Registered source/sink round trips.

Each writes Spark-derived data from the test tables to a fresh folder under
the shared checkpoint folder, reads it back through the library's
readers, and returns the result.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import reconcile as RC
from ..sources import files as FS
from ..sources import json_array as JA
from ..sources import testdata as td
from ..streaming import jobs as J
from .q_changes import ORDER_CASTS
from .registered import SO, SOD, oracle, register


def _dir(spark, name):
    return J.run_dir(spark, name)


@register("s5_csv_roundtrip", oracle(SO + "SELECT * FROM so", **ORDER_CASTS))
def q_s5(spark, d):
    p = os.path.join(_dir(spark, "csv"), "orders")
    FS.write_csv(td.sales_orders(spark, d), p)
    return FS.read_orders(spark, p, "csv").drop("_corrupt_record")


@register("s6_json_roundtrip", SO + """
SELECT order_id, status, customer_name, strftime(order_date, '%Y-%m-%d') AS order_date, CAST(quantity AS BIGINT) AS quantity,
       CAST(subtotal_amount AS DOUBLE) AS subtotal_amount, CAST(tax_rate AS DOUBLE) AS tax_rate,
       CAST(shipping_cost AS DOUBLE) AS shipping_cost, category, subcategory FROM so""")
def q_s6(spark, d):
    p = os.path.join(_dir(spark, "json"), "orders")
    FS.write_json(td.sales_orders(spark, d), p)
    sch = ("order_id long, status string, customer_name string, order_date string, quantity long, "
           "subtotal_amount double, tax_rate double, shipping_cost double, category string, subcategory string")
    return spark.read.schema(sch).json(p)


# Through CSV an empty text field reads back as NULL (as with pandas'
# read_csv in the reference's importer), so '' fails NOT NULL as well.
_GOOD = " AND ".join([f"NULLIF({c}, '') IS NOT NULL" if c in S.TEXT_FIELDS else f"{c} IS NOT NULL"
                      for c in S.ORDER_FIELDS]
                     + ["quantity >= 0", "subtotal_amount >= 0", "tax_rate >= 0", "shipping_cost >= 0",
                        "tax_rate <= 1"])


def _import(spark, d):
    p = os.path.join(_dir(spark, "import"), "orders.csv")
    FS.write_csv(td.sales_orders_dirty(spark, d), p)
    raw = FS.with_file_order(FS.read_orders(spark, p, "csv", raw=True))
    return FS.import_orders(td.sales_orders(spark, d), raw)


@register("s7_csv_import_upsert", oracle(f"WITH clean AS ({td.SALES_ORDERS_SQL}), dirty AS ({td.SALES_ORDERS_DIRTY_SQL}),\n"
                                         f"good AS (SELECT * FROM dirty WHERE {_GOOD})\n" + """
SELECT * FROM clean WHERE order_id NOT IN (SELECT order_id FROM good) UNION ALL SELECT * FROM good""",
                                         **ORDER_CASTS))
def q_s7(spark, d):
    return _import(spark, d)["target"]


@register("s7_import_rejects", f"WITH dirty AS ({td.SALES_ORDERS_DIRTY_SQL})\n"
          f"SELECT CAST(order_id AS BIGINT) AS order_id FROM dirty WHERE NOT ({_GOOD})")
def q_s7_rej(spark, d):
    return _import(spark, d)["rejects"].select(F.col("order_id").cast("bigint").alias("order_id"))


def _text_import(spark, d):
    """An all-text import of every order: whole numbers as 3.0 and 1e3, numbers
    too long for their column, texts for dates, and broken lines."""
    p = os.path.join(_dir(spark, "text-import"), "orders")
    oid = F.col("order_id")
    rows = td.sales_orders(spark, d).select(
        oid, F.lit("imported").alias("status"), "customer_name",
        F.when(oid % 17 == 0, "soon").otherwise(F.col("order_date").cast("string")).alias("order_date"),
        F.when(oid % 11 == 0, "99999999999").when(oid % 7 == 0, "1e3").when(oid % 5 == 0, F.concat("quantity", F.lit(".0")))
         .otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(oid % 13 == 0, "1" + "0" * 20).otherwise(F.col("subtotal_amount").cast("string")).alias("subtotal_amount"),
        "tax_rate", "shipping_cost", "category", "subcategory")
    line = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in rows.columns]))
    rows.select(F.when(oid % 19 == 0, F.substring(line, 1, 5)).otherwise(line).alias("value")).write.text(p)
    raw = FS.with_file_order(FS.read_orders(spark, p, "json", raw=True))
    return FS.import_orders(td.sales_orders(spark, d), raw)


_TEXT_BAD = f"(order_id % 11 = 0 OR order_id % 13 = 0 OR order_id % 17 = 0 OR order_id % 19 = 0 OR NOT ({_GOOD}))"


@register("s8_text_import_upsert", oracle(SO + f"""
SELECT * REPLACE (CASE WHEN {_TEXT_BAD} THEN status ELSE 'imported' END AS status,
                  CASE WHEN {_TEXT_BAD} OR order_id % 7 <> 0 THEN quantity ELSE 1000 END AS quantity) FROM so""", **ORDER_CASTS))
def q_s8(spark, d):
    return _text_import(spark, d)["target"]


@register("s8_text_import_rejects", SO + f"""
SELECT CASE WHEN order_id % 19 <> 0 THEN order_id END AS order_id, order_id % 19 = 0 AS malformed FROM so
WHERE {_TEXT_BAD}""")
def q_s8_rej(spark, d):
    return _text_import(spark, d)["rejects"].select(F.col("order_id").cast("bigint").alias("order_id"),
                                                    F.array_contains("violations", "malformed").alias("malformed"))


def _array_import(spark, d):
    """One JSON array document with all orders, read by ranges of 64 KB: texts with
    quotes, brackets, commas and backslashes, blanks, nested values, broken elements."""
    p = os.path.join(_dir(spark, "array-import"), "orders.json")
    oid = F.col("order_id")
    rows = td.sales_orders(spark, d).withColumn("status", F.when(oid % 3 == 0, F.lit('a "b\\\\", [{c}], \\')).otherwise("imported")) \
        .withColumn("extra", F.when(oid % 5 == 0, F.array(F.struct(F.lit("x]},\"").alias("k")))))
    element = F.when(oid % 19 == 0, F.concat(F.lit('{"order_id": oops '), oid, F.lit("}"))).otherwise(
        F.to_json(F.struct(*[F.col(c) if c == "extra" else F.col(c).cast("string").alias(c) for c in rows.columns])))
    # one file, as the reference's exporter writes it, in the order of the ids
    JA.write_document(rows.orderBy("order_id").select(F.concat(F.lit("  "), element, F.lit(" ,")).alias("value")), p,
                      "[\n", '{"order_id": "-1"}]\n')
    return FS.import_orders(td.sales_orders(spark, d), FS.read_order_array(spark, p, raw=True, range_bytes=64 << 10))


_ARRAY_BAD = f"(order_id % 19 = 0 OR NOT ({_GOOD}))"


@register("s8_array_import_upsert", oracle(SO + f"""
SELECT * REPLACE (CASE WHEN {_ARRAY_BAD} THEN status WHEN order_id % 3 = 0 THEN 'a "b\\\\", [{{c}}], \\' ELSE 'imported' END AS status)
FROM so""", **ORDER_CASTS))
def q_s8_array(spark, d):
    return _array_import(spark, d)["target"]


@register("s8_array_import_rejects", SO + f"""
SELECT CASE WHEN order_id % 19 <> 0 THEN order_id END AS order_id, order_id % 19 = 0 AS malformed FROM so WHERE {_ARRAY_BAD}
UNION ALL SELECT -1, FALSE""")
def q_s8_array_rej(spark, d):
    return _array_import(spark, d)["rejects"].select(F.col("order_id").cast("bigint").alias("order_id"),
                                                     F.array_contains("violations", "malformed").alias("malformed"))


@register("s13_bi_feed", oracle(SO + """
SELECT order_id, status, customer_name, order_date, quantity, subtotal_amount, tax_rate, shipping_cost,
       category, subcategory, CAST(year(order_date) AS BIGINT) AS year, CAST(month(order_date) AS BIGINT) AS month,
       CAST(quarter(order_date) AS BIGINT) AS quarter FROM so""", **ORDER_CASTS))
def q_s13(spark, d):
    p = os.path.join(_dir(spark, "bi"), "orders")
    FS.bi_feed(td.sales_orders(spark, d), p)
    return spark.read.parquet(p).withColumn("year", F.col("year").cast("bigint"))


@register("s13_bi_feed_meta", SO + "SELECT COUNT(*) AS total_records FROM so")
def q_s13_meta(spark, d):
    p = os.path.join(_dir(spark, "bi"), "orders")
    return FS.bi_feed(td.sales_orders(spark, d), p).select("total_records")


@register("s14_verify_reconcile", SOD + f", clean AS ({td.SALES_ORDERS_SQL})\n" + """
SELECT 'missing' AS side, COUNT(*) AS rows FROM (SELECT * FROM so EXCEPT ALL SELECT * FROM clean) a
UNION ALL
SELECT 'unexpected', COUNT(*) FROM (SELECT * FROM clean EXCEPT ALL SELECT * FROM so) b""")
def q_s14(spark, d):
    p = os.path.join(_dir(spark, "verify"), "orders")
    FS.write_csv(td.sales_orders(spark, d), p)
    loaded = FS.read_orders(spark, p, "csv").drop("_corrupt_record")
    v = FS.verify_import(td.sales_orders_dirty(spark, d), loaded)
    return (v["missing"].agg(F.lit("missing").alias("side"), F.count(F.lit(1)).alias("rows"))
            .unionByName(v["unexpected"].agg(F.lit("unexpected").alias("side"), F.count(F.lit(1)).alias("rows"))))


# An import that changed some rows, lost some and brought some twice or new.
_CHANGED = f"""{SO}, t AS (
  SELECT * REPLACE (CASE WHEN order_id % 997 = 3 THEN NULL ELSE customer_name END AS customer_name) FROM so WHERE order_id % 1499 <> 5
  UNION ALL SELECT * FROM so WHERE order_id % 2003 = 7),
missing AS (SELECT * FROM so EXCEPT ALL SELECT * FROM t), unexpected AS (SELECT * FROM t EXCEPT ALL SELECT * FROM so)"""
_LEAF = 64


def _changed(spark, d):
    so = td.sales_orders(spark, d)
    i = F.col("order_id")
    t = so.where(i % 1499 != 5).withColumn("customer_name", F.when(i % 997 != 3, F.col("customer_name"))).unionByName(so.where(i % 2003 == 7))
    return RC.reconcile(so, t, "order_id", _LEAF)


@register("s14_checksum_reconcile", oracle(_CHANGED + """
SELECT 'missing' AS side, * FROM missing UNION ALL SELECT 'unexpected', * FROM unexpected""", **ORDER_CASTS))
def q_s14_tree(spark, d):
    """Rows that differ between a table and its import, found by checksums of key ranges."""
    out = _changed(spark, d)
    return out["missing"].select(F.lit("missing").alias("side"), "*").unionByName(
        out["unexpected"].select(F.lit("unexpected").alias("side"), "*"))


@register("s14_checksum_ranges", _CHANGED + f"""
SELECT DISTINCT order_id // {_LEAF} AS leaf FROM (SELECT order_id FROM missing UNION ALL SELECT order_id FROM unexpected) x""")
def q_s14_ranges(spark, d):
    """The key ranges whose rows are compared one by one: those that differ, and no other."""
    return _changed(spark, d)["leaves"]


@register("s15_envelope_sink", f"WITH products AS ({td.PRODUCTS_SQL})\n" + """
SELECT 'inventory.low_stock' AS event_type, 'shopfloor' AS source, name AS product,
       CAST(stock_quantity AS BIGINT) AS current_stock, CAST(5 AS BIGINT) AS threshold FROM products WHERE stock_quantity < 5""")
def q_s15(spark, d):
    p = os.path.join(_dir(spark, "envelopes"), "events")
    alerts = J.low_stock_alerts(td.products(spark, d), 5, F.current_timestamp())
    FS.write_envelopes(alerts, p)
    back = spark.read.schema("event_type string, timestamp string, source string, data string").json(p)
    return back.select("event_type", "source",
                       F.get_json_object("data", "$.product").alias("product"),
                       F.get_json_object("data", "$.current_stock").cast("long").alias("current_stock"),
                       F.get_json_object("data", "$.threshold").cast("long").alias("threshold"))
