"""Registered data-quality queries (W1, T1, A11-A21, P8-P18) on the
defect-injected order table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import rules as R
from ..operators import profile as PF
from ..operators import quality as Q
from ..sources import testdata as td
from ..streaming.jobs import run_dir
from .registered import SOD, oracle, register

KEYS = ", ".join(S.DUPLICATE_KEYS)
MONEY_COLS = ("subtotal_amount", "tax_rate", "shipping_cost")


def _dirty(spark, d):
    return td.sales_orders_dirty(spark, d)


# -- W1 / A18 ------------------------------------------------------------------

@register("w1_mark_duplicates", SOD + f"""
SELECT order_id, COALESCE(ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY order_id) > 1, false)
         AS is_duplicate
FROM so""")
def q_w1(spark, d):
    return Q.mark_duplicates(_dirty(spark, d), unique_ids=True).select("order_id", "is_duplicate")


@register("w1_drop_duplicates", oracle(SOD + f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY order_id) AS rn FROM so) t
WHERE rn = 1""", doubles=MONEY_COLS, texts=("order_date",), bigints=("quantity",)))
def q_w1_drop(spark, d):
    return Q.drop_duplicates_keep_first(_dirty(spark, d), unique_ids=True)


#: The table with some rows twice more: as they are, and with another status.
_REPEATED = SOD + """, rep AS (
  SELECT * FROM so UNION ALL SELECT * FROM so WHERE order_id % 3 = 0
  UNION ALL SELECT * REPLACE ('again' AS status) FROM so WHERE order_id % 5 = 0)"""


def _repeated(spark, d):
    df = _dirty(spark, d)
    again = df.filter("order_id % 5 = 0").withColumn("status", F.lit("again"))
    return df.unionByName(df.filter("order_id % 3 = 0")).unionByName(again)


@register("w1_mark_repeated_rows", _REPEATED + f"""
SELECT order_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE rn > 1) AS flagged FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY order_id) AS rn FROM rep) t
GROUP BY order_id""")
def q_w1_repeated(spark, d):
    """Rows that share an id, identical ones too: one of them stays unflagged."""
    return Q.mark_duplicates(_repeated(spark, d)).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_duplicate").alias("flagged"))


@register("w1_drop_repeated_rows", _REPEATED + f"""
SELECT order_id, customer_name, category, CAST(quantity AS BIGINT) AS quantity FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY order_id) AS rn FROM rep) t
WHERE rn = 1""")
def q_w1_drop_repeated(spark, d):
    return Q.drop_duplicates_keep_first(_repeated(spark, d)).select("order_id", "customer_name", "category", "quantity")


@register("a18_duplicate_report", SOD + f"""
SELECT COUNT(*) AS total_records, COUNT(*) FILTER (WHERE rn > 1) AS duplicates_found,
       COUNT(*) FILTER (WHERE rn > 1) AS cleaned_records, CAST(0 AS BIGINT) AS errors,
       COUNT(*) FILTER (WHERE rn > 1) AS warnings
FROM (SELECT ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY order_id) AS rn FROM so) t""")
def q_a18(spark, d):
    return Q.duplicate_report(_dirty(spark, d))


@register("a18_duplicate_examples", oracle(SOD + f"""
SELECT order_id, customer_name, order_date, category FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY order_id) AS rn FROM so) t
WHERE rn > 1 ORDER BY order_id LIMIT 10""", texts=("order_date",)))
def q_a18_ex(spark, d):
    return Q.duplicate_examples(_dirty(spark, d), n=10, unique_ids=True)


# -- A19 --------------------------------------------------------------------------

def _incomplete_sql_rules():
    """(rule, severity, field, SQL predicate) of the incomplete check."""
    out = [(f"null_{c}", "warning", c, f"{c} IS NULL") for c in S.REQUIRED_FIELDS]
    out += [(f"empty_{c}", "warning", c, f"{c} = ''") for c in S.TEXT_FIELDS]
    out += [(f"negative_{c}", "error", c, f"{c} < 0") for c in S.NUMERIC_FIELDS]
    out.append(("tax_rate_over_100pct", "error", "tax_rate", "tax_rate > 1.0"))
    return out


def _validation_sql_rules():
    out = [(f"non_numeric_{c}", "warning", c, f"{c} IS NULL") for c in S.NUMERIC_FIELDS]
    out.append(("invalid_order_date", "warning", "order_date", "order_date IS NULL"))
    out.append(("extreme_quantity", "warning", "quantity", "quantity > 1000 OR quantity = 0"))
    out.append(("extreme_subtotal_amount", "warning", "subtotal_amount", "subtotal_amount > 100000"))
    out.append(("extreme_shipping_cost", "warning", "shipping_cost", "shipping_cost > 1000"))
    statuses = ", ".join(f"'{s}'" for s in S.VALID_STATUSES)
    out.append(("invalid_status", "warning", "status",
                f"NOT COALESCE(lower(status) IN ({statuses}), false)"))
    return out


def _hits_sql(rule_set, rules):
    return "\nUNION ALL\n".join(
        f"SELECT '{rule_set}' AS rule_set, '{n}' AS rule, '{sev}' AS severity, '{f}' AS field, "
        f"COUNT(*) FILTER (WHERE {p}) AS hits FROM so" for n, sev, f, p in rules)


def _any_sql(rules):
    return " OR ".join(f"COALESCE({p}, false)" for _, _, _, p in rules)


def _sum_hits_sql(rules, sev):
    return " + ".join(f"COUNT(*) FILTER (WHERE {p})" for _, s, _, p in rules if s == sev)


_INC = _incomplete_sql_rules()
_VAL = _validation_sql_rules()


@register("a19_incomplete_report", SOD + f"""
SELECT COUNT(*) AS total_records,
       COUNT(DISTINCT CASE WHEN {_any_sql(_INC)} THEN order_id END) AS cleaned_records,
       CAST({_sum_hits_sql(_INC, 'error')} AS BIGINT) AS errors,
       CAST({_sum_hits_sql(_INC, 'warning')} AS BIGINT) AS warnings
FROM so""")
def q_a19(spark, d):
    return Q.incomplete_report(_dirty(spark, d))


@register("a19_incomplete_rule_hits", SOD + _hits_sql("incomplete", _INC))
def q_a19_hits(spark, d):
    return Q.incomplete_rule_hits(_dirty(spark, d))


@register("a19_incomplete_ids_first20", SOD + f"""
SELECT DISTINCT order_id FROM so WHERE {_any_sql(_INC)} ORDER BY order_id LIMIT 20""")
def q_a19_ids(spark, d):
    return Q.incomplete_ids(_dirty(spark, d), n=20)


@register("t1_incomplete_ids", SOD + f"""
SELECT DISTINCT order_id FROM so WHERE {_any_sql(_INC)}""")
def q_t1(spark, d):
    return Q.incomplete_ids(_dirty(spark, d), n=None)


# -- A20 --------------------------------------------------------------------------

@register("a20_validation_rule_hits", SOD + _hits_sql("validation", _VAL))
def q_a20_hits(spark, d):
    return Q.validation_rule_hits(_dirty(spark, d))


@register("a20_validation_report", SOD + f"""
SELECT COUNT(*) AS total_records, CAST(0 AS BIGINT) AS cleaned_records, CAST(0 AS BIGINT) AS errors,
       CAST({_sum_hits_sql(_VAL, 'warning')} AS BIGINT) AS warnings,
       COUNT(*) FILTER (WHERE {_any_sql(_VAL)}) AS rows_with_issues
FROM so""")
def q_a20(spark, d):
    return Q.validation_report(_dirty(spark, d))


@register("p17_model_violations", SOD + """
SELECT order_id, array_to_string(list_filter([
         CASE WHEN quantity < 0 THEN 'quantity_ge_0' END,
         CASE WHEN subtotal_amount < 0 THEN 'subtotal_amount_ge_0' END,
         CASE WHEN tax_rate < 0 THEN 'tax_rate_ge_0' END,
         CASE WHEN shipping_cost < 0 THEN 'shipping_cost_ge_0' END,
         CASE WHEN tax_rate > 1 THEN 'tax_rate_le_1' END], lambda x: x IS NOT NULL), ',') AS violations
FROM so
WHERE quantity < 0 OR subtotal_amount < 0 OR tax_rate < 0 OR shipping_cost < 0 OR tax_rate > 1""")
def q_p17(spark, d):
    df = _dirty(spark, d)
    _, bad = R.split_valid(df, R.order_model_rules(df.schema))
    return bad.select("order_id", F.array_join("violations", ",").alias("violations"))


# -- A11-A17, A21 -----------------------------------------------------------------

_PROFILE_NUMERIC = ["order_id", "quantity", "subtotal_amount", "tax_rate", "shipping_cost"]
_ALL_COLS = ["order_id"] + S.ORDER_FIELDS


def _profile_sql():
    parts = []
    for c in _ALL_COLS:
        if c in _PROFILE_NUMERIC:
            stats = (f"COALESCE(CAST(SUM({c}) AS DOUBLE) / NULLIF(COUNT({c}), 0), 0.0) AS mean, "
                     f"COALESCE(MIN(CAST({c} AS DOUBLE)), 0.0) AS min, "
                     f"COALESCE(MAX(CAST({c} AS DOUBLE)), 0.0) AS max")
        else:
            stats = "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
        parts.append(
            f"SELECT '{c}' AS column, COUNT(*) - COUNT({c}) AS null_count, COUNT({c}) AS non_null_count, "
            f"CASE WHEN COUNT(*) > 0 THEN ((COUNT({c}) * 20000 + COUNT(*)) // (2 * COUNT(*))) / 100.0 END "
            f"AS completeness_pct, {stats} FROM so")
    return "\nUNION ALL\n".join(parts)


@register("a11_column_profile", SOD + _profile_sql())
def q_a11(spark, d):
    return Q.column_profile(_dirty(spark, d))


@register("a15_full_row_duplicates", SOD + f"""
SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) AS n FROM so GROUP BY order_id, {', '.join(S.ORDER_FIELDS)}) t""")
def q_a15(spark, d):
    return Q.full_row_duplicates(_dirty(spark, d))


@register("a13_status_counts", SOD + """
SELECT status, COUNT(*) AS count FROM so WHERE status IS NOT NULL GROUP BY status""")
def q_a13(spark, d):
    return Q.status_counts(_dirty(spark, d))


@register("a21_kpis", SOD + """
SELECT COUNT(*) AS total_orders,
       COUNT(*) FILTER (WHERE status = 'Order Finished') AS completed_orders,
       COUNT(DISTINCT category) AS category_count FROM so""")
def q_a21(spark, d):
    return Q.kpis(_dirty(spark, d))


@register("a16_quality_overview", SOD + f"""
, dup AS (SELECT COUNT(*) AS total_records, COUNT(*) FILTER (WHERE rn > 1) AS duplicates
          FROM (SELECT ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY order_id) AS rn FROM so) t),
inc AS (SELECT COUNT(DISTINCT CASE WHEN {_any_sql(_INC)} THEN order_id END) AS incomplete,
               COUNT(*) AS total FROM so),
prof AS ({_profile_sql()})
SELECT 'total_records' AS metric, CAST(total_records AS DOUBLE) AS value FROM dup
UNION ALL SELECT 'duplicates', CAST(duplicates AS DOUBLE) FROM dup
UNION ALL SELECT 'unique_records', CAST(total_records - duplicates AS DOUBLE) FROM dup
UNION ALL SELECT 'incomplete', CAST(incomplete AS DOUBLE) FROM inc
UNION ALL SELECT 'valid_records', CAST(total - incomplete AS DOUBLE) FROM inc
UNION ALL SELECT 'duplicate_rows', CAST(COALESCE(SUM(n - 1), 0) AS DOUBLE)
          FROM (SELECT COUNT(*) AS n FROM so GROUP BY ALL_COLS) f
UNION ALL SELECT 'mean_completeness_pct', CAST(AVG(CAST(completeness_pct AS DECIMAL(10,2))) AS DOUBLE) FROM prof
UNION ALL SELECT 'column_count', CAST({len(_ALL_COLS)} AS DOUBLE)
""".replace("ALL_COLS", ", ".join(_ALL_COLS)))
def q_a16(spark, d):
    return Q.quality_overview(_dirty(spark, d))


# -- A9 / A11 / A12 / A14 / A16: mergeable profile ----------------------------

_PROFILED = ["order_id", "status", "customer_name", "order_date", "quantity", "subtotal_amount", "tax_rate", "category"]
_NUMBERS = ("order_id", "quantity", "subtotal_amount", "tax_rate")


def _refreshed_sql():
    """Full profile of the order table after one year was replaced."""
    def one(c):
        number, text = (f"CAST({c} AS DOUBLE)", "CAST(NULL AS VARCHAR)") if c in _NUMBERS else ("CAST(NULL AS DOUBLE)", f"CAST({c} AS VARCHAR)")
        total = f"CAST(SUM(CAST({c} AS DECIMAL(38,10))) AS DOUBLE)" if c in _NUMBERS else "CAST(NULL AS DOUBLE)"
        return f"""SELECT '{c}' AS "column", COUNT(*) AS rows, COUNT({c}) AS non_null, {total} AS total, MIN({number}) AS low_number,
       MAX({number}) AS high_number, MIN({text}) AS low_text, MAX({text}) AS high_text, TRUE AS distinct_close FROM t"""
    return SOD + """, t AS (SELECT * REPLACE (CASE WHEN year(order_date) = 1995 THEN quantity + 1000 ELSE quantity END AS quantity,
                      CASE WHEN year(order_date) = 1995 THEN 'archived' ELSE status END AS status) FROM so)
""" + "\nUNION ALL\n".join(one(c) for c in _PROFILED)


@register("a16_profile_refresh", _refreshed_sql())
def q_a16_refresh(spark, d):
    """The profile of all orders after one year was replaced, from the kept
    profiles of the other years and a scan of that year alone."""
    base = run_dir(spark, "profile")
    table, kept = os.path.join(base, "orders"), os.path.join(base, "profiles")
    so = _dirty(spark, d).select(*_PROFILED).withColumn("year", F.year("order_date"))
    so.write.partitionBy("year").parquet(table)
    year = F.col("year")
    PF.partition_profiles(spark.read.parquet(table), year, _PROFILED).write.parquet(kept)
    is_new = year == 1995
    new = so.where(is_new).withColumn("quantity", F.col("quantity") + 1000).withColumn("status", F.lit("archived"))
    new.drop("year").write.mode("overwrite").parquet(os.path.join(table, "year=1995"))
    now = spark.read.parquet(table)
    prof = PF.merge_profiles(PF.refreshed(spark.read.parquet(kept), now.where(is_new), year, _PROFILED))
    exact = now.agg(*[F.count_distinct(c).alias(c) for c in _PROFILED]).unpivot([], _PROFILED, "column", "distinct")
    close = F.abs(F.col("distinct_estimate") - F.col("distinct")) <= F.greatest(F.lit(1), F.col("distinct") * 0.07)
    return prof.join(exact, "column").select(
        "column", "rows", "non_null", *[F.col(c).cast("double").alias(c) for c in ("total", "low_number", "high_number")],
        "low_text", "high_text", close.alias("distinct_close"))
