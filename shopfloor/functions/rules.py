"""Rule registry: row-level quality rules as boolean Columns.

A rule is ``(name, check, severity, field, predicate)``.  Predicates are
built from the DataFrame's schema, so the same rule set works on typed
tables and on all-string import files (then numbers and dates are
coerced with ``try_cast``).  Every predicate is NULL-safe (``coalesce``
to false), so flags can be OR-ed and counted directly.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


@dataclass(frozen=True)
class Rule:
    name: str
    check: str            # "incomplete" | "validation" | user-defined
    severity: str         # "error" | "warning"
    field: str
    predicate: Column     # True when the row breaks the rule


def _is_string(schema: T.StructType, c: str) -> bool:
    return isinstance(schema[c].dataType, T.StringType)


def numeric(schema: T.StructType, c: str) -> Column:
    """The column as a number; strings are coerced (NULL if not numeric)."""
    if _is_string(schema, c):
        return F.expr(f"try_cast(`{c}` AS DECIMAL(38,10))")
    return F.col(c)


def as_date(schema: T.StructType, c: str) -> Column:
    if _is_string(schema, c):
        return F.expr(f"try_cast(`{c}` AS TIMESTAMP)")
    return F.col(c)


def _flag(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def incomplete_rules(schema: T.StructType,
                     required: Iterable[str] = S.REQUIRED_FIELDS,
                     text: Iterable[str] = S.TEXT_FIELDS,
                     numbers: Iterable[str] = S.NUMERIC_FIELDS,
                     tax_limit: float = S.TAX_RATE_LIMIT) -> list[Rule]:
    """Nulls, empty strings (exact ''), negatives, tax rate > 100 %."""
    rules = [Rule(f"null_{c}", "incomplete", "warning", c, F.col(c).isNull())
             for c in required if c in schema.names]
    rules += [Rule(f"empty_{c}", "incomplete", "warning", c, _flag(F.col(c) == ""))
              for c in text if c in schema.names and _is_string(schema, c)]
    rules += [Rule(f"negative_{c}", "incomplete", "error", c, _flag(numeric(schema, c) < 0))
              for c in numbers if c in schema.names]
    if "tax_rate" in schema.names:
        rules.append(Rule("tax_rate_over_100pct", "incomplete", "error", "tax_rate",
                          _flag(numeric(schema, "tax_rate") > F.lit(tax_limit))))
    return rules


def validation_rules(schema: T.StructType,
                     numbers: Iterable[str] = S.NUMERIC_FIELDS,
                     statuses: Iterable[str] = S.VALID_STATUSES,
                     quantity_limit: int = S.QUANTITY_LIMIT,
                     subtotal_limit: int = S.SUBTOTAL_LIMIT,
                     shipping_limit: int = S.SHIPPING_LIMIT) -> list[Rule]:
    """Coercion failures (NULLs count), extremes, status domain."""
    n = lambda c: numeric(schema, c)
    rules = [Rule(f"non_numeric_{c}", "validation", "warning", c, n(c).isNull())
             for c in numbers if c in schema.names]
    if "order_date" in schema.names:
        rules.append(Rule("invalid_order_date", "validation", "warning", "order_date",
                          as_date(schema, "order_date").isNull()))
    if "quantity" in schema.names:
        rules.append(Rule("extreme_quantity", "validation", "warning", "quantity",
                          _flag((n("quantity") > quantity_limit) | (n("quantity") == 0))))
    if "subtotal_amount" in schema.names:
        rules.append(Rule("extreme_subtotal_amount", "validation", "warning", "subtotal_amount",
                          _flag(n("subtotal_amount") > subtotal_limit)))
    if "shipping_cost" in schema.names:
        rules.append(Rule("extreme_shipping_cost", "validation", "warning", "shipping_cost",
                          _flag(n("shipping_cost") > shipping_limit)))
    if "status" in schema.names:
        rules.append(Rule("invalid_status", "validation", "warning", "status",
                          ~F.coalesce(F.lower(F.col("status")).isin(list(statuses)), F.lit(False))))
    return rules


def order_model_rules(schema: T.StructType) -> list[Rule]:
    """P17 for ``orders``: the row model's constraints (>= 0, tax <= 1)."""
    n = lambda c: numeric(schema, c)
    out = [Rule(f"{c}_ge_0", "model", "error", c, _flag(n(c) < 0))
           for c in S.NUMERIC_FIELDS if c in schema.names]
    if "tax_rate" in schema.names:
        out.append(Rule("tax_rate_le_1", "model", "error", "tax_rate", _flag(n("tax_rate") > 1)))
    return out


def product_model_rules(schema: T.StructType) -> list[Rule]:
    """P17 for ``products``: price >= 0, stock >= 0, name present."""
    return [Rule("price_ge_0", "model", "error", "price", _flag(F.col("price") < 0)),
            Rule("stock_quantity_ge_0", "model", "error", "stock_quantity",
                 _flag(F.col("stock_quantity") < 0)),
            Rule("name_required", "model", "error", "name",
                 F.col("name").isNull() | (F.trim(F.col("name")) == ""))]


def customer_info_rules(schema: T.StructType) -> list[Rule]:
    """P17 for checkout customer data: minimum lengths and e-mail shape."""
    def short(c, k):
        return _flag(F.length(F.coalesce(F.col(c), F.lit(""))) < k)
    return [Rule("customer_name_min_2", "model", "error", "customer_name", short("customer_name", 2)),
            Rule("customer_email_invalid", "model", "error", "customer_email",
                 ~F.coalesce(F.col("customer_email").rlike(S.EMAIL_PATTERN), F.lit(False))),
            Rule("shipping_address_min_5", "model", "error", "shipping_address",
                 short("shipping_address", 5)),
            Rule("shipping_city_min_2", "model", "error", "shipping_city", short("shipping_city", 2)),
            Rule("shipping_zip_min_3", "model", "error", "shipping_zip", short("shipping_zip", 3))]


def domain_rule(name: str, field: str, domain: DataFrame, domain_col: str | None = None,
                severity: str = "warning") -> Callable[[DataFrame], DataFrame]:
    """U4: membership in a reference table, as a flag column.

    Returns a function ``df -> df`` that adds ``name`` (true = outside the
    domain).  The domain table is joined, not collected; Spark broadcasts
    it when its measured size is below the broadcast threshold.
    """
    dc = domain_col or field

    def apply(df: DataFrame) -> DataFrame:
        d = domain.select(F.col(dc).alias("_dv")).distinct().withColumn("_in", F.lit(True))
        return (df.join(d, F.col(field) == F.col("_dv"), "left")
                .withColumn(name, F.col("_in").isNull()).drop("_dv", "_in"))
    return apply


def with_flags(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One boolean column per rule, named after it."""
    return df.select("*", *[r.predicate.alias(r.name) for r in rules])


def violations(rules: list[Rule]) -> Column:
    """``array<string>`` of the names of broken rules (empty if none)."""
    hits = F.array(*[F.when(r.predicate, F.lit(r.name)) for r in rules])
    return F.filter(hits, lambda x: x.isNotNull())


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows and a quarantine with a ``violations`` array."""
    tagged = df.withColumn("violations", violations(rules))
    good = tagged.filter(F.size("violations") == 0).drop("violations")
    bad = tagged.filter(F.size("violations") > 0)
    return good, bad


def rule_hits(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Long form ``(rule_set, rule, severity, field, hits)`` from ONE aggregate.

    All counts come out of a single pass (partial + final aggregation);
    the wide row is then turned long with ``stack``.
    """
    wide = df.agg(*[F.count_if(r.predicate).cast("bigint").alias(f"h{i}")
                    for i, r in enumerate(rules)])
    parts = ", ".join(f"'{r.check}', '{r.name}', '{r.severity}', '{r.field}', h{i}"
                      for i, r in enumerate(rules))
    return wide.selectExpr(f"stack({len(rules)}, {parts}) AS (rule_set, rule, severity, field, hits)")


def category_limits(df: DataFrame, limits: DataFrame, name: str = "over_category_limit") -> DataFrame:
    """Rules per category/subcategory from a rules table.

    ``limits``: (category, subcategory NULL = any, max_quantity,
    max_subtotal).  A subcategory rule beats the category-wide one.  Two
    left equi-joins against the (small, de-duplicated) rules table -- Spark
    broadcasts it when its measured size allows; the orders are never
    regrouped."""
    rules = limits.groupBy("category", "subcategory").agg(F.min("max_quantity").alias("mq"),
                                                          F.min("max_subtotal").alias("ms"))
    spec = rules.filter(F.col("subcategory").isNotNull()).select(
        F.col("category").alias("_c1"), F.col("subcategory").alias("_s1"),
        F.col("mq").alias("_mq1"), F.col("ms").alias("_ms1"))
    gen = rules.filter(F.col("subcategory").isNull()).select(
        F.col("category").alias("_c2"), F.col("mq").alias("_mq2"), F.col("ms").alias("_ms2"))
    j = (df.join(spec, (F.col("category") == F.col("_c1")) & (F.col("subcategory") == F.col("_s1")), "left")
         .join(gen, F.col("category") == F.col("_c2"), "left"))
    has_spec = F.col("_c1").isNotNull()
    mq = F.when(has_spec, F.col("_mq1")).otherwise(F.col("_mq2"))
    ms = F.when(has_spec, F.col("_ms1")).otherwise(F.col("_ms2"))
    over = (F.coalesce(F.col("quantity") > mq, F.lit(False))
            | F.coalesce(F.col("subtotal_amount") > ms, F.lit(False)))
    return j.withColumn(name, over).select(*df.columns, name)
