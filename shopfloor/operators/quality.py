"""Order data quality: duplicates, incomplete rows, validation, profile.

(W1, T1, A11-A21.)  Each check is one scan of the table: all rule flags
are evaluated in one projection and counted in one aggregate.  Nothing is
deleted unless ``mode="drop"`` is asked for; reports are DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import rules as R


REPEATS = 100_000      # copies of one identical row that a task writes out


# -- W1: duplicates -----------------------------------------------------------

def duplicate_groups(df: DataFrame, keys=S.DUPLICATE_KEYS, id_col: str = "order_id") -> DataFrame:
    """Key groups with more than one row: keys, first id, size.

    Pure aggregation (partial + final), so a hot key group costs one
    partial row per input partition; NULL keys form one group, as in pandas.
    """
    return (df.groupBy(*keys)
            .agg(F.min(id_col).alias("_first_id"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > 1))


def _matched(df: DataFrame, keys, id_col: str):
    """``df`` with ``_n``, ``_first_id`` of its key group if that has several rows."""
    g = duplicate_groups(df, keys, id_col)
    g = g.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first_id", "_n")
    cond = reduce(lambda a, b: a & b,
                  [df[k].eqNullSafe(g[f"_k{i}"]) for i, k in enumerate(keys)])
    return df.join(g, cond, "left"), F.col(id_col).eqNullSafe(F.col("_first_id"))


def _first_rows(tied: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of ``tied`` with their count, and the smallest row per key."""
    cols = [F.col(c) for c in tied.columns]
    rows = tied.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    low = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]) \
        .agg(F.min(F.struct(*cols)).alias("_low"))
    return rows, low


def mark_duplicates(df: DataFrame, keys=S.DUPLICATE_KEYS, id_col: str = "order_id",
                    flag: str = "is_duplicate", unique_ids: bool = False) -> DataFrame:
    """Flag every row but the first (smallest id) of its key group.

    Instead of a window over the key (which sends a hot group to one task),
    the first id per group comes from an aggregate and is joined back
    NULL-safely.  Only groups of two or more rows are joined; that side is
    small when duplicates are rare, and AQE then broadcasts it (its size is
    measured at runtime) so the table itself is not shuffled; otherwise the
    join is sort-merge with skew splitting.

    Rows that share the first id are told apart by their other columns, the
    smallest row being the first; identical rows are counted, and all but one
    of them flagged.  A NULL id comes after every other.  ``unique_ids=True``
    skips that step for a table whose ``id_col`` is its primary key.
    """
    joined, first = _matched(df, keys, id_col)
    several = F.col("_n").isNotNull()
    if unique_ids:
        return joined.withColumn(flag, several & ~first).select(*df.columns, flag)
    rest = joined.filter(~several | ~first).select(*df.columns, several.alias(flag))
    rows, low = _first_rows(joined.filter(several & first).select(*df.columns), keys)
    cond = reduce(lambda a, b: a & b,
                  [rows[k].eqNullSafe(low[f"_k{i}"]) for i, k in enumerate(keys)])
    # a row repeated very often is written out again by many tasks
    parts = (rows.join(low, cond)
             .withColumn("_is_low", F.struct(*[rows[c] for c in df.columns]).eqNullSafe(F.col("_low")))
             .select(*[rows[c] for c in df.columns], "_c", "_is_low",
                     F.explode(F.expr(f"sequence(0, (_c - 1) div {REPEATS})")).alias("_part"))
             .repartition("_part", id_col))
    again = parts.select("*", F.explode(F.expr(
        f"sequence(_part * {REPEATS} + 1, least(_c, (_part + 1) * {REPEATS}))")).alias("_i"))
    return rest.unionByName(again.select(*df.columns, (~(F.col("_is_low") & (F.col("_i") == 1))).alias(flag)))


def drop_duplicates_keep_first(df: DataFrame, keys=S.DUPLICATE_KEYS, id_col: str = "order_id",
                               unique_ids: bool = False) -> DataFrame:
    """``mode="drop"``: the table without the flagged rows."""
    if unique_ids:
        return mark_duplicates(df, keys, id_col, "_dup", True).filter(~F.col("_dup")).drop("_dup")
    joined, first = _matched(df, keys, id_col)
    several = F.col("_n").isNotNull()
    low = _first_rows(joined.filter(several & first).select(*df.columns), keys)[1]
    return joined.filter(~several).select(*df.columns).unionByName(low.select("_low.*"))


def duplicate_report(df: DataFrame, keys=S.DUPLICATE_KEYS, id_col: str = "order_id") -> DataFrame:
    """A18 counts from the group aggregate alone (no join).

    duplicates_found = sum over key groups of (size - 1).
    """
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_records"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates_found")) \
        .select("total_records", "duplicates_found",
                F.col("duplicates_found").alias("cleaned_records"),
                F.lit(0).cast("bigint").alias("errors"),
                F.col("duplicates_found").alias("warnings"))


def duplicate_examples(df: DataFrame, keys=S.DUPLICATE_KEYS, id_col: str = "order_id",
                       n: int = 10, unique_ids: bool = False) -> DataFrame:
    """The first ``n`` duplicate rows by id (deterministic)."""
    return (mark_duplicates(df, keys, id_col, "_dup", unique_ids).filter("_dup")
            .select(id_col, "customer_name", "order_date", "category")
            .orderBy(id_col).limit(n))


# -- A19: incomplete records ---------------------------------------------------

def _any(rules) -> F.Column:
    return reduce(lambda a, b: a | b, [r.predicate for r in rules])


def incomplete_report(df: DataFrame, id_col: str = "order_id", **rule_args) -> DataFrame:
    """A19 summary in one aggregate: rule hits by severity, distinct ids.

    ``warnings``/``errors`` count rule hits, ``cleaned_records`` counts the
    distinct ids with at least one hit (N2).
    """
    rules = R.incomplete_rules(df.schema, **rule_args)
    err = [r for r in rules if r.severity == "error"]
    warn = [r for r in rules if r.severity == "warning"]
    hit_sum = lambda rs: reduce(lambda a, b: a + b,
                                [F.count_if(r.predicate) for r in rs], F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_distinct(F.when(_any(rules), F.col(id_col))).alias("cleaned_records"),
                  hit_sum(err).cast("bigint").alias("errors"),
                  hit_sum(warn).cast("bigint").alias("warnings"))


def incomplete_rule_hits(df: DataFrame, **rule_args) -> DataFrame:
    """A19 detail: ``(rule_set, rule, severity, field, hits)``, one aggregate."""
    return R.rule_hits(df, R.incomplete_rules(df.schema, **rule_args))


def incomplete_ids(df: DataFrame, id_col: str = "order_id", n: int | None = 20,
                   **rule_args) -> DataFrame:
    """T1 + L5: distinct ids breaking any rule, ascending; first ``n``.

    One OR of all flags replaces the reference's per-rule id lists.
    """
    rules = R.incomplete_rules(df.schema, **rule_args)
    out = df.filter(_any(rules)).select(id_col).distinct().orderBy(id_col)
    return out.limit(n) if n else out


# -- A20: validation -----------------------------------------------------------

def validation_rule_hits(df: DataFrame, **rule_args) -> DataFrame:
    """A20 detail: ``(rule_set, rule, severity, field, hits)``, one aggregate."""
    return R.rule_hits(df, R.validation_rules(df.schema, **rule_args))


def validation_report(df: DataFrame, **rule_args) -> DataFrame:
    """A20 summary.  ``errors`` is always 0 in the reference; a row may hit
    several rules, so ``rows_with_issues`` is published next to the hits."""
    rules = R.validation_rules(df.schema, **rule_args)
    hits = reduce(lambda a, b: a + b, [F.count_if(r.predicate) for r in rules])
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.lit(0).cast("bigint").alias("cleaned_records"),
                  F.lit(0).cast("bigint").alias("errors"),
                  hits.cast("bigint").alias("warnings"),
                  F.count_if(_any(rules)).cast("bigint").alias("rows_with_issues"))


def validation_issues(df: DataFrame, **rule_args) -> DataFrame:
    """A20 issue list: one line of text per rule with hits."""
    return (validation_rule_hits(df, **rule_args).filter(F.col("hits") > 0)
            .select("rule", F.concat(F.col("field"), F.lit(": "), F.col("hits"),
                                     F.lit(" "), F.col("rule")).alias("issue")))


# -- A11-A17: profile ------------------------------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def _numeric_columns(df: DataFrame, columns=None):
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    return [c for c in names if columns is None or c in columns]


def column_profile(df: DataFrame, numeric_columns=None) -> DataFrame:
    """A11, A12, A14 from ONE aggregate, returned long:
    ``(column, null_count, non_null_count, completeness_pct, mean, min, max)``.

    completeness_pct = round(100 * count(c) / count(*), 2), NULL on an
    empty table.  mean/min/max for numeric columns; 0.0 when all NULL (the
    reference's convention); NULL for non-numeric columns.
    N3: all numeric columns are profiled (the reference skipped decimals);
    pass ``numeric_columns`` to narrow.
    """
    cols = df.columns
    nums = set(_numeric_columns(df, numeric_columns))
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, c in enumerate(cols):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"_nn{i}"))
        if c in nums:
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.try_divide(F.sum(F.col(f"`{c}`")).cast("double"), F.count(F.col(f"`{c}`"))).alias(f"_mean{i}"),
                     F.min(x).alias(f"_min{i}"), F.max(x).alias(f"_max{i}")]
    wide = df.agg(*aggs)
    parts = []
    for i, c in enumerate(cols):
        if c in nums:
            m = [f"coalesce(_mean{i}, 0D)", f"coalesce(_min{i}, 0D)", f"coalesce(_max{i}, 0D)"]
        else:
            m = ["CAST(NULL AS DOUBLE)"] * 3
        parts.append(f"'{c}', _nn{i}, {', '.join(m)}")
    long = wide.selectExpr("_total", f"stack({len(cols)}, {', '.join(parts)}) "
                                     "AS (column, non_null_count, mean, min, max)")
    return long.select(
        "column",
        (F.col("_total") - F.col("non_null_count")).cast("bigint").alias("null_count"),
        F.col("non_null_count").cast("bigint").alias("non_null_count"),
        F.when(F.col("_total") > 0,
               F.round(F.col("non_null_count").cast("decimal(20,0)") * 100 / F.col("_total"), 2)
               .cast("decimal(10,2)")).alias("completeness_pct"),
        "mean", "min", "max")


def full_row_duplicates(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row in every column (id included)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def quality_overview(df: DataFrame, id_col: str = "order_id") -> DataFrame:
    """A16 + A17 + A21 as a long ``(metric, value)`` table.

    Each part is a one-row aggregate; they are stacked long and unioned,
    so no part waits for another and no join is needed.
    """
    def long(one_row: DataFrame, names) -> DataFrame:
        parts = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
        return one_row.selectExpr(f"stack({len(names)}, {parts}) AS (metric, value)")

    prof = column_profile(df, numeric_columns=[])
    mean_comp = prof.agg(F.avg("completeness_pct").alias("mean_completeness_pct"))
    dup = duplicate_report(df).select(
        "total_records", F.col("duplicates_found").alias("duplicates"),
        (F.col("total_records") - F.col("duplicates_found")).alias("unique_records"))
    inc = incomplete_report(df, id_col=id_col).select(
        F.col("cleaned_records").alias("incomplete"),
        (F.col("total_records") - F.col("cleaned_records")).alias("valid_records"))
    cols = df.agg(F.lit(len(df.columns)).alias("column_count"))
    return (long(dup, ["total_records", "duplicates", "unique_records"])
            .unionByName(long(inc, ["incomplete", "valid_records"]))
            .unionByName(long(full_row_duplicates(df), ["duplicate_rows"]))
            .unionByName(long(mean_comp, ["mean_completeness_pct"]))
            .unionByName(long(cols, ["column_count"])))


def status_counts(df: DataFrame) -> DataFrame:
    """All statuses (NULL dropped), most frequent first."""
    return (df.filter(F.col("status").isNotNull()).groupBy("status")
            .agg(F.count(F.lit(1)).alias("count")))


def kpis(df: DataFrame, completed_statuses=("Order Finished",)) -> DataFrame:
    """Completed orders and category count next to the total."""
    return df.agg(F.count(F.lit(1)).alias("total_orders"),
                  F.count_if(F.col("status").isin(list(completed_statuses))).cast("bigint")
                   .alias("completed_orders"),
                  F.count_distinct("category").alias("category_count"))
