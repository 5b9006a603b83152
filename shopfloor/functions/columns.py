"""Column expressions used inside the operators.

All are built from ``pyspark.sql.functions`` so they stay inside
whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escape_like(term: str) -> str:
    """Escape ``%``, ``_`` and the escape char so a term matches literally."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c, term: str, escape: bool = False) -> Column:
    """``col ILIKE '%term%'``.

    Like the reference, ``%`` and ``_`` inside ``term`` act as wildcards
    unless ``escape=True``.
    """
    t = escape_like(term) if escape else term
    return _c(c).ilike(f"%{t}%")


def in_domain(c, values: Iterable[str], lower: bool = True) -> Column:
    """F2 + F3: membership test; NULL counts as outside the domain."""
    x = F.lower(_c(c)) if lower else _c(c)
    return F.coalesce(x.isin(list(values)), F.lit(False))


def date_parts(c) -> list[Column]:
    """year, month, quarter as BIGINT (PostgreSQL EXTRACT returns numeric)."""
    d = _c(c)
    return [F.year(d).cast("bigint").alias("year"),
            F.month(d).cast("bigint").alias("month"),
            F.quarter(d).cast("bigint").alias("quarter")]


def as_of_date(as_of: str | None) -> Column:
    """the current date, or a fixed date for reproducible runs."""
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def as_of_timestamp(as_of: str | None) -> Column:
    return (F.localtimestamp() if as_of is None
            else F.lit(as_of).cast("timestamp_ntz"))


def money(c) -> Column:
    """Cast to numeric(18,2) (HALF_UP, like PostgreSQL)."""
    return _c(c).cast(S.MONEY)


def line_subtotal(price, quantity) -> Column:
    """price x quantity in decimal arithmetic."""
    return (_c(price) * _c(quantity)).cast(S.MONEY)


def shipping_tier(subtotal, free_from=S.FREE_SHIPPING_FROM, flat=S.FLAT_SHIPPING) -> Column:
    """free shipping from ``free_from`` inclusive, else a flat fee."""
    return F.when(_c(subtotal) >= free_from, F.lit(0)).otherwise(F.lit(flat)).cast(S.MONEY)


def payment_status(method) -> Column:
    """simulated payments complete at once, others stay pending."""
    return F.when(_c(method) == "simulated", "completed").otherwise("pending")


def stock_label(stock, low_below=S.LOW_STOCK_LABEL_BELOW) -> Column:
    """storefront label: out of stock / low stock / in stock."""
    s = _c(stock)
    return (F.when(s <= 0, "out_of_stock").when(s < low_below, "low_stock")
            .otherwise("in_stock"))


def stock_band(stock, good_from=S.STOCK_BAND_GOOD_FROM,
               moderate_from=S.STOCK_BAND_MODERATE_FROM) -> Column:
    """assistant-facing band: good / moderate / low."""
    s = _c(stock)
    return (F.when(s >= good_from, "good").when(s >= moderate_from, "moderate")
            .otherwise("low"))


def parse_id_list(text) -> Column:
    """ids from comma text like JavaScript ``parseInt``: leading
    integer of each trimmed piece, pieces without one are dropped."""
    pieces = F.split(_c(text), ",")
    ints = F.transform(pieces, lambda p: F.regexp_extract(p, r"^\s*([+-]?\d+)", 1))
    return F.transform(F.filter(ints, lambda s: s != ""), lambda s: s.cast("long"))


def envelope(event_type, data: Column, ts: Column, source: str = "shopfloor") -> list[Column]:
    """event envelope ``{event_type, timestamp, source, data}``."""
    et = F.lit(event_type) if isinstance(event_type, str) else event_type
    return [et.alias("event_type"), ts.alias("timestamp"), F.lit(source).alias("source"),
            F.to_json(data).alias("data")]


def try_numeric(c) -> Column:
    """``pd.to_numeric(errors='coerce')``; NULL when not a number."""
    return F.expr(f"try_cast({_name(c)} AS DECIMAL(38,10))")


def try_date(c) -> Column:
    """``pd.to_datetime(errors='coerce')``; NULL when not a date."""
    return F.expr(f"try_cast({_name(c)} AS TIMESTAMP)")


def _name(c) -> str:
    if not isinstance(c, str):
        raise TypeError("coercion helpers take a column name")
    return f"`{c}`"


def normalize_name(c) -> Column:
    """Trim, collapse inner white space, capitalise words."""
    return F.initcap(F.regexp_replace(F.trim(_c(c)), r"\s+", " "))


def order_total(subtotal="subtotal_amount", tax_rate="tax_rate",
                shipping="shipping_cost") -> Column:
    """total = subtotal + subtotal x tax rate + shipping, numeric(18,2)."""
    s = _c(subtotal)
    return (s + s * _c(tax_rate) + _c(shipping)).cast(S.MONEY)


def valid_email(c) -> Column:
    return F.coalesce(_c(c).rlike(S.EMAIL_PATTERN), F.lit(False))
