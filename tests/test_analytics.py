from decimal import Decimal

from pyspark.sql import functions as F

from shopfloor.operators import analytics as an
from shopfloor.operators import quality as Q
from domain_rows import rows_of


def test_category_revenue_null_first(orders_small):
    """A NULL revenue sorts first on DESC, as in PostgreSQL."""
    rows = an.category_revenue(orders_small).collect()
    assert rows[0].category is None and rows[0].total_amount is None
    assert [r.category for r in rows[1:]] == ["Furniture", "Technology", "Office Supplies"]
    assert rows[1].total_amount == Decimal("200000.01")


def test_growth_gap_is_null(orders_small):
    """2011 is missing, so 2012 has no previous year (NULL, not 2010)."""
    g = {r.year: r for r in an.revenue_growth(orders_small).collect()}
    assert g[2012].previous_revenue is None and g[2012].growth is None
    assert g[2010].previous_revenue == g[2009].revenue


def test_summaries_and_grouping_sets(orders_small):
    s = {r.category: r for r in an.category_summary(orders_small).collect()}
    assert s["Technology"].order_count == 5 and s["Technology"].total_quantity == 5
    assert s["Technology"].avg_order_value == (150 + 150 - 5 + 5 + 5) / 5
    bi = an.bi_summary(orders_small)
    dims = {r.dimension for r in bi.collect()}
    assert dims == {"category", "year", "status"}
    years = {r.year: r.order_count for r in bi.filter("dimension = 'year'").collect()}
    assert years == {2009: 2, 2010: 5, 2012: 2, None: 1}
    t = an.table_stats(orders_small).first()
    assert (t.total_records, t.unique_statuses, t.unique_categories) == (10, 7, 3)


def test_paging_search_and_topk(orders_small):
    p2 = [r.order_id for r in an.page(orders_small, page_no=2, per_page=3).collect()]
    assert p2 == [7, 6, 5]
    assert [r.order_id for r in an.page_after(orders_small, 7, per_page=3).collect()] == [6, 5, 4]
    info = an.page_info(orders_small, per_page=3).first()
    assert (info.total, info.total_pages) == (10, 4)
    assert [r.order_id for r in an.search_orders(orders_small, customer_name="b").collect()] == [4, 3]
    assert an.search_orders(orders_small, customer_name="_").count() == 7      # wildcard, as the reference
    assert an.search_orders(orders_small, customer_name="_", escape=True).count() == 0
    top = an.top_customers(orders_small, k=2).collect()
    assert [r.customer_name for r in top] == ["Bob", "Ann"]
    assert rows_of(an.value_counts(orders_small, "category", k=2)) == [("Furniture", 2), ("Technology", 5)]


def test_profile_all_null_numeric(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "order_id long, quantity int")
    prof = {r.column: r for r in Q.column_profile(df).collect()}
    assert (prof["quantity"].mean, prof["quantity"].min, prof["quantity"].max) == (0.0, 0.0, 0.0)
    assert float(prof["quantity"].completeness_pct) == 0.0
    empty = spark.createDataFrame([], "order_id long, quantity int")
    assert Q.column_profile(empty).filter("column = 'quantity'").first().completeness_pct is None


def test_measures_safe_divide(spark, orders_small):
    m = an.measures(orders_small.filter(F.lit(False))).first()
    assert m.orders_count == 0 and m.average_order_value is None
