"""Product catalog and order lookups (P5-P7, A10, J1, J2, J5, J9, L6,
T3, T4, M2-M4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import contains_ci, stock_band, stock_label


def list_products(products: DataFrame, active_only: bool = True, sort: bool = True) -> DataFrame:
    """P6 + L6: the catalog, optionally active only, by category then name."""
    out = products.filter(F.col("is_active")) if active_only else products
    return out.orderBy("category", "name") if sort else out


def search_products(products: DataFrame, term: str | None = None, category: str | None = None,
                    min_price=None, max_price=None, active_only: bool = True,
                    escape: bool = False, sort: bool = True) -> DataFrame:
    """P5: active products whose name OR description contains ``term``
    (case-insensitive), in a category, within an inclusive price range."""
    preds = []
    if active_only:
        preds.append(F.col("is_active"))
    if term:
        preds.append(contains_ci("name", term, escape) | contains_ci("description", term, escape))
    if category:
        preds.append(F.col("category") == category)
    if min_price is not None:
        preds.append(F.col("price") >= F.lit(min_price))
    if max_price is not None:
        preds.append(F.col("price") <= F.lit(max_price))
    out = products.filter(reduce(lambda a, b: a & b, preds)) if preds else products
    return out.orderBy("category", "name") if sort else out


def lookup(df: DataFrame, ids: DataFrame, key: str, ids_key: str | None = None) -> DataFrame:
    """P7 re-aimed: rows whose key is in a SET of ids (``left_semi``)."""
    k = ids_key or key
    return df.join(ids.select(F.col(k).alias(key)).distinct(), key, "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame, key: str, ids_key: str | None = None) -> DataFrame:
    """P7 not-found side: requested ids with no row (``left_anti``)."""
    k = ids_key or key
    return ids.select(F.col(k).alias(key)).distinct().join(df.select(key), key, "left_anti")


def active_categories(products: DataFrame) -> DataFrame:
    """A10 + T3: distinct categories of active products, sorted."""
    return products.filter(F.col("is_active")).select("category").distinct().orderBy("category")


def orders_with_items(orders: DataFrame, items: DataFrame, key: str = "customer_order_id") -> DataFrame:
    """J1, flat: each order with its items, one row per item; an order
    without items keeps one row with NULL item columns (left join).

    The nested form (order + array of items) would gather all items of an
    order into one row; a hot order would then be one unbounded value, so
    the flat form is the default.  See :func:`orders_with_item_arrays`.
    """
    it = items.select(*[F.col(c).alias(f"item_{c}") if c != key else F.col(c)
                        for c in items.columns])
    return orders.join(it, key, "left")


def orders_with_item_arrays(orders: DataFrame, items: DataFrame, ids: DataFrame, key: str = "customer_order_id",
                            item_id: str = "order_item_id") -> DataFrame:
    """J1, nested: one row per asked order with the sorted list of its items.

    ``ids`` has the asked order ids in ``key``.  Both tables are reduced to
    them before anything is gathered, so only lists that were asked for are
    built.  If all orders are asked for, all items are gathered, and a hot
    order is one group, one task and one row; the flat form has no such
    bound.  An order without items has an empty list.
    """
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    mine, theirs = orders.join(asked, key, "left_semi"), items.join(asked, key, "left_semi")
    cols = [item_id] + [c for c in items.columns if c not in (key, item_id)]
    lists = theirs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("items"))
    return mine.join(lists, key, "left").withColumn(
        "items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


def orders_by_email(orders: DataFrame, items: DataFrame, email: str, nested: bool = False) -> DataFrame:
    """All orders of one e-mail with their items, newest first: one row
    per item, or one row per order with the item list if ``nested``.

    One join replaces the reference's query-per-order loop.
    """
    mine = orders.filter(F.col("customer_email") == email)
    out = orders_with_item_arrays(mine, items, mine) if nested else orders_with_items(mine, items)
    return out.orderBy(F.col("order_date").desc(), "customer_order_id")


def orphans(children: DataFrame, parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose foreign key has no parent (``left_anti``)."""
    return children.join(parents.select(F.col(pk).alias(fk)), fk, "left_anti") \
        .filter(F.col(fk).isNotNull())


def cascade_delete(children: DataFrame, deleted_parent_keys: DataFrame, fk: str,
                   pk: str | None = None) -> DataFrame:
    """J9 ON DELETE CASCADE: children of deleted parents disappear."""
    k = pk or fk
    return children.join(deleted_parent_keys.select(F.col(k).alias(fk)).distinct(), fk, "left_anti")


def not_in(df: DataFrame, keep: DataFrame, key: str, keep_key: str | None = None) -> DataFrame:
    """T4: ``key NOT IN (subquery)`` written as ``left_anti``.

    Unlike SQL NOT IN, a NULL in the subquery does not empty the result
    (no null-aware anti join is planned); rows with a NULL key are kept.
    """
    k = keep_key or key
    return df.join(keep.select(F.col(k).alias("_keep")).distinct(),
                   F.col(key) == F.col("_keep"), "left_anti")


def assign_images(products: DataFrame, images: DataFrame, name_col: str = "name",
                  url_col: str = "image_url", as_of: str | None = None,
                  touch_updated_at: bool = False) -> dict[str, DataFrame]:
    """Set ``image_url`` from a name -> URL table (exact name match).

    Like the reference's plain UPDATE, ``updated_at`` is left alone unless
    ``touch_updated_at``.  Returns ``products`` (updated),
    ``unmatched`` (names in the map with no product) and ``report``
    (``updated_rows``, ``unmatched_names``).  The map is joined, not
    collected; Spark broadcasts it if its measured size allows.
    """
    from ..functions.columns import as_of_timestamp
    m = (images.groupBy(F.col(name_col).alias("_n"))
         .agg(F.max(url_col).alias("_url")))           # one URL per name
    joined = products.join(m, F.col(name_col) == F.col("_n"), "left")
    hit = F.col("_n").isNotNull()
    out = joined.withColumn("image_url", F.when(hit, F.col("_url")).otherwise(F.col("image_url")))
    if touch_updated_at:
        out = out.withColumn("updated_at", F.when(hit, as_of_timestamp(as_of)).otherwise(F.col("updated_at")))
    out = out.drop("_n", "_url")
    unmatched = m.join(products.select(F.col(name_col).alias("_n")), "_n", "left_anti") \
        .select(F.col("_n").alias(name_col))
    report = joined.agg(F.count_if(hit).cast("bigint").alias("updated_rows"))
    return {"products": out, "unmatched": unmatched, "report": report}


def with_stock_labels(products: DataFrame) -> DataFrame:
    """M3: storefront label and assistant band per product."""
    return products.withColumn("stock_label", stock_label("stock_quantity")) \
                   .withColumn("stock_band", stock_band("stock_quantity"))


def low_stock(products: DataFrame, threshold: int = S.LOW_STOCK_LABEL_BELOW) -> DataFrame:
    """M3: products below ``threshold`` units."""
    return products.filter(F.col("stock_quantity") < threshold)


def high_value_orders(orders: DataFrame, threshold, amount_col: str = "subtotal_amount") -> DataFrame:
    """M4: orders above ``threshold`` (the reference leaves it open)."""
    return orders.filter(F.col(amount_col) > F.lit(threshold))
