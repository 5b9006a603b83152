"""M1: de-duplicate products by name and repair foreign keys.

W2 -> J3 -> J4 -> A28 as one set-based job:

1. mapping: every product whose name has a smaller id maps to that
   smallest id (``min`` per name is a combinable aggregate, so a name
   shared by a third of the catalog is still pre-aggregated per partition);
2. items re-pointed through the mapping (left join + coalesce);
3. only the kept products remain;
4. counts before / after / deleted / re-pointed.

Nothing is mutated; each output is a DataFrame the caller writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_ids(products: DataFrame, key: str = "name", id_col: str = "product_id") -> DataFrame:
    """Kept id = smallest id per name."""
    return products.groupBy(key).agg(F.min(id_col).alias("keep_id"))


def id_mapping(products: DataFrame, key: str = "name", id_col: str = "product_id") -> DataFrame:
    """``(old_id, keep_id)`` for every product that is not the kept one."""
    k = keep_ids(products, key, id_col).withColumnRenamed(key, "_key")
    # null-safe: products without a name are a group like any other
    return (products.select(F.col(key).alias("_name"), F.col(id_col).alias("old_id"))
            .join(k, F.col("_name").eqNullSafe(F.col("_key"))).filter(F.col("old_id") != F.col("keep_id"))
            .select("old_id", "keep_id"))


def repoint(items: DataFrame, mapping: DataFrame, fk: str = "product_id") -> DataFrame:
    """Foreign keys old id -> kept id; others unchanged."""
    m = mapping.select(F.col("old_id").alias(fk), F.col("keep_id").alias("_keep"))
    return items.join(m, fk, "left").withColumn(fk, F.coalesce("_keep", fk)).drop("_keep") \
        .select(*items.columns)


def dedupe_products(products: DataFrame, items: DataFrame | None = None, key: str = "name",
                    id_col: str = "product_id", fk: str = "product_id",
                    sum_stock: bool = False) -> dict[str, DataFrame]:
    """M1.  Returns ``products``, ``mapping``, ``items`` (if given) and a
    long ``report`` of ``(metric, value)``.

    ``sum_stock=True`` gives the kept row the stock of its whole group
    (N13); by default the other rows' stock is dropped, as in the reference.
    Products without a name are one group, so before = after + deleted.
    """
    stats = products.groupBy(F.col(key).alias("_key")).agg(F.min(id_col).alias("keep_id"),
                                      F.sum("stock_quantity").alias("_group_stock"))
    tagged = products.join(stats, F.col(key).eqNullSafe(F.col("_key")))
    kept = tagged.filter(F.col(id_col) == F.col("keep_id"))
    if sum_stock:
        kept = kept.withColumn("stock_quantity", F.col("_group_stock").cast("int"))
    kept = kept.select(*products.columns)
    mapping = (tagged.filter(F.col(id_col) != F.col("keep_id"))
               .select(F.col(id_col).alias("old_id"), "keep_id"))
    out = {"products": kept, "mapping": mapping}
    metrics = [products.agg(F.lit("products_before").alias("metric"),
                            F.count(F.lit(1)).alias("value")),
               kept.agg(F.lit("products_after").alias("metric"), F.count(F.lit(1)).alias("value")),
               mapping.agg(F.lit("products_deleted").alias("metric"), F.count(F.lit(1)).alias("value"))]
    if items is not None:
        m = mapping.select(F.col("old_id").alias(fk), F.col("keep_id").alias("_keep"))
        j = items.join(m, fk, "left")
        out["items"] = j.withColumn(fk, F.coalesce("_keep", fk)).select(*items.columns)
        metrics.append(j.agg(F.lit("items_repointed").alias("metric"),
                             F.count("_keep").alias("value")))
    report = metrics[0]
    for m_ in metrics[1:]:
        report = report.unionByName(m_)
    out["report"] = report
    return out
