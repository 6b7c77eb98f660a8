"""One-row reports (G2, G5, G6, G8).  Each is a single global aggregation (partial
aggregates per partition, one small final merge); only these one-row results
are ever meant to be collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_brand_name, normalize_spec_name
from .tree import category_path


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side without a join: union them with the
    other parts' columns null, then keep each column's single non-null value."""
    fields = [(f.name, f.dataType) for p in parts for f in p.schema.fields]
    aligned = [p.select(*[F.col(n) if n in p.columns else F.lit(None).cast(t).alias(n) for n, t in fields])
               for p in parts]
    return reduce(DataFrame.unionByName, aligned).agg(*[F.max(n).alias(n) for n, _ in fields])


def catalog_summary(products: DataFrame, skus: DataFrame, existing_products: DataFrame | None = None,
                    new_spec_fields: DataFrame | None = None) -> DataFrame:
    """Products, SKUs, how many were created, spec fields created."""
    p = products.select("id")
    if existing_products is not None:
        p = p.join(existing_products.select("id", F.lit(True).alias("existed")), "id", "left")
    else:
        p = p.withColumn("existed", F.lit(None).cast("boolean"))
    parts = [p.agg(F.count(F.lit(1)).alias("total_products"),
                   F.count_if(F.col("existed").isNull()).alias("products_created")),
             skus.agg(F.count(F.lit(1)).alias("total_skus"),
                      F.count_if(F.col("sku_id_preserved").isNull()).alias("skus_assigned_ids"))]
    if new_spec_fields is not None:
        parts.append(new_spec_fields.agg(F.count(F.lit(1)).alias("spec_fields_created")))
    return one_row(*parts)


def execution_summary(tree: DataFrame, brands: DataFrame, products: DataFrame, skus: DataFrame,
                      sku_status: DataFrame, prices: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row across all entities."""
    return one_row(
        tree.agg(F.count_if(F.col("level") == 1).alias("departments"),
                 F.count_if(F.col("level") > 1).alias("categories")),
        brands.agg(F.count(F.lit(1)).alias("brands")),
        products.agg(F.count(F.lit(1)).alias("products")),
        sku_status.agg(F.count(F.lit(1)).alias("skus"), F.count_if(F.col("total_associated") > 0).alias("skus_active"),
                       F.sum("total_associated").alias("images_associated"),
                       F.sum("total_failed").alias("images_failed")),
        prices.agg(F.count(F.lit(1)).alias("prices")),
        inventory.agg(F.count(F.lit(1)).alias("inventory_rows")))


# The record fields checked for "present in every record".
STRUCTURE_FIELDS = ["product.Name", "product.ProductId", "product.Description", "brand.Name", "categories",
                    "skus", "images", "specifications"]


def catalog_structure(records: DataFrame) -> DataFrame:
    """G6 over all records: distinct departments, (category, department) pairs,
    brands, spec names; total; variations; fields present in every record."""
    path = category_path("categories")
    r = records.select(
        F.element_at(path, 1).alias("dept"), path.alias("path"),
        normalize_brand_name(F.col("brand.Name")).alias("brand"),
        F.transform("specifications", lambda s: normalize_spec_name(s["Name"])).alias("spec_names"),
        (F.size("skus") > 1).alias("multi"),
        *[(F.col(f).isNotNull() & (F.size(F.col(f)) > 0 if f in ("categories", "skus", "images", "specifications")
                                   else F.trim(F.col(f)) != "")).alias(f"has_{i}")
          for i, f in enumerate(STRUCTURE_FIELDS)])
    pairs = r.select("dept", F.explode(F.slice("path", 2, 1 << 20)).alias("cat")).distinct() \
        .agg(F.count(F.lit(1)).alias("category_pairs"))
    specs = r.select(F.explode("spec_names").alias("s")).filter(F.col("s") != "").distinct() \
        .agg(F.count(F.lit(1)).alias("spec_names"))
    base = r.agg(
        F.count_distinct("dept").alias("departments"), F.count_distinct("brand").alias("brands"),
        F.count(F.lit(1)).alias("total_products"), F.coalesce(F.bool_or("multi"), F.lit(False)).alias("has_variations"),
        F.concat_ws(",", F.filter(F.array(*[F.when(F.bool_and(f"has_{i}"), F.lit(f))
                                            for i, f in enumerate(STRUCTURE_FIELDS)]),
                                  lambda x: x.isNotNull())).alias("common_fields"))
    return one_row(base, pairs, specs)


def structure_lists(records: DataFrame) -> DataFrame:
    """G6 content: (kind, parent, name) of every distinct department, category under its
    department, brand and spec name; a table, so nothing is gathered in one row."""
    path = category_path("categories")
    named = F.concat(
        F.transform(path, lambda c, i: F.struct(
            F.when(i == 0, F.lit("department")).otherwise(F.lit("category")).alias("kind"),
            F.when(i > 0, F.element_at(path, 1)).alias("parent"), c.alias("name"))),
        F.array(F.struct(F.lit("brand").alias("kind"), F.lit(None).cast("string").alias("parent"),
                         normalize_brand_name(F.col("brand.Name")).alias("name"))),
        F.transform("specifications", lambda s: F.struct(
            F.lit("spec").alias("kind"), F.lit(None).cast("string").alias("parent"),
            normalize_spec_name(s["Name"]).alias("name"))))
    rows = records.select(F.explode(F.filter(named, lambda n: n["name"] != "")).alias("n")).select("n.*")
    return rows.distinct()


def extraction_metrics(records: DataFrame, urls: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Products extracted, URLs found, and the cleaning size reduction."""
    parts = [records.agg(F.count(F.lit(1)).alias("total_products")),
             urls.agg(F.count_distinct("url").alias("total_urls_found"))]
    if sizes is not None:
        parts.append(sizes.agg(F.count_if("cleaned").alias("pages_cleaned"),
                               F.sum("chars_before").alias("chars_before"),
                               F.sum("chars_after").alias("chars_after"),
                               F.round(100 * (1 - F.try_divide(F.sum("chars_after"), F.sum("chars_before"))), 1)
                               .alias("reduction_percent")))
    return one_row(*parts)
