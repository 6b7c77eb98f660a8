"""Specification values.

A field is looked up for the product's category, else for the nearest
ancestor (at most ``max_up`` levels up).  Ancestors come from the path arrays
of the tree, so the lookup is one join with a distance column and a
``min_by`` per (product, spec name) - no walk up the tree per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_type_id, normalize_spec_name, strip


def ancestors(tree: DataFrame, max_up: int = 5) -> DataFrame:
    """(category_id, ancestor_path, distance) for distance 0..max_up."""
    t = tree.select(F.col("id").alias("category_id"), "path_arr")
    return t.select("category_id", F.explode(F.sequence(F.lit(0), F.least(F.size("path_arr") - 1, F.lit(max_up))))
                    .alias("distance"), "path_arr").select(
        "category_id", "distance", F.slice("path_arr", 1, F.size("path_arr") - F.col("distance")).alias("anc_path"))


def resolve_spec_fields(specs: DataFrame, products: DataFrame, spec_fields: DataFrame, tree: DataFrame,
                        key: str = "url", max_up: int = 5) -> DataFrame:
    """Field id for each (product, spec name): own category first, else the
    nearest ancestor within ``max_up`` levels; null when none."""
    p = products.select(key, F.col("id").alias("product_id"), "category_id")
    s = specs.select(key, normalize_spec_name("name").alias("name"), strip("value").alias("value")) \
        .filter(F.col("name").isNotNull() & (F.col("name") != "") & F.col("value").isNotNull() & (F.col("value") != ""))
    s = s.join(p, key)
    node_paths = tree.select(F.col("id").alias("field_category_id"), F.col("path_arr").alias("anc_path"))
    f = spec_fields.select(F.col("category_id").alias("field_category_id"), normalize_spec_name("name").alias("name"),
                           F.col("id").alias("field_id"), "field_type").join(node_paths, "field_category_id")
    anc = ancestors(tree, max_up)
    cand = anc.join(f, "anc_path").select("category_id", "name", "distance", "field_id", "field_type")
    best = cand.groupBy("category_id", "name").agg(
        F.min_by(F.struct("field_id", "field_type", "distance"), F.struct("distance", "field_id")).alias("b"))
    return s.join(best, ["category_id", "name"], "left").select(
        key, "product_id", "category_id", "name", "value", F.col("b.field_id").alias("field_id"),
        F.col("b.field_type").alias("field_type"), F.col("b.distance").alias("distance"))


def spec_values(resolved: DataFrame, overrides: dict[str, str] | None = None,
                existing_max_field_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(values, new field candidates).  Unmatched names become new fields of
    the product's category, type from the overrides map else Text."""
    new_fields = new_spec_fields(resolved, overrides, existing_max_field_id)
    return with_new_fields(resolved, new_fields), new_fields


def new_spec_fields(resolved: DataFrame, overrides: dict[str, str] | None = None, existing_max_field_id: int = 0) -> DataFrame:
    """The fields that values ask for and no category on the way up has, numbered in the
    order (category, name)."""
    from .ordering import assign_ids
    missing = resolved.filter(F.col("field_id").isNull()).select("category_id", "name").distinct()
    ov = F.create_map(*[x for k, v in (overrides or {}).items() for x in (F.lit(normalize_spec_name_py(k)), F.lit(v))]) \
        if overrides else None
    ftype = F.coalesce(F.element_at(ov, F.col("name")), F.lit("Text")) if ov is not None else F.lit("Text")
    new_fields = assign_ids(missing.withColumn("field_type", ftype), None, existing_max_field_id,
                            ["category_id", "name"], "field_id")
    return new_fields.withColumn("field_type_id", field_type_id("field_type")).withColumn("created", F.lit(True))


def with_new_fields(resolved: DataFrame, new_fields: DataFrame) -> DataFrame:
    """Every value with its field, of old or new."""
    nf = new_fields.select("category_id", "name", F.col("field_id").alias("new_id"),
                           F.col("field_type").alias("new_type"))
    return resolved.join(nf, ["category_id", "name"], "left").select(
        "product_id", "category_id", "name", "value",
        F.coalesce("field_id", "new_id").alias("field_id"),
        F.coalesce("field_type", "new_type").alias("field_type"),
        F.col("field_id").isNull().alias("field_created"))


def normalize_spec_name_py(s: str) -> str:
    s = s.strip()
    return s[:1].upper() + s[1:].lower() if s else s
