"""Products and SKUs.

Records are flattened once into keyed tables; products and SKUs are the big
sides and are never broadcast.  Dimension lookups (tree, brands) are ordinary
equi-joins that AQE turns into broadcasts when their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (extract_id, normalize_brand_name, short_description, sku_list_price,
                              sku_price, strip)
from ..session import staged
from .ordering import assign_ids
from .tree import brand_keys, category_path, lower_path, path_categories


def flatten_products(records: DataFrame, key: str = "url") -> dict[str, DataFrame]:
    """One nested record -> products, product_categories, skus, specs, images."""
    products = records.select(key, "product.*", F.col("brand.Name").alias("brand_name"))
    cats = records.select(key, F.posexplode("categories").alias("pos", "c")).select(
        key, "pos", F.col("c.Name").alias("name"), F.col("c.Level").alias("level"))
    skus = records.select(key, F.posexplode("skus").alias("pos", "s")).select(key, "pos", "s.*")
    specs = records.select(key, F.posexplode("specifications").alias("pos", "s")).select(
        key, "pos", F.col("s.Name").alias("name"), F.col("s.Value").alias("value"))
    images = records.select(key, F.posexplode("images").alias("pos", "image_url"))
    return {"products": products, "product_categories": cats, "skus": skus, "specs": specs, "images": images}


def products_last_wins(records: DataFrame, order: str | None = None, key: str = "url") -> DataFrame:
    """Records stored by URL, the last one (highest ``order``) wins; among equals, or
    without an order, the largest record, so a rerun keeps the same one."""
    rest = F.struct(*[c for c in records.columns if c != key])
    last = F.max_by(rest, F.struct(F.col(order), rest)) if order else F.max(rest)
    return records.groupBy(key).agg(last.alias("__r")).select(key, "__r.*")


def last_of_repeated(records: DataFrame, key: str = "url") -> DataFrame:
    """``products_last_wins`` without an order, for records that are written down: they are read
    more than once.  Keys that repeat are found from hashes of the keys alone, and only their
    rows are shuffled and compared; rows that share no more than a hash stay apart there too."""
    h = F.xxhash64(key).alias("__h")
    many = staged(records.select(h).groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__h"), "repeated-keys")
    rows = records.select(key, *[c for c in records.columns if c != key])
    if many.isEmpty():
        return rows
    marked = rows.withColumn("__h", h)
    return (marked.join(many, "__h", "left_anti").drop("__h")
            .unionByName(products_last_wins(marked.join(many, "__h", "left_semi").drop("__h"), key=key)))


def first_of_id(df: DataFrame, preserved: str, order: list[str]) -> DataFrame:
    """Add ``repeats_id``: the row's preserved id is also that of a row before it in
    ``order`` (rows without one never do).  ``df`` is read twice: give it written down.

    Ids that repeat are found from the ids alone, and only their rows are compared: the wide
    rows move only if many ids repeat."""
    ids = df.filter(F.col(preserved).isNotNull()).select(F.col(preserved).alias("__id"), *order)
    many = staged(ids.select("__id").repartition("__id").groupBy("__id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__id"),
                  "repeated-ids")
    if many.isEmpty():
        return df.withColumn("repeats_id", F.lit(False))
    first = staged(ids.join(many, "__id").groupBy("__id").agg(F.min(F.struct(*order)).alias("__first")), "first-of-ids")
    return (df.join(first, F.col(preserved) == F.col("__id"), "left")
            .withColumn("repeats_id", F.coalesce(F.struct(*order) != F.col("__first"), F.lit(False)))
            .drop("__id", "__first"))


def product_rows(records: DataFrame, tree: DataFrame, brands: DataFrame, key: str = "url") -> DataFrame:
    """One row per record with its category (J3/J4), brand (J6) and, if it cannot be loaded,
    a ``reason``: no category, no brand, or a preserved id (``duplicate_id``) that a record
    before it by ``key`` has."""
    base = records.select(
        key, F.col("product.Name").alias("name"), F.col("product.ProductId").alias("product_id_text"),
        extract_id(F.col("product.ProductId")).alias("product_id_preserved"),
        F.col("product.Description").alias("description"),
        short_description(F.col("product.ShortDescription"), F.col("product.Description")).alias("short_description"),
        F.col("product.Title").alias("title"), F.col("product.KeyWords").alias("keywords"),
        F.coalesce(F.col("product.ShowWithoutStock"), F.lit(True)).alias("show_without_stock"),
        normalize_brand_name(F.coalesce(F.col("brand.Name"), F.lit("Default"))).alias("brand_name"),
        category_path("categories").alias("path"))
    # looked up by path and by brand, so products need not be shuffled to meet the dimensions
    base = base.withColumn("lp", lower_path("path")).withColumn("bkey", F.lower(strip("brand_name")))
    found = base.join(path_categories(base, tree), "lp", "left").join(brand_keys(brands), "bkey", "left")
    # a record without a key is no product's
    own = lambda c: F.when(F.col(key).isNotNull(), F.col(c)).alias(c)
    j = found.select(*[c for c in base.columns if c not in ("lp", "bkey")], own("category_id"), own("brand_id"))
    reason = (F.when(F.col("category_id").isNull(), F.lit("no_category"))
              .when(F.col("brand_id").isNull(), F.lit("no_brand")))
    j = j.withColumn("reason", reason).withColumn(
        "__kept_id", F.when(F.col("reason").isNull(), F.col("product_id_preserved")))
    return first_of_id(staged(j, "resolved"), "__kept_id", [key]).withColumn(
        "reason", F.coalesce("reason", F.when(F.col("repeats_id"), "duplicate_id"))).drop("repeats_id", "__kept_id")


def product_rejects(rows: DataFrame, key: str = "url") -> DataFrame:
    """Of ``product_rows``: (key, name, reason) of those that cannot be loaded."""
    return rows.filter(F.col("reason").isNotNull()).select(key, "name", "reason")


def numbered_products(rows: DataFrame, existing_max_id: int = 0, key: str = "url") -> DataFrame:
    """Of ``product_rows``: the products, with the record's id or a new one."""
    ok = assign_ids(rows.filter(F.col("reason").isNull()).drop("reason"), "product_id_preserved", existing_max_id, [key], "id")
    return ok.select(
        "id", key, "name", "category_id", "brand_id", "description", "short_description",
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("name")).alias("title"),
        "keywords", F.lit(True).alias("is_active"), F.lit(True).alias("is_visible"),
        "show_without_stock", "product_id_preserved")


def build_products(records: DataFrame, tree: DataFrame, brands: DataFrame, existing_max_id: int = 0,
                   key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Resolve category (J3/J4) and brand (J6); products without either are
    rejected with a reason; ids preserved from the record or assigned.  One record per
    ``key`` (W6 sees to that); of records with one preserved id the first by ``key``
    keeps it, the others are rejected (``duplicate_id``).  To resolve once for both
    results, write ``product_rows`` down and split that."""
    rows = product_rows(records, tree, brands, key)
    return numbered_products(rows, existing_max_id, key), product_rejects(rows, key)


def build_skus(records: DataFrame, products: DataFrame, existing_max_id: int = 0,
               key: str = "url") -> DataFrame:
    """One row per SKU of a loaded product; a product without SKUs gets a
    ``Default`` SKU; EAN defaults to ``EAN{product id}``; ref id = RefId or SkuId;
    all eight dimensions 1; inactive until an image is associated (E5).  Of SKUs with
    one preserved id the first by (product, position) keeps it, the others get new ids."""
    p = products.select(key, F.col("id").alias("product_id"))
    # a product is one row, so its side is hashed; the long lists of SKUs need no sort
    recs = records.select(key, "skus").join(p.hint("shuffle_hash"), key)
    s = recs.select(key, "product_id", F.posexplode_outer("skus").alias("pos", "s"))
    name = F.coalesce(F.col("s.Name"), F.lit("Default"))
    sku = s.select(
        key, "product_id", F.coalesce(F.col("pos"), F.lit(0)).alias("pos"), name.alias("name"),
        F.col("s.SkuId").alias("sku_id_text"), extract_id(F.col("s.SkuId")).alias("sku_id_preserved"),
        F.coalesce(F.col("s.EAN"), F.concat(F.lit("EAN"), F.col("product_id").cast("string"))).alias("ean"),
        F.coalesce(F.when(F.col("s.RefId") != "", F.col("s.RefId")), F.col("s.SkuId")).alias("ref_id"),
        sku_price(F.col("s.Price")).alias("price"),
        sku_list_price(F.col("s.ListPrice"), F.col("s.Price")).alias("list_price"))
    sku = first_of_id(staged(sku, "sku-rows"), "sku_id_preserved", ["product_id", "pos"]).withColumn(
        "sku_id_preserved", F.when(~F.col("repeats_id"), F.col("sku_id_preserved"))).drop("repeats_id")
    sku = assign_ids(sku, "sku_id_preserved", existing_max_id, ["product_id", "pos"], "id")
    dims = [F.lit(1).alias(c) for c in ("package_height", "package_width", "package_length", "package_weight",
                                         "height", "width", "length", "weight")]
    return sku.select("id", "product_id", key, "pos", "name", "ean", "ref_id", "price", "list_price",
                      F.lit(False).alias("is_active"), *dims, "sku_id_preserved")


def _upsert(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """``key``, ``new`` and ``old`` (whole rows as one struct type, null where absent)."""
    types = {f.name: f.dataType for df in (existing, new) for f in df.schema.fields if f.name != key}

    def whole(df, name):
        return df.select(key, F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
                                         for c, t in types.items()]).alias(name))
    return whole(new, "new").join(whole(existing, "old").hint("merge"), key, "full_outer")


def upsert_products(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert new ids; on an id conflict keep the existing row (all its columns,
    nulls included) but force it active and visible."""
    j = _upsert(new, existing)
    row, touched = F.coalesce("old", "new"), F.col("new").isNotNull()
    rest = [c for c in j.schema["old"].dataType.names if c not in ("is_active", "is_visible")]
    return j.select("id", *[row[c].alias(c) for c in rest],
                    *[F.when(touched, True).otherwise(F.col("old")[c]).alias(c) for c in ("is_active", "is_visible")],
                    _action().alias("action"))


def upsert_skus(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert new ids; on conflict keep the existing SKU, all its columns."""
    j = _upsert(new, existing)
    return j.select("id", *[F.coalesce("old", "new")[c].alias(c) for c in j.schema["old"].dataType.names],
                    _action().alias("action"))


def _action():
    return (F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNotNull(), "kept_existing")
            .otherwise("untouched"))


def activate_skus(skus: DataFrame, sku_image_status: DataFrame) -> DataFrame:
    """E5: a SKU is active only if at least one image was associated."""
    st = sku_image_status.select(F.col("sku_id").alias("id"), "total_associated")
    return (skus.join(st.hint("merge"), "id", "left")
            .withColumn("is_active", F.coalesce(F.col("total_associated"), F.lit(0)) > 0)
            .drop("total_associated"))


def sku_prices(skus: DataFrame) -> DataFrame:
    """Price payload per SKU: markup 0, cost price = price (list price kept)."""
    return skus.select(F.col("id").alias("sku_id"), F.lit(0).alias("markup"),
                       F.col("price").alias("cost_price"), F.col("list_price"))


def fill_sku_ids(skus, product_id):
    """in every SKU of a record, SkuId, EAN and RefId default to the product id;
    SKUs start inactive and may be activated."""
    pid = F.col(product_id) if isinstance(product_id, str) else product_id
    s = F.col(skus) if isinstance(skus, str) else skus
    return F.transform(s, lambda x: F.struct(
        x["Name"].alias("Name"), F.coalesce(x["SkuId"], pid).alias("SkuId"), F.coalesce(x["EAN"], pid).alias("EAN"),
        F.lit(False).alias("IsActive"), F.lit(True).alias("activeIfPossible"),
        F.coalesce(x["RefId"], pid).alias("RefId"), x["Price"].alias("Price"), x["ListPrice"].alias("ListPrice")))
