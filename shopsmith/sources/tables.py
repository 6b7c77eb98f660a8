"""Readers for the driver's parquet tables and the catalog inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- schemas
CATEGORY = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Level", T.IntegerType())])
SKU = T.StructType([
    T.StructField("Name", T.StringType()), T.StructField("SkuId", T.StringType()),
    T.StructField("EAN", T.StringType()), T.StructField("IsActive", T.BooleanType()),
    T.StructField("activeIfPossible", T.BooleanType()), T.StructField("RefId", T.StringType()),
    T.StructField("Price", T.DoubleType()), T.StructField("ListPrice", T.DoubleType()),
])
PRODUCT = T.StructType([
    T.StructField("Name", T.StringType()), T.StructField("ProductId", T.StringType()),
    T.StructField("Description", T.StringType()), T.StructField("ShortDescription", T.StringType()),
    T.StructField("KeyWords", T.StringType()), T.StructField("Title", T.StringType()),
    T.StructField("IsActive", T.BooleanType()), T.StructField("ShowWithoutStock", T.BooleanType()),
])
SPEC = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Value", T.StringType())])
RECORD = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("product", PRODUCT),
    T.StructField("categories", T.ArrayType(CATEGORY)),
    T.StructField("category", CATEGORY),
    T.StructField("brand", T.StructType([T.StructField("Name", T.StringType())])),
    T.StructField("skus", T.ArrayType(SKU)),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("specifications", T.ArrayType(SPEC)),
])
PAGES = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()), T.StructField("html", T.StringType()),
])


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: captured pages; keep 200s (a missing status counts as 200)."""
    df = spark.read.format(fmt).load(path)
    return only_ok_pages(df)


def only_ok_pages(df: DataFrame) -> DataFrame:
    if "status" not in df.columns:
        return df.withColumn("status", F.lit(200))
    return df.filter(F.coalesce(F.col("status"), F.lit(200)) == 200)


def normalise_records(df: DataFrame) -> DataFrame:
    """A7 shape rules: the old single ``category`` becomes a one-entry list."""
    cats = F.col("categories")
    if "category" in df.columns:
        cats = F.coalesce(cats, F.when(F.col("category").isNotNull(), F.array(F.col("category"))))
    return df.withColumn("categories", F.coalesce(cats, F.array().cast(T.ArrayType(CATEGORY))))


def read_product_records(spark: SparkSession, path: str, document: bool = True) -> DataFrame:
    """Extraction documents ``{"products": [...]}`` (one multi-line JSON file
    each, as the extraction step saves them) or, with ``document=False``, JSON
    lines of records (splittable: the form to use at scale); fixed schema."""
    if document:
        doc = T.StructType([T.StructField("products", T.ArrayType(RECORD))])
        raw = spark.read.schema(doc).option("multiLine", "true").json(path)
        recs = raw.select(F.explode("products").alias("r")).select("r.*")
    else:
        recs = spark.read.schema(RECORD).json(path)
    return normalise_records(recs).drop("category")


def read_existing_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Category export as JSON text: one object per line, or a list of objects,
    or a wrapper object holding the list under ``items``/``data``/``categories``.
    Field names differ by export (``Id``/``id``, parent under three names), so
    each object is read as a case-sensitive map; a bad parent becomes 0."""
    line = F.trim(F.col("value"))
    objs = F.when(line.startswith("["), F.from_json(line, "array<map<string,string>>")).otherwise(
        F.coalesce(
            F.from_json(F.get_json_object(line, "$.items"), "array<map<string,string>>"),
            F.from_json(F.get_json_object(line, "$.data"), "array<map<string,string>>"),
            F.from_json(F.get_json_object(line, "$.categories"), "array<map<string,string>>"),
            F.array(F.from_json(line, "map<string,string>"))))
    raw = spark.read.text(path).filter(line != "").select(F.explode(objs).alias("m")).filter(F.col("m").isNotNull())
    m = F.col("m")
    return raw.select(
        F.expr("try_cast(trim(coalesce(m['Id'], m['id'])) as bigint)").alias("id"),
        F.coalesce(F.expr("try_cast(trim(coalesce(m['FatherCategoryId'], m['FatherCategoryID'], m['ParentId'],"
                          " m['parent_id'])) as bigint)"), F.lit(0).cast("bigint")).alias("parent_id"),
        F.coalesce(m["Name"], m["name"]).alias("name"))
