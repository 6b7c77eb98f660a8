"""Ids that stay: a registry of key -> id that grows batch by batch (E2 for data that arrives
later).

A batch reserves one range of numbers for its new keys, right after the range of the batch
before it, and appends its pairs; nothing written earlier changes, so a key never gets another
number.  Keys lie in hash buckets, and a batch reads only the buckets it has keys of.  What a
batch sees is the registry up to the batch before it, so a replay gives the same numbers.

Layout: ``<registry>/ids/bucket=<b>/batch=<n>`` (key, id) and ``<registry>/ranges/batch=<n>``
(first, count), which is written last and makes the batch count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, staged
from .ordering import with_index

BUCKETS = 64


def _ranges(spark: SparkSession, registry: str) -> DataFrame:
    path, schema = f"{registry.rstrip('/')}/ranges", "first long, count long, batch long"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def registered(spark: SparkSession, registry: str, key_type: str = "string", before: int | None = None) -> DataFrame:
    """(key, id, bucket) of the batches that count, optionally those before batch ``before``."""
    path, schema = f"{registry.rstrip('/')}/ids", f"`key` {key_type}, id long, bucket int, batch long"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema).drop("batch")
    done = [r["batch"] for r in _ranges(spark, registry).select("batch").collect()]  # one number per batch
    rows = spark.read.schema(schema).parquet(path).filter(F.col("batch").isin(done))
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def register_ids(keys: DataFrame, registry: str, batch_id: int, key: str, first_id: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(``key``, id) of every distinct key in ``keys``: its number of old, else the next one
    of this batch's range, by the order of the new keys.  Null keys get none.

    Batches are numbered upwards and come one at a time, as a stream's micro-batches do; the
    number of buckets stays the same for the life of a registry.
    """
    spark = keys.sparkSession
    key_type = keys.schema[key].dataType.simpleString()
    wanted = staged(keys.select(F.col(key).alias("key")).filter("key is not null").distinct()
                    .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")), "ids-wanted")
    here = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    known = registered(spark, registry, key_type, batch_id).filter(F.col("bucket").isin(here))
    found = wanted.join(known.select("key", "id"), "key", "left")
    old, new = found.filter("id is not null").select("key", "id"), found.filter("id is null").select("key", "bucket")
    last = _ranges(spark, registry).filter(F.col("batch") < batch_id).agg(F.max(F.col("first") + F.col("count"))).first()[0]
    first = max(first_id, last or first_id)
    given = staged(with_index(new, ["key"], "place").select("key", (F.col("place") + first).alias("id"), "bucket"), "ids-given")
    (given.withColumn("batch", F.lit(batch_id).cast("long")).repartition("bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{registry.rstrip('/')}/ids"))
    (given.agg(F.lit(first).cast("long").alias("first"), F.count(F.lit(1)).alias("count")).coalesce(1).write.mode("overwrite")
     .parquet(f"{registry.rstrip('/')}/ranges/batch={batch_id}"))
    return old.unionByName(given.select("key", "id")).withColumnRenamed("key", key)
