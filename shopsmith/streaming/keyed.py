"""A keyed table that takes micro-batches without being rewritten.

Rows are dealt to hash buckets of their key.  A batch appends one small folder to each bucket
that holds one of its keys and reads nothing of the table; readers merge.  The upsert rule
makes the merge independent of how often a row is seen: the values of a key are those of the
first batch that brought it, and its flags are on once any later batch named it.  So a replayed
batch writes the same folders again, and compaction may leave old folders behind at any point
without changing a result.

Layout: ``<target>/rows/__bucket=<b>/__kind=<base|delta>/__batch=<n>`` and ``<target>/meta`` (key and
number of buckets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, remove_path

BUCKETS = 64
FLAGS = ("is_active", "is_visible")
#: Partition columns, named so that no column of a table is hidden by them.
_PLACE = ("__bucket", "__kind", "__batch")


def _rows(target: str) -> str:
    return f"{target.rstrip('/')}/rows"


def _write(df: DataFrame, target: str, key: str, buckets: int, kind: str, batch: int) -> None:
    """Put ``df`` into its buckets' folders of this kind and batch, replacing only those."""
    placed = df.withColumns(dict(zip(_PLACE, (F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), F.lit(kind), F.lit(batch).cast("long")))))
    # rows of a bucket come together, so a folder gets one file (AQE may split a large one)
    (placed.repartition(_PLACE[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*_PLACE).parquet(_rows(target)))


def _meta(spark: SparkSession, target: str) -> tuple[str, int, str] | None:
    path = f"{target.rstrip('/')}/meta"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return None
    row = spark.read.schema("`key` string, buckets int, columns string").json(path).first()
    return row["key"], row["buckets"], row["columns"]


def create_keyed(df: DataFrame, target: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Start a keyed table with the rows of ``df`` (unique keys; none is fine).  Columns
    ``FLAGS`` are added as true where absent; the table's columns are fixed from here on."""
    spark = df.sparkSession
    if _meta(spark, target) is not None:
        raise ValueError(f"a keyed table is there already: {target}")
    df = df.withColumns({f: F.lit(True) for f in FLAGS if f not in df.columns})
    _write(df, target, key, buckets, "base", -1)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.createDataFrame([(key, buckets, columns)], "`key` string, buckets int, columns string").coalesce(1).write.mode("overwrite").json(
        f"{target.rstrip('/')}/meta")


def _stored(spark: SparkSession, target: str, columns: str) -> DataFrame:
    schema = f"{columns}, __bucket int, __kind string, __batch long"
    if not path_exists(spark, _rows(target)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_rows(target))


def _merged(stored: DataFrame, key: str) -> DataFrame:
    """One row per key: the values of its earliest row (a base row first), flags on if a delta
    of a later batch has the key.  Partial aggregation shrinks repeats before the shuffle."""
    values = [c for c in stored.columns if c not in (key, *FLAGS, *_PLACE)]
    base = F.col("__kind") == "base"
    early = F.struct((~base).alias("late"), "__batch")
    # an earlier base of a bucket whose clean-up was cut off has the same values, older flags
    flag = lambda f: F.bool_or(F.when(~base, True).otherwise(F.col(f))).alias(f)
    one = stored.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in values]) if values else F.lit(True), early).alias("v"),
                                            *[flag(f) for f in FLAGS])
    return one.select(key, *([f"v.{c}" for c in values]), *FLAGS)


def read_keyed(spark: SparkSession, target: str) -> DataFrame | None:
    """The table's rows after all batches written so far; None if there is no such table."""
    meta = _meta(spark, target)
    if meta is None:
        return None
    key, _, columns = meta
    stored = _stored(spark, target, columns)
    names = [c for c in stored.columns if c not in _PLACE]
    return _merged(stored, key).select(*names)


def upsert_batch(spark: SparkSession, batch: DataFrame, target: str, epoch_id: int, key: str = "id",
                 order: str | None = None, buckets: int = BUCKETS) -> None:
    """S2 step: fold one batch into the table.  Rows already present keep their values but are
    forced active and visible; new keys are inserted; the last row per key in the batch
    (highest ``order`` column; without one or on a tie the largest row) wins.  Only buckets
    with a key of the batch get a folder, named by ``epoch_id``; a replay writes it again."""
    meta = _meta(spark, target)
    if meta is None:
        create_keyed(batch.drop(*([order] if order else [])).limit(0), target, key, buckets)
        meta = _meta(spark, target)
    key, buckets, columns = meta
    names = spark.createDataFrame([], columns).schema
    cols = [c for c in batch.columns if c not in (key, order)]
    whole = F.struct(*cols) if cols else F.struct(key)
    last = (batch.filter(F.col(key).isNotNull()).groupBy(key)
            .agg((F.max_by(whole, F.struct(F.col(order), whole)) if order else F.max(whole)).alias("r")))
    rows = last.select(*[F.col(key).cast(f.dataType).alias(f.name) if f.name == key else F.lit(True).alias(f.name) if f.name in FLAGS
                         else (F.col(f"r.{f.name}") if f.name in cols else F.lit(None)).cast(f.dataType).alias(f.name) for f in names.fields])
    _write(rows, target, key, buckets, "delta", epoch_id)


def compact(spark: SparkSession, target: str, most_deltas: int = 8) -> list[int]:
    """Rewrite the buckets with more than ``most_deltas`` delta folders as one base folder
    each and remove what it replaces; other buckets are not touched.  The buckets rewritten."""
    meta = _meta(spark, target)
    if meta is None:
        return []
    key, buckets, columns = meta
    stored = _stored(spark, target, columns)
    # one row per folder
    folders = stored.select(*_PLACE).distinct().collect()
    deltas: dict[int, list[int]] = {}
    for r in folders:
        if r["__kind"] == "delta":
            deltas.setdefault(r["__bucket"], []).append(r["__batch"])
    full = sorted(b for b, n in deltas.items() if len(n) > most_deltas)
    if not full:
        return []
    upto = max(max(deltas[b]) for b in full)
    # a delta that arrives meanwhile has a larger batch number and stays
    rows = stored.filter(F.col("__bucket").isin(full) & (F.col("__batch") <= upto))
    _write(_merged(rows, key).select(*[c for c in stored.columns if c not in _PLACE]), target, key, buckets, "base", upto)
    for r in folders:
        if r["__bucket"] in full and r["__batch"] <= upto and (r["__kind"], r["__batch"]) != ("base", upto):
            remove_path(spark, "/".join([_rows(target), *(f"{c}={r[c]}" for c in _PLACE)]))
    return full


def stream_upsert(spark: SparkSession, source: DataFrame, target: str, checkpoint: str, key: str = "id",
                  order: str | None = None, most_deltas: int | None = 8):
    """A streaming DataFrame of product rows folded into ``target``; micro-batch ``n`` is
    batch ``n`` of the table, so a replayed batch rewrites its own folders.  Buckets with more
    than ``most_deltas`` delta folders are compacted after a batch (None: never)."""
    def batch(df: DataFrame, epoch_id: int):
        upsert_batch(spark, df, target, epoch_id, key, order)
        if most_deltas is not None:
            compact(spark, target, most_deltas)

    q = (source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
