"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, remove_path, scratch_path

#: Rows and bytes per Arrow batch: documents reach 100s of KB, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


#: Byte to byte: A-Z in lower case, 0-9, a-z and all beyond ASCII as they are, else a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts (sets the session's batch size)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_lists(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over plain lists: ``fn({column: list}) -> {column: list}`` for each
    Arrow batch.  A ``fn`` with a ``finish`` method is called once more at the end of the
    partition for what it still holds."""
    from pyspark.sql.pandas.types import to_arrow_schema
    small_batches(df.sparkSession)
    spark_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, names = to_arrow_schema(spark_schema), df.columns

    def run(batches):
        work = fn() if isinstance(fn, type) else fn
        for batch in batches:
            if not batch.num_rows:
                continue
            out = work({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            if out and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        if hasattr(work, "finish"):
            out = work.finish()
            if out and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    # by position: a column's name may hold a full stop
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, spark_schema)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that no column of ``df`` has, upper or lower case."""
    taken = [c.lower() for c in df.columns]
    prefix = "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + w for w in wanted]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back: later jobs
    start from files that survive lost executors, with column pruning and statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the files of a result of ``stage`` that nothing reads any more."""
    remove_path(df.sparkSession, df._staged_path)


__all__ = ["WORD_BYTES", "documents", "labels", "small_batches", "map_lists", "free_names", "stage", "unstage", "scratch_path", "ensure_checkpoint_dir"]
