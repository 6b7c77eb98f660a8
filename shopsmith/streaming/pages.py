"""Incremental runs with Structured Streaming.

S1 reads a folder of captured pages as a file stream: the stream checkpoint
remembers which files were processed, which is the "skip finished work" of a
resumed run.  Each micro-batch runs the same batch transforms (HTML pass ->
records) and writes them as one folder of a table; with an id registry every page
keeps the id it got when it first arrived.  S2, the keyed product table, is in ``keyed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.html import extract_products
from ..operators.id_registry import register_ids
from ..sources.tables import PAGES
from .keyed import read_keyed as latest_snapshot, stream_upsert, upsert_batch  # noqa: F401


def stream_pages(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                 max_files_per_trigger: int | None = None, registry: str | None = None, first_id: int = 1):
    """New page files -> extracted records appended under ``out_dir``.
    Runs until all files present now are processed (``availableNow``).  With ``registry``
    (a folder, E2) records have a column ``id``: one number per URL, for good, from
    ``first_id`` on."""
    schema = T.StructType(PAGES.fields + [T.StructField("page_id", T.LongType())])
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = reader.load(in_dir)

    def batch(df: DataFrame, epoch_id: int):
        ok = df.filter(F.coalesce(F.col("status"), F.lit(200)) == 200)
        recs = extract_products(ok, key="url")
        if registry:
            # every page is a record, so the ids need the URLs alone and pages are parsed once
            ids = register_ids(ok.select("url"), registry, epoch_id, "url", first_id)
            recs = recs.join(ids.hint("shuffle_hash"), "url")
        # a folder per batch: a replayed batch rewrites its own rows
        recs.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={epoch_id}")

    q = (pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
