"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a job needs regardless of cluster size.  Partition counts are left
# to the cluster; AQE coalesces small shuffles and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # dimension sides (category tree, brands) become broadcasts from their measured
    # shuffle size at run time, never from a guess
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages vary from a few KB to MBs: small Arrow batches keep worker memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of stages nobody references any more are removed by Spark
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "shopsmith", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when unset (local runs,
    tests) fall back to a fresh scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    master = sc.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="shopsmith-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df, name: str):
    """Write ``df`` as Parquet in the shared scratch folder and read it back: like
    ``cut_lineage``, but columnar, so readers prune columns and see statistics."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local path
    on a cluster) for stage files, stream checkpoints and outboxes."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/shopsmith-scratch/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours that nothing reads any more (absent: nothing)."""
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, on any file system that Spark reads (absent: none)."""
    fs, hadoop = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def spread(df, per_core: int = 1):
    """Use every core for a Python pass: when the input has fewer partitions than
    the cluster's parallelism (a small file is one split), deal its rows out
    round-robin; large inputs keep their scan splits and are not shuffled.
    Meant for scan-like inputs (page tables): their split count is known without
    running anything.  ``per_core``: partitions for each core, so that slow ones even out."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target * per_core)
    return df


#: Rows of a narrow table that a task gets to render and parse pages from.
DEALT_ROWS = 20_000


def deal(df, rows: int = DEALT_ROWS):
    """Narrow rows that are much work each: dealt out over every core several times over, and
    by their number, not their bytes, as a table grows (a small file is few splits, and a
    row group of a million rows is one)."""
    parts = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts)


def partitions_for(df, rows: int = 250_000) -> int:
    """Partitions for a shuffle of ``df`` that hold some ``rows`` each, however few bytes these
    take, and no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
