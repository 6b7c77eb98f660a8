"""Labelled documents for training, split by a hash of the id, never by order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on at most; a hash of doc_id chooses among more.
MAX_TRAIN = 20_000
FOLDS = 5


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo FOLDS (null for a null id)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def held_out() -> F.Column:
    return F.coalesce(fold() == 0, F.lit(False))


def training_labels(labels: DataFrame, name: str, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, label (0 or 1) of at most ``most`` documents outside fold 0; several labels
    of one document count as their majority (a tie is 1), null labels and ids are left out."""
    usable = labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    one = usable.groupBy("doc_id").agg((F.avg(F.col(name).cast("double")) >= 0.5).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
