"""Importance resampling towards a target distribution of hashed word runs.

Words are found by overlapped regex scanning: bytes that are not part of a word become
spaces, runs of spaces collapse to one, and for every run length one pattern with looks at
both edges is scanned with ``overlapped=True``, so each match is the span of one run of words
and goes straight into the CRC of its bucket.  A document keeps its buckets with their counts,
a task its sum over all documents (as many numbers as there are buckets); the gain of a bucket
compares the target's share with the corpus's.  Gumbel noise from a hash of the id turns the
sum of gains into a draw without replacement: the highest scores are drawn.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_index
from .common import WORD_BYTES, small_batches, stage

RUN_WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024

def _patterns(run_words: int) -> list:
    import regex
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (k - 1)) for k in range(1, run_words + 1)]


def collapsed(text: str | None) -> bytes:
    """The words of a text (null: none), lower-cased in ASCII, one space between."""
    return b" ".join((text or "").encode("utf-8").translate(WORD_BYTES).split())


def buckets_of(words: bytes, patterns: list, buckets: int) -> Counter:
    """Occurrences by bucket of all runs of words."""
    found = Counter()
    for pattern in patterns:
        for run, n in Counter(words[slice(*m.span())] for m in pattern.finditer(words, overlapped=True)).items():
            found[zlib.crc32(run) % buckets] += n
    return found


_FEATURES = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>, totals array<long>"


def features(docs: DataFrame, run_words: int = RUN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets, counts of every row; a task's last row has its
    sums by bucket in ``totals``, which is null otherwise."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
                        ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])

    def run(batches):
        patterns, totals = _patterns(run_words), np.zeros(buckets, np.int64)
        for batch in batches:
            out = {c: [] for c in schema.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = collapsed(text.as_py())
                found = buckets_of(words, patterns, buckets)
                at, n = np.fromiter(found, np.int32, len(found)), np.fromiter(found.values(), np.int64, len(found))
                totals[at] += n
                for c, v in zip(out, (doc_id, words.count(b" ") + 1 if words else 0, int(n.sum()), at, n, None)):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        yield pa.RecordBatch.from_pydict({c: [None] for c in schema.names[:-1]} | {"totals": [totals]}, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FEATURES)


def bucket_totals(found: DataFrame, buckets: int) -> np.ndarray:
    """Sums by bucket (``buckets`` numbers reach the driver, whatever the input)."""
    rows = (found.filter("totals is not null").select(F.posexplode("totals").alias("bucket", "n")).filter("n > 0")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of each bucket over the corpus's."""
    k, big_t, big_s = len(target), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(big_s + k) / (float(s + 1) * float(big_t + k))))
                     for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of gains over a document's runs."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches):
        for batch in batches:
            at, n = batch.column(3), batch.column(4)
            sums = np.concatenate([[0], np.cumsum(gain[at.flatten().to_numpy()] * n.flatten().to_numpy())])
            ends = np.cumsum(at.value_lengths().to_numpy())
            weight = np.diff(sums[np.concatenate([[0], ends])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], schema=schema)

    return found.filter("totals is null").drop("totals").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, run_words: int = RUN_WORDS, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) of every row of ``docs``
    (doc_id, text) against ``target`` (text).

    Null or empty texts have no runs and weight 0.  A null doc_id has a weight but no score
    and is never drawn.  Rows that repeat a doc_id are scored and drawn each; ties go to the
    smaller doc_id.  Other columns are ignored; an empty target counts as no runs at all,
    an empty table gives none.
    """
    found = stage(features(docs, run_words, buckets), "resample-features")
    aim = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), run_words, buckets)
    gain = gains(bucket_totals(aim, buckets), bucket_totals(found, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = stage(weights(found, gain).withColumn("score", F.col("weight") + noise)
                   .withColumn("open", (F.col("n_words") >= least_words) & F.col("score").isNotNull()), "resample-scores")
    drawn = percent * scored.filter("open").count() // 100
    ranked = with_index(scored, [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc()], "_index")
    rank = F.when(F.col("open") & (F.col("_index") < drawn), F.col("_index") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
