"""Quality classifier: boosted trees over statistics of a whole text (never its label,
language, source or id)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_trees import BoostedTrees, fit
from .common import map_lists, stage
from .doc_stats import Counts
from .labelled import MAX_TRAIN, held_out, training_labels

THRESHOLD = 0.3


def features(text: str | None) -> list[float]:
    c = Counts(text)
    n, w, lines = max(1, c.n_chars), max(1, c.n_words), max(1, c.n_lines)
    lengths = np.fromiter(map(len, c.words), np.float64, c.n_words) if c.n_words else np.zeros(1)
    bytes_ = max(1.0, float(c.classes.sum()))
    return [np.log1p(c.n_chars), np.log1p(c.n_words), c.word_chars / w, float(lengths.std()), float(lengths.max()),
            c.n_symbols / w, c.n_dup_lines / lines, c.n_repeat_words / w, c.n_distinct_words / w, c.top_word / w,
            lines / w, float((lengths <= 3).mean()), float((lengths >= 12).mean()), *(c.classes / bytes_).tolist(), n / bytes_]


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of the statistics): narrow, computed once per document."""
    def run(rows):
        return {"doc_id": rows["doc_id"], "x": [list(map(float, features(t))) for t in rows["text"]]}
    return map_lists(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


def train(table: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> BoostedTrees:
    """Fit on at most ``most`` labelled documents (that many short rows reach the driver)."""
    some = F.broadcast(training_labels(labels, "quality", most))  # at most ``most`` rows
    # of several texts with one id the one with the least statistics counts
    rows = table.join(some, "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").select("x", "label").collect()
    return fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted.

    Null or empty text: scored by its (zero) statistics.  Repeated rows are scored each and
    count once in training; a null doc_id is never trained on; other columns are ignored;
    without labels every score is 0.5; an empty table gives none.
    """
    table = stage(feature_table(docs), "quality-features")
    model = train(table, labels, most)

    def run(rows):
        score = model.score(np.array(rows["x"]))
        return {"doc_id": rows["doc_id"], "score": score.tolist(), "predicted": (score >= threshold).astype(int).tolist()}

    scored = map_lists(table, run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
