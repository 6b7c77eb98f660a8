"""Toxicity by a weighted lexicon: folded text, Aho-Corasick, exception phrases, length.

The lexicon is learnt from labelled documents: words that toxic documents have much more
often than others (log-likelihood ratio), weighted by their log odds; two-word phrases
around a lexicon word that clean documents have as often are exceptions.  A document's
score is a logistic function of the weight it collects, by itself and per word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists, stage
from .labelled import MAX_TRAIN, held_out, training_labels

THRESHOLD = 0.5
#: Log-likelihood ratio a lexicon word needs, documents a phrase needs, length that softens short texts.
LEAST_RATIO, LEAST_DOCUMENTS, SOFT_LENGTH = 20.0, 3, 20
#: Look-alike letters and the Latin letters they stand for, digits in words.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝɡӏαεικνορτυχ", "aeopcyxijshdqwgiaeiknoptux"))
DIGITS = dict(zip("0134578@$!|", "oieastbasii"))
HIDDEN = "­​‌‍⁠﻿"
_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in HIDDEN}
_DIGIT_RUN = re.compile(r"[0134578@$!|]+")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Lower case, look-alikes and full-width letters to Latin, hidden characters out, and
    digits or signs inside or at the edge of a word to the letters they imitate."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_FOLD) if not text.isascii() else text.lower()

    def letters(m):
        a, b = m.span()
        before = a > 0 and text[a - 1].isalpha()
        after = b < len(text) and text[b].isalpha()
        run = m[0]
        edge = (run.isdigit() or run in "@$") and len(run) <= 2
        first = edge and after and not (a and text[a - 1].isalnum()) and sum(map(str.isalpha, text[b:b + 4])) >= 2
        last = edge and before and not text[b:b + 1].isalnum() and sum(map(str.isalpha, text[max(0, a - 4):a])) >= 2
        if before and after or first or last:
            return "".join(DIGITS[c] for c in run)
        return run

    return _DIGIT_RUN.sub(letters, text)


class Lexicon:
    """``weights`` word -> weight, ``exceptions`` set of two-word phrases, and the logistic
    function's ``bias`` and two slopes (None: not fitted yet)."""

    def __init__(self, weights: dict[str, float], exceptions=frozenset(), curve=None):
        self.weights, self.exceptions, self.curve = weights, frozenset(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def hits(self, folded: str) -> list[tuple[str, str, str]]:
        """(word, phrase with the word before, phrase with the word after) of every whole-word match."""
        if not self.weights:
            return []
        if self._automaton is None:
            import ahocorasick
            self._automaton = ahocorasick.Automaton()
            for w in self.weights:
                self._automaton.add_word(w, w)
            self._automaton.make_automaton()
        out, n, spans, starts = [], len(folded), [], []
        for end, word in self._automaton.iter(folded):
            a, b = end + 1 - len(word), end + 1
            if a and folded[a - 1].isalpha() or b < n and folded[b].isalpha():
                continue
            if not spans:  # the text's words, once it has a match
                spans = [m.span() for m in _WORD.finditer(folded)]
                starts = [s[0] for s in spans]
            k = bisect_right(starts, a) - 1
            left = folded[slice(*spans[k - 1])] if k > 0 else ""
            right = folded[slice(*spans[k + 1])] if k + 1 < len(spans) else ""
            out.append((word, f"{left} {word}", f"{word} {right}"))
        return out

    def measure(self, text: str | None) -> tuple[float, float]:
        """Weight collected, and per word of the text."""
        folded = fold(text)
        total = sum(self.weights[w] for w, before, after in self.hits(folded)
                    if before not in self.exceptions and after not in self.exceptions)
        return math.log1p(total), math.log1p(100 * total / (len(folded.split()) + SOFT_LENGTH))

    def score(self, text: str | None) -> float:
        bias, *slopes = self.curve or (0.0, 0.0, 0.0)
        return 1 / (1 + math.exp(-(bias + sum(s * m for s, m in zip(slopes, self.measure(text))))))


def _ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood ratio of a word's document counts; 0 if it is not more common in toxic ones."""
    share = (toxic + clean) / (n_toxic + n_clean)
    if toxic <= n_toxic * share:
        return 0.0
    out = toxic * math.log(toxic / (n_toxic * share))
    return 2 * (out + (clean * math.log(clean / (n_clean * share)) if clean else 0))


def _ratio_column(n_toxic: int, n_clean: int) -> F.Column:
    """``_ratio`` of the columns toxic and clean."""
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (toxic + clean) / (n_toxic + n_clean)
    both = toxic * F.ln(toxic / (n_toxic * share)) + F.when(clean > 0, clean * F.ln(clean / (n_clean * share))).otherwise(0.0)
    return F.when(toxic > n_toxic * share, 2 * both).otherwise(0.0)


def _odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _document_counts(sample: DataFrame, items) -> DataFrame:
    """Documents of either label that have each item: ``items(text)`` -> set."""
    def run(rows):
        toxic, clean = Counter(), Counter()
        for text, label in zip(rows["text"], rows["label"]):
            (toxic if label else clean).update(items(text))
        names = list(toxic | clean)
        return {"item": names, "toxic": [toxic[k] for k in names], "clean": [clean[k] for k in names]}
    return (map_lists(sample.select("text", "label"), run, "item string, toxic long, clean long")
            .groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (y - p) - ridge * np.r_[0, beta[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(hess, grad)
    return tuple(map(float, beta))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Lexicon:
    """Learn from at most ``most`` labelled documents; equal texts count once.  Without a
    document of either class the lexicon is empty and every score the share of toxic ones."""
    some = F.broadcast(training_labels(labels, "toxic", most))  # at most ``most`` rows
    sample = stage(docs.select("doc_id", "text").join(some, "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text"))
                   .agg(F.max("label").alias("label")), "toxic-sample")
    count = dict(sample.groupBy("label").count().collect())
    n_toxic, n_clean = count.get(1, 0), count.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Lexicon({}, (), (math.log(share / (1 - share)), 0.0, 0.0))
    words = _document_counts(sample, lambda t: set(_WORD.findall(fold(t))))
    # every word over the ratio, which at most ``most`` labelled documents bound
    frequent = words.filter((F.col("toxic") >= LEAST_DOCUMENTS) & (_ratio_column(n_toxic, n_clean) >= 0.99 * LEAST_RATIO)).collect()
    weights = {r["item"]: _odds(r["toxic"], r["clean"], n_toxic, n_clean) for r in sorted(frequent, key=lambda r: r["item"])
               if _ratio(r["toxic"], r["clean"], n_toxic, n_clean) >= LEAST_RATIO}
    lexicon = Lexicon(weights)
    phrases = _document_counts(sample, lambda t: {p for h in lexicon.hits(fold(t)) for p in h[1:]})
    common = phrases.filter((F.col("clean") >= LEAST_DOCUMENTS) & (F.col("toxic") * n_clean <= F.col("clean") * n_toxic))
    exceptions = [r["item"] for r in common.select("item").collect()]  # at most two a lexicon word and sampled document
    lexicon = Lexicon(weights, exceptions)

    def run(rows):
        got = [lexicon.measure(t) for t in rows["text"]]
        return {"a": [g[0] for g in got], "b": [g[1] for g in got], "label": rows["label"]}

    rows = map_lists(sample, run, "a double, b double, label int").collect()  # three numbers a sampled document
    x = np.array(sorted((r["a"], r["b"], r["label"]) for r in rows))
    return Lexicon(weights, exceptions, _fit_curve(x[:, :2], x[:, 2]))


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, one row per input row, in place.

    Null or empty text collects no weight.  Repeated rows are scored each; a null doc_id is
    not held out; other columns are ignored; an empty table gives none.
    """
    def run(rows):
        score = [lexicon.score(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "score": score, "predicted": [int(s >= threshold) for s in score]}
    got = map_lists(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns, in place.

    A null or empty text collects no weight, so it stays unless most labelled documents are
    toxic; repeated rows stay or go each; a null doc_id does not matter; columns may have any
    name; an empty table stays one.
    """
    def run(rows):
        keep = [lexicon.score(t) < threshold for t in rows["text"]]
        return {c: [v for v, k in zip(values, keep) if k] for c, values in rows.items()}
    return map_lists(docs, run, docs.schema)
