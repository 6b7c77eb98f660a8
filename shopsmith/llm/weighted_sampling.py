"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by count.  Each of the K samples gives every word w
with weight S numbers that depend on the word and the sample alone (r and c from Gamma(2, 1),
b uniform): t = floor(ln S / r + b), a = c * exp(-r * (t - b + 1)).  The word with the least
a and its t are the sample.  Two documents agree in a sample with a probability equal to the
generalised Jaccard similarity of their weights (sum of minima over sum of maxima).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists, small_batches

SAMPLES = 128
#: (word, weight) rows kept per worker (4 bytes a sample each).
CACHE_ROWS = 100_000


#: Bits of a hash that choose among the shares of a Gamma table (small enough for the cache).
_BITS = 16
#: Bits of a sample's mark; a table's rows drawn at once.
MARK_BITS, _BLOCK = 12, 128
_MARK = np.uint32((1 << MARK_BITS) - 1)


def _gamma_table(bits: int = _BITS) -> np.ndarray:
    """Gamma(2, 1) at the middle of 2 ** bits equal shares: its distribution function
    1 - (1 + x) exp(-x), inverted on a fine grid."""
    x = np.geomspace(1e-6, 60, 400_000)
    share = (np.arange(1 << bits) + 0.5) / (1 << bits)
    return np.interp(share, -np.expm1(-x) - x * np.exp(-x), x).astype(np.float32)


_GAMMA = _gamma_table()
_LN_GAMMA = np.log(_GAMMA)


def _mix(x: np.ndarray) -> np.ndarray:
    """Two rounds of multiply and shift, in place: 32 bits, which processors do many at a time."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def draw(seeds: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """ln a of each (word seed, weight) and sample, as a 32-bit float whose lowest 12 bits are
    the mark of word and t: the least of several floats brings its mark along.

    Either half of a word's 64-bit seed is mixed with the sample's number: one gives r and c
    (16 bits each), the other b (24 bits).  Most words stand once in their text: for weight 1,
    t is 0 whatever r is."""
    number = np.arange(1, samples + 1, dtype=np.uint32)
    x = _mix((seeds >> np.uint64(32)).astype(np.uint32)[:, None] + number * np.uint32(0x9E3779B9))
    r = _GAMMA[x >> np.uint32(16)]
    ln_a = _LN_GAMMA[x & np.uint32(0xFFFF)]
    low = seeds.astype(np.uint32)[:, None]
    # b - 1, in (-1, 0)
    b = (_mix(low + number * np.uint32(0x85EBCA77)) >> np.uint32(8)).astype(np.float32)
    b -= np.float32(16777215.5)
    b *= np.float32(2.0 ** -24)
    mark = low
    if (weights != 1).any():
        t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + (b + np.float32(1)))
        b -= t
        mark = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
    b *= r
    ln_a += b
    bits = ln_a.view(np.uint32)
    bits &= ~_MARK
    bits |= _mix(mark ^ np.uint32(0x5BD1E995)) & _MARK
    return ln_a


class Sampler:
    """Signatures of word bags, with a bounded table of drawn rows."""

    def __init__(self, samples: int = SAMPLES, rows: int = CACHE_ROWS):
        self.samples, self.rows, self.place = samples, rows, {}
        self.drawn = np.empty((rows, samples), np.float32)

    def _fill(self, keys: list, seeds: list, weights: np.ndarray) -> np.ndarray:
        """Draw the rows of ``keys`` into the table; the least of them in each sample."""
        best = np.full(self.samples, np.inf, np.float32)
        seeds = np.array(seeds, np.uint64)
        for at in range(0, len(keys), _BLOCK):
            part, first = keys[at:at + _BLOCK], len(self.place)
            rows = draw(seeds[at:at + _BLOCK], weights[at:at + _BLOCK], self.samples)
            self.drawn[first:first + len(part)] = rows
            self.place.update(zip(part, range(first, first + len(part))))
            np.minimum(best, rows.min(axis=0), out=best)
        return best

    def signature(self, bag: Counter) -> np.ndarray:
        """One mark a sample; all 0xFFFF, which no mark is, for an empty bag."""
        from xxhash import xxh64_intdigest
        if not bag:
            return np.full(self.samples, 0xFFFF, np.uint16)
        best = np.full(self.samples, np.inf, np.float32)
        # words of weight 1, most of all, are drawn apart; their key is the word itself
        ones = [w for w, n in bag.items() if n == 1]
        step = self.rows // 2
        for keys in (ones, [k for k in bag.items() if k[1] != 1]):
            for at in range(0, len(keys), step):
                part = keys[at:at + step]
                if len(self.place) + len(part) > self.rows:
                    self.place.clear()
                rows = np.fromiter(map(self.place.get, part, repeat(-1)), np.intp, len(part))
                known = rows[rows >= 0]
                if len(known):
                    np.minimum(best, self.drawn.take(known, axis=0).min(axis=0), out=best)
                if len(known) < len(part):
                    new = [part[k] for k in np.flatnonzero(rows < 0).tolist()]
                    words, weights = (new, np.ones(len(new))) if keys is ones else zip(*new)
                    np.minimum(best, self._fill(new, [xxh64_intdigest(w, 11) for w in words], np.asarray(weights)), out=best)
        return (best.view(np.uint32) & _MARK).astype(np.uint16)


def text_bag(text: str) -> Counter:
    return Counter(text.encode("utf-8").split())


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, other: str) -> str:
    """``text`` with its last third replaced by the beginning of ``other``."""
    k = len(text) // 3
    return text[:len(text) - k] + other[:k]


_SAMPLERS: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    if samples not in _SAMPLERS:
        _SAMPLERS[samples] = Sampler(samples)
    return _SAMPLERS[samples]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint (hex) of every row, in place.  Null text counts as empty, all
    empty texts share one fingerprint; other columns are ignored; no rows give none."""
    def run(rows):
        s = sampler(samples)
        return {"doc_id": rows["doc_id"], "fingerprint": [to_hex(s.signature(text_bag(t or ""))) for t in rows["text"]]}
    return map_lists(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def neighbour_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    where the next document is the one with the next smaller doc_id (after the last: the
    first) and the edited text ends with its beginning.

    Documents are dealt into ranges of doc_id at quantiles (one number per range reaches the
    driver), sorted in each, and every range also gets the first row of the next one.  Null
    doc_ids come last, equal doc_ids follow in text order; a table of one row is its own
    next; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(c) for c in base.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)})
    # range 0 has the largest ids; doc_id may be null: last range
    part = F.lit(0)
    if cuts:
        part = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc_id")))
    keyed = base.withColumn("part", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(part))
    # first row of each range: a handful of rows with the range's largest doc_id
    tops = keyed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()  # a row per range
    order = sorted(tops, key=lambda r: r["part"])
    lead = {r["part"]: order[k - 1]["part"] for k, r in enumerate(order)}
    if not order:
        lead = {0: 0}
    ids = [r["top"] for r in order if r["top"] is not None]
    first = keyed.filter(F.col("doc_id").isin(ids) if ids else F.lit(False))
    if any(r["top"] is None for r in order):
        least = keyed.filter("doc_id is null").groupBy("part").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", "part")
    else:
        least = None
    first = first.groupBy("part", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", "part")
    first = first if least is None else first.unionByName(least)
    before = F.create_map(*[F.lit(x) for pair in sorted(lead.items()) for x in pair])
    tails = first.withColumn("part", before[F.col("part")]).withColumn("tail", F.lit(True))
    # each range is a partition of its own
    rows = (keyed.withColumn("tail", F.lit(False)).unionByName(tails).repartitionById(len(cuts) + 2, F.col("part"))
            .sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text"))

    class Walk:
        def __init__(self):
            self.s, self.held = sampler(samples), None

        def __call__(self, rows):
            out = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for doc_id, text, part, tail in zip(rows["doc_id"], rows["text"], rows["part"], rows["tail"]):
                mark = self.s.signature(text_bag(text))
                if self.held and self.held[0] == part:
                    _, old_id, old, old_mark = self.held
                    new = edited(old, text)
                    new_mark = old_mark if new == old else self.s.signature(text_bag(new))
                    for c, v in zip(out, (old_id, len(old), hashlib.sha256(new.encode("utf-8")).hexdigest(), to_hex(old_mark),
                                          to_hex(new_mark), likeness(old_mark, new_mark), likeness(old_mark, mark))):
                        out[c].append(v)
                self.held = None if tail else (part, doc_id, text, mark)
            return out

    return map_lists(rows, Walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
