"""Ranked lexical search by presence-mask grouping.

Every task holds its documents in segments.  A segment has, for each query term, a bitmap of
the documents with the term and their exact contributions to a score, of which the largest
bounds the term.  For an item the bitmaps of its terms are transposed into one mask per
document, documents with one mask form a group, and a group's bound is the sum of its terms'
bounds.  Groups are scored exactly in descending order of their bounds until the next bound
lies under the k-th score found so far in the task; nothing is scored after that.

Counts of documents, terms and document frequencies come from one pass over all texts that
keeps only query terms.  Items are taken in blocks of a bounded number of terms, so what goes
to the workers does not grow with the item table; a block passes over the documents once.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, small_batches, stage

TOP = 10
#: Share of the document's length in a term's weight, in hundredths.
LENGTH_SHARE = 90
#: Terms of the items that are searched at once, about.
BLOCK_TERMS = 50_000
#: Documents of a segment, and bytes of a table of terms by documents that are filled at once.
SEGMENT, TABLE_BYTES = 4096, 16 << 20
#: Window partitions that the tasks' best rows of an item are first reduced in.
SPREAD = 64

_TERM = re.compile(rb"[^ ]+")


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all beyond ASCII, A-Z lower-cased; null: none."""
    return _TERM.findall((text or "").encode("utf-8").translate(WORD_BYTES))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item; rows of one item_id count as one item."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(
        lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))).alias("term")).distinct())


_FOUND = "doc_id long, n long, terms array<int>, counts array<long>"


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (all terms of the text), terms and counts (of ``vocabulary``, a broadcast
    dict of term to number) of every row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        number = vocabulary.value
        for batch in batches:
            out = {c: [] for c in schema.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                found = [(number[w], c) for w, c in Counter(words).items() if w in number]
                for c, v in zip(out, (doc_id, len(words), [k for k, _ in found], [c for _, c in found])):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def length_terms(n: np.ndarray, documents: int, total: int, share: int = LENGTH_SHARE) -> np.ndarray:
    """100 - share + ((share * n * documents) div total) of each length."""
    if share * int(n.max(initial=0)) * documents < 1 << 63:
        return 100 - share + share * n * documents // max(1, total)
    return np.array([100 - share + share * x * documents // total for x in n.tolist()], np.int64)


class Segment:
    """Documents with their query terms: bitmaps, contributions and bounds by term."""

    def __init__(self, doc_id, n, lengths, terms, counts, weight, m):
        self.doc_id, docs = doc_id, len(doc_id)
        doc = np.repeat(np.arange(docs, dtype=np.int32), lengths)
        order = np.argsort(terms, kind="stable")
        terms, doc, tf = terms[order], doc[order], counts[order]
        self.value = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        present, first = np.unique(terms, return_index=True)
        self.doc, self.first, self.end = doc, first, np.r_[first[1:], len(terms)].astype(np.int64)
        self.bound = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0, np.int64)
        self.row = np.full(len(weight), -1, np.int64)
        self.row[present] = np.arange(len(present))
        self.bits = np.zeros((len(present), (docs + 7) // 8), np.uint8)
        step = max(1, TABLE_BYTES // max(1, docs))
        for a in range(0, len(present), step):
            b = min(a + step, len(present))
            table = np.zeros((b - a, docs), bool)
            where = slice(first[a], self.end[b - 1])
            table[np.repeat(np.arange(b - a), self.end[a:b] - first[a:b]), doc[where]] = True
            self.bits[a:b] = np.packbits(table, axis=1)

    def scores(self, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of ``docs`` (ascending) over the terms in ``rows``."""
        total = np.zeros(len(docs), np.int64)
        for r in rows:
            own = self.doc[self.first[r]:self.end[r]]
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            total += np.where(own[at] == docs, self.value[self.first[r] + at], 0)
        return total

    def groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents ordered by mask, first place of each mask, bound of each mask)."""
        table = np.unpackbits(self.bits[rows], axis=1, count=len(self.doc_id))
        mask = np.packbits(table, axis=0)  # a byte holds eight terms of one document
        wide = np.zeros((len(self.doc_id), -(-len(mask) // 8) * 8), np.uint8)
        wide[:, :len(mask)] = mask.T
        words = wide.view(np.uint64)
        order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
        words = words[order]
        first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])
        return order, first, table[:, order[first]].T.astype(np.int64) @ self.bound[rows]

    def search(self, terms: np.ndarray, best: list, top: int) -> list:
        """The ``top`` of ``best`` and this segment: (-score, doc_id), in order."""
        rows = self.row[terms]
        rows = rows[rows >= 0]
        rows = rows[self.bound[rows] > 0]
        floor = -best[top - 1][0] if len(best) >= top else 1
        if not len(rows) or int(self.bound[rows].sum()) < floor:
            return best
        order, first, bound = self.groups(rows)
        size = np.diff(np.r_[first, len(order)])
        todo = np.argsort(-bound, kind="stable")
        todo, want = todo[bound[todo] > 0], top
        while len(todo):
            # some of the highest masks, twice as many documents each time
            take = int(np.searchsorted(np.cumsum(size[todo]), want)) + 1
            now, todo, want = todo[:take], todo[take:], 2 * want
            now = now[bound[now] >= floor]
            if not len(now):
                break
            docs = np.sort(np.concatenate([order[first[g]:first[g] + size[g]] for g in now]))
            score = self.scores(rows, docs)
            good = score >= floor
            found = list(zip((-score[good]).tolist(), self.doc_id[docs[good]].tolist()))
            best = sorted(best + found)[:top]
            floor = -best[top - 1][0] if len(best) >= top else 1
        return best


def _best_rows(found: DataFrame, items, documents: int, total: int, weight: np.ndarray, top: int, segment: int) -> DataFrame:
    """item_id, doc_id, score: the ``top`` documents of each item in each task."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        queries, best, held, rows = items.value, {}, [], 0

        def work():
            whole = pa.Table.from_batches(held).combine_chunks()
            doc_id, n, terms, counts = (whole.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "counts"))
            part = Segment(doc_id.to_numpy(), n.to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(),
                           counts.flatten().to_numpy(), weight, length_terms(n.to_numpy(), documents, total))
            for item, wanted in queries:
                best[item] = part.search(wanted, best.get(item, []), top)

        for batch in batches:
            for at in range(0, batch.num_rows, segment):
                piece = batch.slice(at, segment)
                if rows + piece.num_rows > segment:
                    work()
                    held, rows = [], 0
                held.append(piece)
                rows += piece.num_rows
        if held:
            work()
        out = [(item, doc, -score) for item, rows in best.items() for score, doc in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return found.filter("doc_id is not null and size(terms) > 0").mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(rows: DataFrame, top: int, *keys: Column | str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, segment: int = SEGMENT) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of ``docs`` (doc_id, text) with a
    score above 0 for each row of ``items`` (item_id, text), ties by doc_id.

    Null texts have no terms; an item without terms, or with none in any document, has no
    rows.  Rows of one item_id are one item with the terms of all its texts; a null item_id
    asks nothing.  A row of ``docs`` without doc_id counts in all statistics but is not
    listed; rows that repeat a doc_id are ranked each.  Other columns are ignored; an empty
    table on either side gives none.
    """
    spark = docs.sparkSession
    wanted = stage(item_terms(items), "search-items")
    blocks = -(-wanted.count() // block_terms)
    parts = []
    for block in range(blocks):
        # a block of items: about block_terms rows reach the driver
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").collect()
        if not rows:
            continue
        number: dict[bytes, int] = {}
        asked: dict[int, list[int]] = {}
        for r in rows:
            asked.setdefault(r["item_id"], []).append(number.setdefault(r["term"].encode("utf-8"), len(number)))
        found = stage(term_counts(docs, spark.sparkContext.broadcast(number)), "search-terms")
        documents, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # as many numbers as the block has terms
        df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = np.array([math.floor(1000 * math.log(float(2 * documents + 2) / float(2 * df.get(t, 0) + 1))) for t in range(len(number))], np.int64)
        queries = spark.sparkContext.broadcast([(item, np.array(t, np.int64)) for item, t in asked.items()])
        parts.append(stage(_best_rows(found, queries, documents, total, weight, top, segment), "search-best"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    few = _ranked(best, top, "item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).drop("rank")
    return _ranked(few, top, "item_id").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
