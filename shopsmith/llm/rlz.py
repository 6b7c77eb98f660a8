"""Substring duplicates by relative Lempel-Ziv parsing against an indexed reference.

A passage of at least ``window`` words is a duplicate if its words also start in a document
with a smaller id.  The reference is cut into blocks by content: in every window of words
the least hash of the short word runs in it is its anchor, and neighbouring windows with
one anchor form a block, so equal passages are cut alike wherever they stand.  The index
holds each distinct block once, under its anchor, with the smallest document that has it.

A document is parsed greedily block by block: a block that the index knows from a smaller
document is one factor, copied whole.  At factor boundaries an anchor occurs with several
different blocks (the text differs before or after it).  A window reaches half its other
words to the left or to the right of its anchor, so these words and the anchor are a key
that any two blocks sharing the window have in common; where another document has the key,
the windows on that side are looked up one by one under it.  Factors of at least the window
length become duplicate spans.  Anchors are minima, so about one word run in twenty is
indexed, not every position.  Texts are shuffled compressed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_lists, stage, unstage

WINDOW = 50
#: Words of the runs whose hashes choose anchors.
RUN = 8
#: Word hashes kept per worker.
CACHE_WORDS = 100_000
_STEP = 0x9E3779B97F4A7C15 | 1


class _WordHash(dict):
    def __missing__(self, word):
        import xxhash
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


class Hasher:
    """Hashes of word ranges in constant time: prefix sums of word hash times step ** position,
    brought back to position zero by the step's inverse (all modulo 2 ** 64)."""

    def __init__(self):
        self.words, self.up, self.down = _WordHash(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = 1 << n.bit_length()
            inverse = pow(_STEP, -1, 1 << 64)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _STEP, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])

    def prefix(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        self._powers(n)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        return np.r_[np.uint64(0), np.cumsum(h * self.up[:n], dtype=np.uint64)]

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in every window of ``width``."""
    v, at, w = values, np.arange(len(values)), 1
    while w < width:
        step = min(w, width - w)
        left = v[:-step] <= v[step:]
        v, at, w = np.where(left, v[:-step], v[step:]), np.where(left, at[:-step], at[step:]), w + step
    return at


_HASHER: list[Hasher] = []


def _hasher() -> Hasher:
    if not _HASHER:
        _HASHER.append(Hasher())
    return _HASHER[0]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def blocks_of(words: list[bytes], window: int = WINDOW, run: int = RUN) -> dict[str, np.ndarray]:
    """The blocks of a document of at least ``window`` words: first window (start), number of
    windows, how many of them lie on the left side, and the hashes of anchor, whole block,
    left key and right key (zero where that side has no window)."""
    h = _hasher()
    prefix, n, side = h.prefix(words), len(words), (window - run) // 2
    pos = np.arange(n - run + 1)
    runs = h.ranges(prefix, pos, pos + run)
    at = sliding_argmin(runs, window - run + 1)
    first = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
    count = np.diff(np.r_[first, len(at)])
    anchor = at[first]
    whole = h.ranges(prefix, first, first + count + window - 1)
    whole = mix(whole + (anchor - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + count.astype(np.uint64))
    left = np.clip(anchor - side - first + 1, 0, count)
    left_key = np.where(left > 0, h.ranges(prefix, np.maximum(0, anchor - side), anchor + run), np.uint64(0))
    right_key = np.where(left < count, h.ranges(prefix, anchor, np.minimum(n, anchor + run + side)), np.uint64(0))
    return {"start": first, "windows": count, "left": left, "anchor": runs[anchor].view(np.int64) >> 32, "block": whole.view(np.int64),
            "left_key": left_key.view(np.int64), "right_key": right_key.view(np.int64)}


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.hash("text"))


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text compressed, to be shuffled."""
    from pyspark.sql.types import BinaryType, StructField, StructType
    schema = StructType([StructField(f.name, BinaryType()) if f.name == "text" else f for f in docs.schema])

    def run(rows):
        import zstandard
        zip_ = zstandard.ZstdCompressor(level=1)
        rows["text"] = [None if t is None else zip_.compress(t.encode("utf-8")) for t in rows["text"]]
        return rows

    return map_lists(docs, run, schema)


def _unpack(packed: bytes | None) -> str | None:
    import zstandard
    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed).decode("utf-8")


def duplicate_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row_key (hash of the text), spans: array of (start, windows), the duplicate
    windows of each document that has any."""
    keyed = _keyed(docs)
    names = ("start", "windows", "left", "anchor", "block", "left_key", "right_key")

    def cut(rows):
        out = {c: [] for c in ("doc_id", "row_key", *names)}
        for doc_id, text, key in zip(rows["doc_id"], rows["text"], rows["row_key"]):
            words = words_of(text)
            if doc_id is None or len(words) < window:
                continue
            found = blocks_of(words, window)
            out["doc_id"] += [doc_id] * len(found["start"])
            out["row_key"] += [key] * len(found["start"])
            for c in names:
                out[c] += found[c].tolist()
        return out

    blocks = stage(map_lists(keyed, cut, "doc_id long, row_key int, start int, windows int, left int, anchor int, block long, "
                                         "left_key long, right_key long"), "rlz-blocks")
    index = blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", F.lit(True).alias("several"))
    known = (index.join(several, "anchor", "left").filter("least < most or several")
             .select("anchor", "block", "least", F.coalesce("several", F.lit(False)).alias("several")))
    parsed = blocks.join(known, ["anchor", "block"]).withColumn("copied", F.col("doc_id") > F.col("least"))
    parsed = stage(parsed.filter("copied or several").select(
        "doc_id", "row_key", "start", "windows", "left", "left_key", "right_key", "copied"), "rlz-parsed")
    unstage(blocks)
    copied = parsed.filter("copied").select("doc_id", "row_key", "start", "windows")

    # factor boundaries: the first document with a block looks its windows up among the others
    edge = parsed.filter("not copied")
    sides = (edge.filter("left > 0").select("doc_id", "row_key", "start", F.col("left").alias("windows"), F.col("left_key").alias("key"))
             .unionByName(edge.filter("left < windows").select("doc_id", "row_key", (F.col("start") + F.col("left")).alias("start"),
                                                               (F.col("windows") - F.col("left")).alias("windows"), F.col("right_key").alias("key"))))
    shared = sides.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    edges = (sides.join(shared.select("key"), "key").groupBy("doc_id", "row_key")
             .agg(F.collect_list(F.struct("start", "windows", "key")).alias("sides")))

    def look(rows):
        out, h = {c: [] for c in ("doc_id", "row_key", "start", "key", "hash")}, _hasher()
        for doc_id, text, key, want in zip(rows["doc_id"], rows["text"], rows["row_key"], rows["sides"]):
            prefix = h.prefix(words_of(_unpack(text)))
            start = np.concatenate([np.arange(b["start"], b["start"] + b["windows"]) for b in want])
            out["doc_id"] += [doc_id] * len(start)
            out["row_key"] += [key] * len(start)
            out["start"] += start.tolist()
            out["key"] += np.repeat([b["key"] for b in want], [b["windows"] for b in want]).tolist()
            out["hash"] += h.ranges(prefix, start, start + window).view(np.int64).tolist()
        return out

    windows = stage(map_lists(_packed(keyed).join(edges, ["doc_id", "row_key"]).select("doc_id", "text", "row_key", "sides"), look,
                              "doc_id long, row_key int, start int, key long, hash long"), "rlz-windows")
    first = windows.groupBy("key", "hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    found = (windows.join(first.select("key", "hash", "least"), ["key", "hash"]).filter("doc_id > least")
             .select("doc_id", "row_key", "start", F.lit(1).alias("windows")))
    return (copied.unionByName(found).groupBy("doc_id", "row_key")
            .agg(F.collect_set(F.struct("start", "windows")).alias("spans")))


def remove_duplicates(docs: DataFrame, window: int = WINDOW, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space); with
    ``keep_columns`` the input's columns, ``text`` replaced where words were removed.

    Judged on the input: removals do not change what counts as duplicate.  Null or empty
    text: no words.  Repeated rows (same doc_id) never make each other duplicates; rows
    without a doc_id are neither reference nor cut; an empty table gives none.
    """
    id_, key, own, at = free_names(docs, "id", "key", "own", "spans")
    spans = duplicate_spans(docs, window).select(F.col("doc_id").alias(id_), F.col("row_key").alias(key), F.col("spans").alias(at))
    names = docs.columns if keep_columns else ["doc_id", "text"]
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], F.hash(F.coalesce("text", F.lit(""))).alias(own))
    joined = (_packed(keyed).join(spans, (F.col("doc_id") == F.col(id_)) & (F.col(own) == F.col(key)), "left")
              .drop(id_, key, own))

    def trim(text, found):
        words = words_of(text)
        gone = np.zeros(len(words) + 1, np.int32)
        for s in found or ():
            gone[s["start"]] += 1
            gone[s["start"] + s["windows"] + window - 1] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        return words, gone

    if not keep_columns:
        def run(rows):
            out = {"doc_id": rows["doc_id"], "n_words": [], "n_removed": [], "kept_text": []}
            for text, found in zip(rows["text"], rows[at]):
                words, gone = trim(_unpack(text), found)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_text"].append(b" ".join([w for w, g in zip(words, gone) if not g] if found else words).decode("utf-8"))
            return out
        return map_lists(joined, run, "doc_id long, n_words long, n_removed long, kept_text string")


    def rewrite(rows):
        found = rows.pop(at)
        rows["text"] = list(map(_unpack, rows["text"]))
        for k, f in enumerate(found):
            if f:
                words, gone = trim(rows["text"][k], f)
                rows["text"][k] = b" ".join([w for w, g in zip(words, gone) if not g]).decode("utf-8")
        return rows

    return map_lists(joined, rewrite, docs.schema)
