"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

Fingerprints fall into tiles by the population counts of their four 16-bit quarters; two
fingerprints within the radius lie in tiles whose counts differ by no more than the radius
in total, so all other tile pairs are skipped.  A tile and what comes to it from its
neighbours are compared block by block with numpy exclusive-or and bit counts, blocks
whose byte population counts lie too far apart being skipped the same way.  A tile hands
on a spanning forest of its links, never all pairs, and components are found by Spark.
"""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_lists, stage
from .components import components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a tile, and of its neighbours, that are compared at a time, about; larger
#: tiles are cut by hash, and so are their guests.
TILE_ROWS = 100_000
#: Rows of a block inside a tile.
BLOCK = 128
_QUARTERS, _SHIFT = 4, 5  # 17 counts and the radius on either side fit 5 bits
_HASHES = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half the shingles' XXH64."""
    import xxhash
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    n = max(1, len(words) - shingle_words + 1)
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _HASHES):
        h = np.fromiter(hashes, "<u8", min(_HASHES, n - start))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); one row per input row."""
    def run(rows):
        fps = np.array([fingerprint(t, shingle_words) for t in rows["text"]], "<u8").view("<i8")
        return {"doc_id": rows["doc_id"], "fp": fps.tolist()}
    return map_lists(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _tile(fp) -> F.Column:
    key = F.lit(0)
    for q in range(_QUARTERS):
        key = key + F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF))) * F.lit(1 << (_SHIFT * q))
    return key.cast("int")


def tile_offsets(radius: int) -> list[int]:
    """Key differences from a tile to its neighbours with a smaller key."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=_QUARTERS) if 0 < sum(map(abs, s)) <= radius]
    return sorted(k for k in (sum(x << (_SHIFT * q) for q, x in enumerate(s)) for s in steps) if k < 0)


def _byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)


def forest_of_tile(home: np.ndarray, guests: np.ndarray, radius: int, block: int = BLOCK, inner: bool = True) -> list[tuple[int, int]]:
    """Links (root, other) that connect what is linked among ``home`` x (``home`` + ``guests``),
    or among ``home`` x ``guests`` alone if not ``inner``."""
    both = np.concatenate([home, guests])
    is_home = np.arange(len(both)) < len(home)
    counts = _byte_counts(both)
    order = np.lexsort((*counts.T, ~is_home))  # home first, alike counts together
    both, counts = both[order], counts[order]
    starts = list(range(0, len(home), block)) + list(range(len(home), len(both), block))
    ends = starts[1:] + [len(both)]
    lo = np.array([counts[a:b].min(axis=0) for a, b in zip(starts, ends)])
    hi = np.array([counts[a:b].max(axis=0) for a, b in zip(starts, ends)])
    label = np.arange(len(both))

    def roots(x: np.ndarray) -> np.ndarray:
        """The trees' roots; paths are shortened on the way."""
        r = label[x]
        while True:
            up = label[r]
            if np.array_equal(up, r):
                break
            r = up
        label[x] = r
        return r

    for i in range((len(home) + block - 1) // block):
        first = i if inner else -(-len(home) // block)
        apart = np.maximum(0, np.maximum(lo[i] - hi[first:], lo[first:] - hi[i])).sum(axis=1)
        for j in first + np.flatnonzero(apart <= radius):
            near = np.bitwise_count(both[starts[i]:ends[i], None] ^ both[None, starts[j]:ends[j]]) <= radius
            x, y = np.nonzero(near)
            a, b = roots(x + starts[i]), roots(y + starts[j])
            while (differ := a != b).any():
                # every larger root hangs on one of its smaller neighbours; again until none is left
                a, b = a[differ], b[differ]
                label[np.maximum(a, b)] = np.minimum(a, b)
                a, b = roots(a), roots(b)
    label = roots(np.arange(len(both)))
    other = np.flatnonzero(label != np.arange(len(both)))
    both = both.view("<i8")
    return list(zip(both[label[other]].tolist(), both[other].tolist()))


def groups(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(tile, cut, slot, fp, home): what is compared together, home rows with each other (in
    slot 0) and with the guests; about ``tile_rows`` of either in a group, whatever the tile."""
    keyed = fps.select("fp", _tile(F.col("fp")).alias("tile"))
    steps = tile_offsets(radius)
    near = lambda df: df.withColumn("tile", F.explode(F.transform(F.array(*map(F.lit, steps)), lambda s: s + F.col("tile"))))
    # tiles: at most 17 ** 4 rows whatever the input
    counted = stage(keyed.groupBy("tile").agg(F.count(F.lit(1)).alias("n")), "tile-sizes")
    # a tile's guests are all rows of its neighbours and, where it is cut, its own; home rows are
    # dealt to cuts and guests to slots by hash, so a group has about tile_rows of either
    many = lambda n: F.greatest(F.lit(1), F.ceil(n / tile_rows)).cast("int")
    own_cuts = counted.withColumn("cuts", many(F.col("n")))
    visits = own_cuts.filter("cuts > 1").select("tile", "n")
    if steps:
        visits = visits.unionByName(near(counted))
    visits = visits.groupBy("tile").agg(F.sum("n").alias("guests"))
    tiles = stage(own_cuts.join(visits, "tile", "left").select("tile", "cuts", many(F.coalesce("guests", F.lit(0))).alias("slots")), "tiles")
    hashed = lambda k, n: F.pmod(F.xxhash64("fp", F.lit(k)), F.col(n)).cast("int")
    every = lambda first, n: F.explode(F.sequence(F.lit(first) if isinstance(first, int) else first, F.col(n) - 1))
    own = keyed.join(F.broadcast(tiles), "tile").withColumn("cut", hashed(0, "cuts"))
    rows = own.select("tile", "cut", every(0, "slots").alias("slot"), "fp", F.lit(True).alias("home"))
    below = own.filter("cut + 1 < cuts").select("tile", every(F.col("cut") + 1, "cuts").alias("cut"), hashed(1, "slots").alias("slot"), "fp", F.lit(False).alias("home"))
    rows = rows.unionByName(below)
    if steps:
        rows = rows.unionByName(near(keyed).join(F.broadcast(tiles), "tile").select(
            "tile", every(0, "cuts").alias("cut"), hashed(1, "slots").alias("slot"), "fp", F.lit(False).alias("home")))
    return rows


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (``fps.fp``, unique) that connect all
    pairs within ``radius`` bits."""
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7")
    rows = groups(fps, radius, tile_rows).repartition("tile", "cut", "slot").sortWithinPartitions("tile", "cut", "slot")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        key, fp, home = None, [], []

        def compare():
            f, h = np.concatenate(fp).view("<u8"), np.concatenate(home)
            got = forest_of_tile(f[h], f[~h], radius, inner=key[1] == 0) if h.any() and len(f) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            tile, cut, slot, f, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            both = tile.astype(np.int64) << 32 | cut
            edges = [0, *(np.flatnonzero((np.diff(both) != 0) | (np.diff(slot) != 0)) + 1), len(both)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if key is not None and (both[a], slot[a]) != key:
                    yield compare()
                    fp, home = [], []
                key = (both[a], slot[a])
                fp.append(f[a:b])
                home.append(h[a:b].astype(bool))
        if fp:
            yield compare()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id that is reachable over
    fingerprints at most ``radius`` bits apart, the document's own included.

    Null and empty texts have fingerprint zero and link like any other; a null doc_id gets
    its component's id but never names one (null if it is alone); repeated rows are returned
    each; other columns are ignored; an empty table gives none.
    """
    own = stage(fingerprints(docs, shingle_words), "simhash")
    fps = stage(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps.select("fp"), radius))
    member = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(member.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of every component stays: the row of its component_id.  Rows without a
    doc_id stay; of rows repeating the kept doc_id, one stays.  All columns stay."""
    id_, rows = free_names(docs, "id", "rows")
    found = near_duplicates(docs, shingle_words, radius)
    keep = stage(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(id_))
                 .agg(F.count(F.lit(1)).alias(rows)), "simhash-kept")
    # as many ids as documents: a merge join at every size, no broadcast of what happens to be small
    kept = docs.join(keep.hint("merge"), F.col("doc_id") == F.col(id_))
    one = kept.filter(F.col(rows) == 1).unionByName(kept.filter(F.col(rows) > 1).dropDuplicates([id_]))
    return one.drop(id_, rows).unionByName(docs.filter("doc_id is null"))
