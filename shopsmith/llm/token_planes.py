"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each plane
compressed with zstandard, with a chunk index beside them.

One row of the file table is one block: ``shard, chunk, first_id`` (position of its first id
in the shard), ``n_ids``, ``plane_bytes`` (compressed length of each plane, the block's index),
``payload`` (the planes one after the other) and ``pieces`` (which document's ids stand where).
Shards follow each other in document order; inside a shard ids do.  The rows are written by
Spark as Parquet, so a lost executor's half-written block never shows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_lists, scratch_path, small_batches
from .tokens import encoder

#: Ids in a block.
BLOCK_IDS = 65_536
ZSTD_LEVEL = 3
#: The format's largest id is 2**24 - 1 when three planes are enough, and so on.
BLOCK_SCHEMA = ("shard int, chunk int, first_id long, n_ids int, plane_bytes array<int>, payload binary, "
                "pieces array<struct<doc_id:long,row:long,at:long,length:int,total:long>>")


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Plane p holds byte (or bit) p of every id, lowest first, as many planes as the
    largest id of the block needs (at least one)."""
    top = int(ids.max()) if len(ids) else 0
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, p].tobytes() for p in range(max(1, (top.bit_length() + 7) // 8))]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(max(1, top.bit_length()))]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    out = np.zeros(n, dtype="<u4")
    for p, plane in enumerate(planes):
        if kind == "byte":
            out |= np.frombuffer(plane, np.uint8).astype("<u4") << np.uint32(8 * p)
        else:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(p)
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, keeps_spaces: bool, end_id: int = 0,
                      kind: str = "byte", block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Write the ids of every document, ``end_id`` after each, ascending by doc_id, to ``path``.

    Texts are range-partitioned by (doc_id, text) and tokenised after that one shuffle;
    a task holds one block of ids.  Null or empty text: only ``end_id``.  Null doc_ids come
    first; repeated rows are written each; equal doc_ids stand in text order; other columns
    are ignored; an empty table gives an empty file table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select("doc_id", "text")
               .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))

    class Writer:
        def __init__(self):
            import zstandard
            from pyspark import TaskContext
            self.enc, self.end = encoder(tokenizer, keeps_spaces), np.array([end_id], "<u4").tobytes()
            self.shard, self.chunk, self.first, self.row = TaskContext.get().partitionId(), 0, 0, 0
            self.zstd = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
            self.held, self.size, self.pieces, self.out = [], 0, [], []

        def flush(self):
            ids = np.frombuffer(b"".join(self.held), "<u4")
            planes = [self.zstd.compress(p) for p in to_planes(ids, kind)]
            self.out.append((self.shard, self.chunk, self.first, len(ids), [len(p) for p in planes],
                             b"".join(planes), self.pieces))
            self.chunk, self.first = self.chunk + 1, self.first + len(ids)
            self.held, self.size, self.pieces = [], 0, []

        def taken(self):
            out, self.out = self.out, []
            names = [c.split()[0] for c in ("shard", "chunk", "first_id", "n_ids", "plane_bytes", "payload", "pieces")]
            return dict(zip(names, map(list, zip(*out)))) if out else None

        def __call__(self, rows):
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                data = self.enc.encode(text) + self.end
                total, at = len(data) // 4, 0
                while at < total:
                    k = min(total - at, block_ids - self.size)
                    self.held.append(data[4 * at: 4 * (at + k)])
                    self.pieces.append({"doc_id": doc_id, "row": self.row, "at": at, "length": k, "total": total})
                    at, self.size = at + k, self.size + k
                    if self.size == block_ids:
                        self.flush()
                self.row += 1
            return self.taken()

        def finish(self):
            if self.size:
                self.flush()
            return self.taken()

    map_lists(ordered, Writer, BLOCK_SCHEMA).write.parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, chunk, start (position of the block's first id among all ids), n_ids, plane_bytes."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    return (blocks.join(shard_starts(blocks), "shard")
            .select("shard", "chunk", (F.col("first_id") + F.col("shard_start")).alias("start"), "n_ids", "plane_bytes"))


def shard_starts(blocks: DataFrame) -> DataFrame:
    """One row per shard: ids in all shards before it."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))


def _stored(rows, kind: str):
    """(shard, piece, position of its first id in the shard, its ids) of blocks' documents."""
    import zstandard
    unzip = zstandard.ZstdDecompressor()
    for shard, first, n, sizes, payload, pieces in zip(*(rows[c] for c in (
            "shard", "first_id", "n_ids", "plane_bytes", "payload", "pieces"))):
        ends = np.cumsum([0, *sizes])
        data = memoryview(from_planes([unzip.decompress(payload[a:b]) for a, b in zip(ends, ends[1:])], n, kind).tobytes())
        at = 0
        for p in pieces:
            yield shard, p, first + at, data[4 * at: 4 * (at + p["length"])]
            at += p["length"]


def _read(spark: SparkSession, path: str, kind: str, value: str, of) -> DataFrame:
    """shard, row, doc_id, at, length, total, position and ``value`` (a name and type), which is
    ``of`` a piece's ids, for every piece of a document."""
    def run(rows):
        out = {c: [] for c in ("shard", "row", "doc_id", "at", "length", "total", "position", value.split()[0])}
        for shard, p, position, ids in _stored(rows, kind):
            for column, v in zip(out.values(), (shard, p["row"], p["doc_id"], p["at"], p["length"], p["total"], position, of(ids))):
                column.append(v)
        return out

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    return map_lists(blocks, run, f"shard int, row long, doc_id long, at long, length long, total long, position long, {value}")


def read_token_files(spark: SparkSession, path: str, kind: str = "byte") -> DataFrame:
    """The pieces of documents in every block: shard, row (document number in its shard),
    doc_id, at (ids of the document before the piece), total, position in the shard, ids."""
    return _read(spark, path, kind, "ids binary", bytes).drop("length")


def read_digests(spark: SparkSession, path: str, kind: str = "byte") -> DataFrame:
    """shard, doc_id, begin (position of its first id in the shard), n_tokens and ids_crc32 of
    every document.  The files are read once, and of a document's ids only the checksum of
    each piece goes on: that of a document cut by a block's end is made of its pieces'."""
    class Join:
        def __init__(self):
            self.last = None

        def __call__(self, rows):
            out = []
            for shard, row, doc_id, length, total, position, crc in zip(*(rows[c] for c in ("shard", "row", "doc_id", "length", "total", "position", "ids_crc32"))):
                if self.last is not None and self.last[:2] == [shard, row]:
                    self.last[5] = crc32_joined(self.last[5], crc, 4 * length)
                else:
                    out.append(self.last)
                    self.last = [shard, row, doc_id, position, total, crc]
            return self.columns(out)

        def finish(self):
            return self.columns([self.last])

        @staticmethod
        def columns(found):
            found = [r for r in found if r is not None]
            return dict(zip(("shard", "row", "doc_id", "begin", "n_tokens", "ids_crc32"), zip(*found))) if found else None

    pieces = _read(spark, path, kind, "ids_crc32 long", zlib.crc32)
    ordered = pieces.repartition("shard", "row").sortWithinPartitions("shard", "row", "at").select(
        "shard", "row", "doc_id", "length", "total", "position", "ids_crc32")
    return map_lists(ordered, Join, "shard int, row long, doc_id long, begin long, n_tokens long, ids_crc32 long").drop("row")


def crc32_joined(first: int, second: int, n: int) -> int:
    """The CRC-32 of some bytes and ``n`` more after them, from the two CRC-32s."""
    zeros = bytes(n)
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def token_file_digests(docs: DataFrame, tokenizer: str, keeps_spaces: bool, end_id: int = 0) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-planes")
    write_token_files(docs, path, tokenizer, keeps_spaces, end_id)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    return (read_digests(spark, path).join(F.broadcast(shard_starts(blocks)), "shard")  # a row per shard
            .select("doc_id", (F.col("begin") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"))
