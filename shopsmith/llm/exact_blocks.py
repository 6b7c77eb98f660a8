"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of a fixed number of characters.  The distinct blocks
of the corpus are sorted and numbered: equal blocks, and no others, share an integer name.
Then adjacent names are paired, the distinct pairs sorted and numbered in the same way, and
so on until each document has one name: documents are equal if and only if they come to the
same name at the same level.  No result rests on a hash: names are handed to the documents
over a hash of the block, and a hash that two different blocks share is found from the names
themselves and looked up by the whole block instead.

Texts are shuffled once (the distinct blocks, pre-aggregated before the shuffle); all else
moves hashes, names and ids.  A block or text that a third of all rows have is one row after
the pre-aggregation, and the rows that wait for its name are split by Spark's skew join,
which sees two plain exchanges as names are written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stage

#: Characters of a block.
BLOCK_CHARS = 4096
#: Name of the missing right half of a pair.
NOTHING = -1
_W = r"\x20\x09-\x0D"


def normalised(text: Column | str = "text") -> Column:
    """A text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_W}]+", " ")


def _blocks(text: Column, block_chars: int) -> Column:
    """The text's blocks; an empty text has one, which is empty."""
    return F.when(text == "", F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}+"), F.lit(0)))


def _numbered(distinct: DataFrame, order: list[str], keep: list[str], what: str) -> DataFrame:
    """``keep`` and ``name`` of each row of ``distinct``: partition number and place in the
    partition's order.  Written, so that every reader sees the same names."""
    return stage(distinct.sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("name")), what)


def _block_names(texts: DataFrame, rows: DataFrame, block_chars: int, hash_of) -> DataFrame:
    """``rows`` (id, key, at, h and more) with the name of their block in place of ``h``."""
    blocks = texts.select("id", "key", F.posexplode(_blocks(F.col("text"), block_chars)).alias("at", "block"))
    blocks = blocks.withColumn("h", hash_of(F.col("block")))
    names = _numbered(blocks.select("h", "block").distinct(), ["block"], ["h"], "block-names")
    shared = stage(names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "block-shared")
    named = rows.join(names, "h").drop("h")
    if shared.isEmpty():
        return named
    # a hash that several blocks have: their rows look names up by the block itself
    whole = blocks.join(shared, "h").select("id", "key", "at", "block")
    own = _numbered(whole.select("block").distinct(), ["block"], ["block"], "block-own").withColumn("name", NOTHING - 1 - F.col("name"))
    where = whole.join(own, "block").select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("at").alias("a"), "name").distinct()
    rest = rows.join(shared, "h").drop("h")
    rest = rest.join(where, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("at") == F.col("a"))).drop("i", "k", "a")
    return rows.join(shared, "h", "left_anti").join(names, "h").drop("h").unionByName(rest)


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_of=F.xxhash64) -> DataFrame:
    """id (doc_id), key (hash of the normalised text), times, sha, level, name: one row per
    doc_id and text, ``times`` counting the rows that repeat both.  Two rows have the same
    level and name if and only if their normalised texts are equal.

    Rows of one doc_id are told apart by ``key``, rows of different ids never are.
    """
    texts = docs.select(F.col("doc_id").alias("id"), normalised().alias("text")).withColumn("key", F.xxhash64("text"))
    lists = stage(
        texts.select("id", "key", F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                     F.transform(_blocks(F.col("text"), block_chars), lambda b: hash_of(b)).alias("blocks"))
        .groupBy("id", "key").agg(F.count(F.lit(1)).alias("times"), F.first("sha").alias("sha"), F.first("blocks").alias("blocks")), "block-lists")
    rows = lists.select("id", "key", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "h"), "times", "sha")
    # one row of each document carries what belongs to the document
    first = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    now = _block_names(texts, rows.select("id", "key", "n", "at", "h", first("times"), first("sha")), block_chars, hash_of)
    now = stage(now, "block-level")
    done, level = now.filter("n = 1").select("id", "key", "times", "sha", F.lit(0).alias("level"), "name"), 0
    longest = lists.agg(F.max(F.size("blocks"))).first()[0] or 1  # one number
    while 1 << level < longest:
        level += 1
        half = F.shiftright("at", 1)
        pairs = (now.filter("n > 1").groupBy("id", "key", half.alias("at"))
                 .agg(F.shiftright(F.max("n") + 1, 1).alias("n"), F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(NOTHING)).alias("r"),
                      F.max("times").alias("times"), F.max("sha").alias("sha")))
        pairs = stage(pairs, "block-pairs")
        names = _numbered(pairs.select("l", "r").distinct(), ["l", "r"], ["l", "r"], "pair-names")
        now = stage(pairs.join(names, ["l", "r"]).select("id", "key", "n", "at", "times", "sha", "name"), "block-level")
        done = done.unionByName(now.filter("n = 1").select("id", "key", "times", "sha", F.lit(level).alias("level"), "name"))
    return done


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_of=F.xxhash64) -> DataFrame:
    """doc_id, key, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when identical after each run of white space became one space; null
    counts as empty.  ``keep_id`` is the group's smallest doc_id, null only if all are null.
    Rows that repeat a doc_id and its text are returned each, one of them as kept; of several
    rows with the smallest doc_id but unlike white space, one is kept too.  Other columns are
    ignored; an empty table gives none.
    """
    found = identities(docs, block_chars, hash_of)
    # rows without an id come last; a group of one row needs no look-up
    who = F.struct(F.col("id").isNull().alias("no_id"), "id")
    groups = stage(found.groupBy("level", "name").agg(F.min(who).alias("least"), F.sum("times").alias("group_size"))
                   .filter("group_size > 1").select("level", "name", F.col("least.id").alias("least"), "group_size", F.lit(True).alias("several")), "block-groups")
    rows = found.join(groups, ["level", "name"], "left").withColumn("keep_id", F.when(F.col("several"), F.col("least")).otherwise(F.col("id")))
    rows = rows.select("id", "key", "keep_id", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "sha",
                       F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return rows.select(F.col("id").alias("doc_id"), "key", "keep_id", "group_size",
                       (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all columns."""
    id_, key = free_names(docs, "id", "key")
    keep = (exact_duplicates(docs, block_chars).filter("kept")
            .select(F.col("doc_id").alias(id_), F.col("key").alias(key)))
    keyed = docs.withColumn(key + "_own", F.xxhash64(normalised()))
    stay = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key + "_own") == F.col(key)), "left_semi")
    return stay.dropDuplicates(["doc_id", key + "_own"]).drop(key + "_own")
