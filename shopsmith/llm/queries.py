"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_prefix, divergence, exact_blocks, lexical, packing, quality, resampling, rlz, secrets, simhash, token_planes, toxicity, weighted_sampling
from .common import documents, labels


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.dictionary_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    got = secrets.scan(documents(spark, sf_dir), words)
    return got.select("doc_id", "at", "part", F.length("value").alias("length"),
                      F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", "is_secret")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(documents(spark, sf_dir), shingle_words=3, radius=2)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality_rules(documents(spark, sf_dir))


def op4_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.neighbour_fingerprints(documents(spark, sf_dir))


def op6_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rlz.remove_duplicates(documents(spark, sf_dir), window=50)
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_file_digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"),
                                           keeps_spaces=True, end_id=0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe_prefix.encode_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), keeps_spaces=False, end_id=1)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.learn(docs, labels(spark, sf_dir)))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op12_exact_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_blocks.exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_divergence": op3_divergence,
    "op4_weighted_sampling": op4_weighted_sampling,
    "op5_token_planes": op5_token_planes,
    "op6_rlz": op6_rlz,
    "op7_quality": op7_quality,
    "op8_bpe_prefix": op8_bpe_prefix,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_resampling": op11_resampling,
    "op12_exact_blocks": op12_exact_blocks,
    "op13_lexical": op13_lexical,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op6_rlz": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d WHERE len(words) >= 50)),
earliest AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM windows JOIN earliest USING (win) WHERE doc_id > least),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept_text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    # DuckDB has no crc32: its table and the walk over a word's bytes are stated in SQL
    "op11_resampling": f"""
WITH step AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b)) AS crc),
d AS (SELECT doc_id, {_TERMS} AS words FROM documents),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest({_TERMS}) AS word FROM benchmark) GROUP BY ALL),
hexes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
byte_lists AS (SELECT word, list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM hexes),
buckets AS (SELECT word, xor(list_reduce(b, lambda c, x: xor(crc[xor(c, x) % 256 + 1], c // 256), 4294967295), 4294967295) % 10000 AS bucket FROM byte_lists, step),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain
         FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(coalesce(words, []))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM d LEFT JOIN w USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                  (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed""",
    "op12_exact_blocks": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS whole FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(whole) AS text_sha256
FROM t WINDOW same AS (PARTITION BY whole)""",
    "op13_lexical": f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM placed WHERE place <= 10""",
}
