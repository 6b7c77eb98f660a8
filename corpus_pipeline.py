"""Training-text pipeline: ``documents`` in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before it kept;
``run`` writes every stage's result as Parquet in the shared scratch folder and reads it
again, so a lost executor costs one stage's tasks, not the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsmith.llm import packing, rlz, secrets, simhash, toxicity
from shopsmith.llm.common import documents, labels, stage
from shopsmith.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go (10)."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash group stays: the smallest doc_id (2)."""
    return simhash.drop_near_duplicates(docs, shingle_words=3, radius=2)


def cut_duplicate_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words that an earlier document has go; documents stay (6)."""
    return _recounted(rlz.remove_duplicates(docs, window=50, keep_columns=True))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; documents stay (1)."""
    words = secrets.dictionary_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _recounted(secrets.redact(docs, secrets.scan(docs, words)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048 (9): a row per piece of a document."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), keeps_spaces=False, end_id=1)


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_duplicate_passages),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: The forest, the learnt lexicon and the token ids have no SQL form; tests/llm checks the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
