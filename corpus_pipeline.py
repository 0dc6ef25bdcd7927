"""From raw documents to token ids: five stages, each over all that its predecessor kept.

1. quality: documents that the attention classifier scores below 0.3 go;
2. near_duplicates: one document of every group of links at a Jaccard
   similarity of 0.8 on five-word shingles stays, that of the smallest doc_id;
3. secrets: every secret found is replaced by a mark, and n_chars follows;
4. mixing: each document stays as often as the mix of sources takes it, rounded
   to whole documents;
5. encode: token ids of every row that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, jaccard, mixing, quality, secrets
from llm.common import saved, shipped, table
from llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
HELD = 100_000  # words that a task knows; workers keep them while other stages run


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return jaccard.deduplicated(docs.select(*COLUMNS))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), a row per copy that the mix took."""
    shipped(spark)
    ids = bpe.encode(docs, VOCABULARY, held=HELD)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                      F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("secrets", _secrets),
    ("mixing", _mixing),
    ("encode", _encode),
]

# a trained classifier and a tokenizer can't be put in SQL; tests compare with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
