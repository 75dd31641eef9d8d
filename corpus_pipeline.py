"""From raw documents to token ids: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from partwise.llm import bpe, mixing, neardup, quality, secrets
from partwise.llm.common import small_batches
from partwise.session import shared_dir

#: Chunks and words that an encoding worker keeps: its executor holds what earlier stages left, too.
KEPT = 150_000


def pass_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits and not outlying in their language and source."""
    return quality.passed(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    small_batches(spark)
    return neardup.deduplicated(docs, length=5, least=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    small_batches(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of the ids and of the text they decode to."""
    small_batches(spark)
    return bpe.encode(docs.select("doc_id", "source", "text"), kept=KEPT).drop("text")


STAGES = [
    ("quality rules", pass_quality),
    ("near-duplicate removal", drop_near_copies),
    ("secret scan", redact_secrets),
    ("source mix", mix_sources),
    ("BPE encoding", encode_texts),
]

#: Inference of automata, clusters and byte pairs isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
