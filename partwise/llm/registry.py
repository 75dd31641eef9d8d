"""Queries of this subpackage by name, and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from partwise.llm import bpe, langid, mixing, neardup, passages, quality, secrets, topk, urls, warc
from partwise.llm.common import table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.allocate(table(spark, sf_dir, "documents"))


def op2_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over two-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), length=2, least=80)


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, describe each capture."""
    return warc.digests(warc.transactions(table(spark, sf_dir, "pages")))


def op4_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents"))


def op5_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_bwt_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 200-byte passages."""
    return passages.removed(table(spark, sf_dir, "documents"))


def op7_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_url_digest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Callables ``(spark, sf_dir) -> DataFrame`` by query name."""
    return {
        "op1_pareto_mix": op1_pareto_mix,
        "op2_chosen_path_dedup": op2_chosen_path_dedup,
        "op3_warc_transactions": op3_warc_transactions,
        "op4_robust_quality": op4_robust_quality,
        "op5_rank_order_language": op5_rank_order_language,
        "op6_bwt_passages": op6_bwt_passages,
        "op7_bpe_encode": op7_bpe_encode,
        "op8_url_digest_filter": op8_url_digest_filter,
        "op9_norm_sorted_topk": op9_norm_sorted_topk,
        "op10_secret_grammar": op10_secret_grammar,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, where SQL can express the query."""
    found = {"op1_pareto_mix": mixing.SQL, "op3_warc_transactions": warc.SQL, "op8_url_digest_filter": urls.SQL, "op9_norm_sorted_topk": topk.SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
