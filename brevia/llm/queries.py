"""Queries of the training-data operators over the shared tables, with production parameters and no limits."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import leaks
from .embedding_dedup import near_duplicates
from .fingerprints import edited_fingerprints
from .language import identify
from .mixing import mix_plan
from .ngram_join import ngram_join
from .oracles import MIXING, URLS
from .periodic_runs import periodic_runs, run_digest, with_planted_runs
from .pii import pseudonymise
from .quality import quality
from .token_counts import token_counts
from .token_files import token_files
from .url_filter import judge_urls
from .whitening import whiten


_keys: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).rows


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def pii_key(spark: SparkSession) -> str:
    """The secret of ``spark.brevia.pii.key``; where it is unset, a random one that lasts as long as the application."""
    named = spark.conf.get("spark.brevia.pii.key", None)
    return named or _keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_entities")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents")).drop("edited")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_quality_classifier, op3_ngram_jaccard_join, op4_benchmark_decontamination, op5_token_files, op6_source_mixing, op7_embedding_near_dedup,
        op8_language_id, op9_token_counts, op10_pii_surrogates,
        op11_periodic_runs, op12_document_fingerprints, op13_embedding_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_url_filters": URLS, "op6_source_mixing": MIXING}
