"""The queries opN_<name> of the training-data operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlgrain.llm import bpe, chat_format, embed_dedup, license_scan, ngram_join, packing, quality, secrets, source_audit, suffix_dedup, topk, url_filter, whitening
from crawlgrain.llm.oracle import ORACLES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's statistics and whether the base rules and the fitted trees keep it."""
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences of each document and the licences that rules find in their sequence."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shingle count and component under links of similarity 0.75 or more."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text loses with its 200-byte repeats, and the digest of the rest."""
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of each text's ids and of what they decode to."""
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each text: counts by pattern and spans, those of high entropy included."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's number of links at cosine 0.9 and its component."""
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of each pair of conversations."""
    return chat_format.format_preferences(chat_format.pair_answers(_table(spark, sf_dir, "conversations")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable embedding's coordinates on the 32 strongest components, at unit variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart from its language."""
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of highest inner product for each vector whose id is divisible by 50."""
    return topk.search(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules, op2_license_scans, op3_ngram_jaccard_join, op4_best_fit_packing, op5_url_filters,
        op6_suffix_array_dedup, op7_bpe_codec, op8_secret_scans, op9_embedding_near_dedup, op10_chat_formatting,
        op11_embedding_whitening, op12_source_divergence_audit, op13_exact_top_k,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
