"""A corpus pipeline of five stages over the documents table; counted with the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlgrain.llm import ngram_join, packing, quality, secrets, suffix_dedup
from crawlgrain.llm.common import materialize
from crawlgrain.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fitted trees keep, with all their columns.

    A null, empty or wordless text fails the base rules. Repeated rows are judged alike and all stay or go. Without labels
    the base rules alone decide. An empty table stays empty.
    """
    return quality.keep_good(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id, with all its columns.

    Null, empty and wordless texts are in no group and stay, as do rows with a null doc_id. Rows of one doc_id stay or go together.
    An empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start anywhere else, in this text or another; no document goes.

    Null texts stay null, shorter ones stay as they are; a text that is nothing but repeats becomes empty. Each of several
    equal rows is a text of its own, so they lose what they have in common. n_chars, if there, is counted anew. An empty table stays empty.
    """
    return suffix_dedup.remove_repeats(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets masked and n_chars, if there, counted anew; no document goes.

    Null texts stay null. Rows are taken one by one, so repeated rows stay. An empty table stays empty.
    """
    return secrets.mask(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048 tokens.

    A null or empty text is its end token alone. Every row is packed, repeated rows and rows with a null doc_id too. Only doc_id and text
    are read. An empty table gives an empty table.
    """
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The stages fit trees, cluster and tokenize, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
