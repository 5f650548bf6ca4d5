"""A training-corpus pipeline over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import exact_dedup, jaccard_join, packing, substring_dedup, toxicity
from gneiss.llm.common import save
from gneiss.llm.queries import tokenizer_path

#: Words from which on a passage that other documents share is taken out.
PASSAGE_WORDS = 50


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted to a bounded sample of all labels, predicts to be toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a Jaccard similarity of 0.8, the smallest doc_id of a component stays."""
    return jaccard_join.drop_near_copies(docs, k=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least PASSAGE_WORDS words that a document with a smaller doc_id has go; n_chars follows the text."""
    return substring_dedup.without_repeats(docs, PASSAGE_WORDS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("substring dedup", substring_stage), ("best-fit packing", packing_stage)]

#: SQL has no such tokenizer or classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
