"""From raw documents to token ids: five stages, each of which applies one operator.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes each stage's result as Parquet in the shared folder and reads it again, so
no stage repeats another's work and the loss of an executor costs the tasks of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.byte_bpe import tokenize_stage
from graphloom.llm.lang_id import language_stage
from graphloom.llm.line_dedup import line_stage
from graphloom.llm.mixing import mixing_stage
from graphloom.llm.near_dedup import near_stage
from graphloom.session import discard, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter have no language and go; a missing label becomes the language found."""
    return language_stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go, and with them documents of such lines only."""
    return line_stage(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return near_stage(docs, shingle=5, threshold=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them."""
    return mixing_stage(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a check that they decode to its text."""
    return tokenize_stage(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("mixing sources", mixing),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if done is not None:
            discard(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
