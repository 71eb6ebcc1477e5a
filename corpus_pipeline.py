"""The corpus pipeline: a training-data build over ``documents`` in five stages.

language ID -> line dedup -> SimHash near-dedup -> mixing to target weights -> SentencePiece

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run``
writes each result as Parquet to the shared folder and reads it again. All stages but the last
return the columns of documents. docs must be written before a stage starts: the intermediates of
earlier stages are deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import op1_language, op2_simhash, op5_lines, op8_mixing, op10_sentencepiece
from quarry.llm.common import materialise, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence."""
    release(spark)
    return op1_language.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a similar earlier line go, and documents that lose all their words."""
    release(spark)
    return op5_lines.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    SimHash fingerprints within 3 bits give the first links, each checked on its shingles; an exact set join
    adds the pairs that 64-bit fingerprints cannot promise at 0.8."""
    release(spark)
    return op2_simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tempered source weights: every document at least once, those of small sources up to twice."""
    release(spark)
    return op8_mixing.mix(docs, op8_mixing.tempered)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ids, n_tokens, round_trip) of every document of the mix."""
    release(spark)
    return op10_sentencepiece.tokens(docs, op10_sentencepiece.load(), keep=("doc_id", "source", "lang"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("SentencePiece", tokenise),
]

#: Hashing, models and sampling are not expressible in SQL; tests/llm/test_pipeline.py holds each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{i}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
