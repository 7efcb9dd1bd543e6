"""A training-data pipeline over ``documents``: language ID, near-duplicate join, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
documents.

* language_id drops documents whose language is undetermined or uncertain.
* ngram_join keeps, of each group of linked documents, the one with the smallest id.
* suffix_array_dedup removes byte strings of 100 bytes that also start earlier, updates
  n_chars, and drops documents of which nothing is left.
* packing returns the pieces of documents in full sequences.

Defined results: as the operators'; documents with null or empty text go in the first
stage; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysurvey.llm.common import discard, table, written
from skysurvey.llm.langid import keep_identified
from skysurvey.llm.ngram_join import keep_one_of_each
from skysurvey.llm.packing import pack_documents
from skysurvey.llm.suffix_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packing),
]

#: Packing needs a tokenizer and language ID a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
