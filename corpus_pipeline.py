"""Corpus pipeline: quality rules, near-duplicate removal, repeated passages, benchmark leaks, token ids.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``:

1. ``quality_rules`` drops the documents that the base rules or the compression bands reject.
2. ``ngram_jaccard_join`` keeps the smallest id of each group of documents linked by
   five-word shingles of similarity 0.8 or more.
3. ``substring_dedup`` cuts words inside windows of 20 words that start earlier in the
   corpus; a document that keeps no word goes, and ``n_chars`` follows the text.
4. ``benchmark_decontamination`` drops documents that hold a window of a benchmark item.
5. ``byte_level_bpe`` gives each document's token count and digests of its ids and of the decoded bytes.

A null text or one without words fails stage 1, an empty table passes through every
stage as an empty table, columns of other names are carried along, and of rows with
equal ids stage 2 keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barsmith.llm.byte_bpe import byte_bpe
from barsmith.llm.decontaminate import clean_documents
from barsmith.llm.frames import stage
from barsmith.llm.jaccard_join import distinct_documents
from barsmith.llm.quality_rules import keep_documents
from barsmith.llm.substring_dedup import dedup_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: The compression bands have no SQL form; tests/llm checks the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
