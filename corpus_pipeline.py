"""A training corpus from raw documents: language, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet
and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatelens.llm import decontam, jaccard, langid, linededup, packing
from gatelens.llm.common import scratch_dir, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; profiles are learned from the input's labelled four fifths."""
    small_batches(spark)
    filters = langid.learn(docs.where(~langid.held_out("doc_id", 5, 0)))
    return langid.keep_languages(docs, filters)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("repeated_lines", repeated_lines), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("packed", packed)]

#: Neither n-gram filters nor token ids can be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
