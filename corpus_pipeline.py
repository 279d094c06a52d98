"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, secret scans, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first three drop documents (rejected ones,
all but one of each near-duplicate component, contaminated ones), the fourth puts a mark in place of secrets, the last
returns the documents taken to meet the target weights with copies, the times each is taken.

Cases: null, empty and blank texts are rejected by the first stage; very long texts are worked on whole by every stage; of repeated rows one
stays, and of a component the document of the least doc_id, then of the least hashes of the text; rows with a null doc_id stay only if
their whole component has none; empty tables give empty tables; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontamination, mixing, quality_rules, secret_scan, simhash_near_dups
from rasterloom.llm.common import clear_stored, mark, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_near_dups.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("secret_scan", secrets), ("mixing", mix)]
#: Fingerprints and learned rules aren't SQL; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begin = mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
        clear_stored(spark, begin, keep=docs)  # what the stage itself stored, and the one before it
    return STAGES[-1][1](spark, docs, sf_dir)
