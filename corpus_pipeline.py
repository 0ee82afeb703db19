"""A training corpus from `documents`: toxicity, near-duplicates, repeated strings, benchmark leaks, packing.

All stages but the last return the columns of documents; each works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm import decontaminate, neardup, packing, queries, suffixes, toxicity
from blockweave.llm.common import dropped, table, without, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar predicts as toxic go."""
    return toxicity.clean(docs, queries.toxicity_grammar(spark, sf_dir))


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: five words, similarity 0.8."""
    found = neardup.near_duplicates(docs, k=5, percent=80)
    # A doc_id of different texts stays if one of them does.
    gone = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return without(docs, written(gone, "dropped"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus are cut out."""
    return suffixes.cut_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, tokenised and packed into sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("minhash_neardup", minhash_neardup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Tokenising and the learned grammar are not SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, before = written(stage(spark, docs, sf_dir), f"stage-{name}"), made
        if before is not None:
            dropped(before)
        made = docs
    return docs
