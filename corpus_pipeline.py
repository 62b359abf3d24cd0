"""The corpus pipeline: raw documents in, token ids out.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is
written as Parquet and read again before the next stage, so a lost executor costs one stage's
files at most. A stage's table is deleted once the next one is written, so two are held at a time.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewarden.llm import decontaminate, mixing, near_dedup, quality_rules, token_ids
from tidewarden.llm.common import discard, read
from tidewarden.session import shared_dir


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.deduplicate(docs, near_dedup.Rule(5, 80, 100))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; copies are rows of their own."""
    return mixing.take(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shard files; returns what the files hold, one row per document taken."""
    return token_ids.encode_table(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mix_stage),
    ("token_ids", tokens_stage),
]

# Tokenising and similarity components are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
