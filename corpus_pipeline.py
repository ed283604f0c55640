"""Corpus preparation: language ID, near-dedup, decontamination, secret redaction, mixing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  Every stage's result is
written as Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.decontaminate import drop_leaks
from docloom.llm.langid import keep_identified, learn, limits
from docloom.llm.minhash import drop_near_duplicates
from docloom.llm.mixing import mix
from docloom.llm.secrets import redact_secrets
from docloom.llm.shared import Stages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best language is at least as near as labelled texts of their length are to their own; profiles and
    limits are learnt from the stage's own labelled input."""
    prototypes = learn(docs)
    return keep_identified(docs, prototypes, limits(docs, prototypes))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced in their texts."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: what the mix takes of every document."""
    return mix(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("mixing", mixing)]

#: Language profiles, similarity and alignment have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        docs = stages.write(stage(spark, docs, sf_dir))
        if k:
            stages.drop(before)
    return docs
