"""Corpus pipeline: language ID, exact dedup, near dedup, mixing and tokenising, each stage written and reread."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pactum.llm import pipeline_stages as P
from pactum.plans.session import delete_path, scratch, shared_folder

STAGES = [
    ("language_id", P.language_id),
    ("exact_dedup", P.exact_dedup),
    ("near_dedup", P.near_dedup),
    ("source_mixing", P.source_mixing),
    ("tokenize", P.tokenize),
]

#: The stages that parse, sample or tokenise are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves in the shared folder goes once its output is written, and its output
    once the next stage's is; the last output stays, as the result is read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            delete_path(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
