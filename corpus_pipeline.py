"""Corpus pipeline: documents through five of the training-data operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graincart.llm import pipeline
from graincart.llm.common import durable

STAGES = [
    ("language_id", pipeline.language_id),
    ("toxicity", pipeline.toxicity),
    ("simhash_near_dedup", pipeline.simhash_near_dedup),
    ("benchmark_decontamination", pipeline.benchmark_decontamination),
    ("best_fit_packing", pipeline.best_fit_packing),
]

#: The stages learn models and iterate, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
