"""From raw documents to a training mixture: five stages, each a parquet table.

A stage takes (spark, docs, sf_dir) and returns documents; all but the last keep the
columns of ``documents``. Its result is written to the shared folder and read back, so a
lost executor costs at most part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm import op1_resample, op4_forest, op5_surrogates, op6_containment, op8_mixture
from cueloom.llm.store import stored

#: SQL cannot express the quality draw, the forest or the surrogates.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance; the others go."""
    return op1_resample.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents."""
    return op4_forest.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op6_containment.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data."""
    return op5_surrogates.with_surrogates(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mixture takes words from, with ``taken`` and their source's target."""
    return op8_mixture.mix(docs).where("taken > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("private", private),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
