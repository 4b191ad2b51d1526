"""Intermediate tables in the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cueloom.session import scratch_dir


def stored(df: DataFrame) -> DataFrame:
    """Write once, read back: cuts the lineage, survives lost executors, prunes columns."""
    spark = df.sparkSession
    path = scratch_dir(spark, "llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query has shuffled leaves the disks when it ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    chosen = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, chosen)
