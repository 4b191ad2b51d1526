"""Running streams over stored tables: replay in arrival order, and drain to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.session import materialize, scratch_dir
from cueloom.streaming.state import ROCKSDB


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files below ``path``."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, state_rows: list[int] | None = None) -> DataFrame:
    """Run a stream over everything available; returns all it has appended to ``out``.

    ``state_rows`` receives the rows held in state after each micro-batch. States with
    several variables and timers need the RocksDB store: the session's choice is put back
    after the start.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    chosen = conf.get(name)
    conf.set(name, ROCKSDB)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        conf.set(name, chosen)
    if state_rows is not None:
        state_rows += [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress]
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def replay(
    rows: DataFrame, part: Column, parts: int, consume: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Let ``rows`` arrive in ``parts`` steps, numbered from 0 by ``part``.

    ``consume`` takes the stream of arrived rows and returns what it has produced so far.
    The query stops and starts again from its checkpoint between steps, as after a failure.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, "arrivals")
    kept = materialize(rows.withColumn("__part", part))
    result = None
    for i in range(parts):
        step = kept.where(F.col("__part") == i).drop("__part")
        step.write.mode("append").parquet(f"{path}/step={i}")
        result = consume(arrivals(spark, path, rows.schema))
    return result


def replay_through(rows: DataFrame, part: Column, parts: int, operator) -> DataFrame:
    """What the streaming ``operator`` appends for ``rows`` arriving in steps."""
    out, state = scratch_dir(rows.sparkSession, "out"), scratch_dir(rows.sparkSession, "state")
    return replay(rows, part, parts, lambda stream: drain(operator(stream), out, state))
