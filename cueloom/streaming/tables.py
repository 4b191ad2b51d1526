"""Tables that micro-batches and batch jobs write and anyone may read, in whole versions.

A table is a folder of Parquet files, partitioned by its *cells* (a recording, a stretch of
one), and a log. A write first lands under its own name and becomes visible by one file
added to the log, which names the cells it touches; what a lost attempt left behind is never
read. A batch that is run again after a failure finds its number in the log and does
nothing. Readers pick the newest version of each cell from the log, so they see a write
whole or not at all. Reading and rewriting some cells opens only their partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cueloom.operators.intervals import coalesce_intervals
from cueloom.session import materialize

LOG = "writer string, number long, attempt string, kind string, rank int"


class CellTable:
    """A table of ``schema`` partitioned by the columns ``cells``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, cells: list[str]):
        self.spark, self.path, self.cells = spark, path, cells
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.fieldNames()
        named = StructType([f for f in self.schema.fields if f.name in cells])
        self.log_schema = StructType([*StructType.fromDDL(LOG).fields, *named.fields])
        self.data_schema = StructType([*self.schema.fields, *StructType.fromDDL("writer string, attempt string").fields])
        spark.createDataFrame([], self.log_schema).write.mode("ignore").parquet(f"{path}/log")
        spark.createDataFrame([], self.data_schema).write.mode("ignore").partitionBy(*cells, "writer", "attempt").parquet(f"{path}/data")

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.log_schema).parquet(f"{self.path}/log")

    def _visible(self) -> DataFrame:
        """Log entries in force: of the highest rank in a cell, from its last replacement on."""
        ranked = self.log().withColumn("__top", F.max("rank").over(Window.partitionBy(*self.cells))).where(F.col("rank") == F.col("__top"))
        replaced = F.max(F.when(F.col("kind") == "replace", F.col("number"))).over(Window.partitionBy(*self.cells))
        return ranked.withColumn("__from", replaced).where(F.col("__from").isNull() | (F.col("number") >= F.col("__from")))

    def read(self, touched: DataFrame | None = None) -> DataFrame:
        """The visible rows, of all cells or of those in ``touched`` (the cells of a micro-batch)."""
        rows = self.spark.read.schema(self.data_schema).parquet(f"{self.path}/data")
        if touched is not None:
            # As many values as the micro-batch has: they prune the partitions to be opened.
            for c in self.cells:
                rows = rows.where(F.col(c).isin([r[0] for r in touched.select(c).distinct().collect()]))
        entries = self._visible().select(*self.cells, "writer", "attempt")
        return rows.join(entries, [*self.cells, "writer", "attempt"], "left_semi").select(*self.columns)

    def done(self, writer: str, number: int) -> bool:
        return not self.log().where((F.col("writer") == writer) & (F.col("number") == number)).isEmpty()

    def _commit(self, rows: DataFrame, cells: DataFrame, writer: str, number: int, kind: str, rank: int) -> None:
        attempt = uuid.uuid4().hex
        (
            rows.select(*self.columns, F.lit(writer).alias("writer"), F.lit(attempt).alias("attempt"))
            .write.mode("append").partitionBy(*self.cells, "writer", "attempt").parquet(f"{self.path}/data")
        )
        entry = cells.select(*self.cells).distinct().withColumns({
            "writer": F.lit(writer), "number": F.lit(number).cast("long"), "attempt": F.lit(attempt),
            "kind": F.lit(kind), "rank": F.lit(rank),
        })
        # One file: it is there whole or not at all.
        entry.select(*self.log_schema.fieldNames()).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def append_once(self, batch: DataFrame, number: int, keys: list[str], writer: str = "stream", rank: int = 0) -> None:
        """Add the rows whose keys the table does not hold yet; ``keys`` includes the cells.

        Of rows of one batch with the same keys one is added.
        """
        if self.done(writer, number):
            return
        batch = materialize(batch.dropDuplicates(keys))
        held = self.read(batch).select(*keys)
        fresh = materialize(batch.join(held, keys, "left_anti"))
        self._commit(fresh, batch, writer, number, "append", rank)

    def replace(
        self, batch: DataFrame, number: int, rewrite: Callable[[DataFrame, DataFrame], DataFrame],
        writer: str = "stream", rank: int = 0,
    ) -> None:
        """New content of the cells ``batch`` touches: ``rewrite(their present rows, batch)``.

        Other cells are neither read nor written. The new rows lie in the touched cells.
        """
        if self.done(writer, number):
            return
        batch = materialize(batch)
        # One file per cell: cells are to be chosen so that each fits a task.
        rows = materialize(rewrite(self.read(batch), batch).repartition(*self.cells))
        self._commit(rows, batch, writer, number, "replace", rank)


def drain_into(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every available micro-batch and its number to ``take``."""
    (
        stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


# --- late and out-of-order speech spans ---

PIECES = "media_id long, cell long, start double, end double"
CELL_SECONDS = 3600.0


def cut_at_cells(spans: DataFrame, seconds: float = CELL_SECONDS) -> DataFrame:
    """Spans cut where a cell ends; the pieces touch, so coalescing them gives the span again."""
    first, last = F.floor(F.col("start") / seconds), F.floor(F.col("end") / seconds)
    return (
        spans.where(F.col("end") >= F.col("start"))
        .select("media_id", "start", "end", F.explode(F.sequence(first, last)).alias("cell"))
        .select(
            "media_id", F.col("cell").cast("long").alias("cell"), F.greatest("start", F.col("cell") * F.lit(seconds)).alias("start"),
            F.least("end", (F.col("cell") + 1) * F.lit(seconds)).alias("end"),
        )
    )


def remerge_touched(table: CellTable, tolerance: float, seconds: float = CELL_SECONDS) -> Callable[[DataFrame, int], None]:
    """Merge a micro-batch of spans (media_id, start, end) into ``table`` (``PIECES``).

    Only the cells the spans lie in are read, merged and written anew. Merging merged spans
    changes nothing, so the order of arrival does not matter.
    """

    def merge(present: DataFrame, batch: DataFrame) -> DataFrame:
        return coalesce_intervals(present.unionByName(batch), tolerance, ("media_id", "cell"))

    def take(batch: DataFrame, number: int) -> None:
        table.replace(cut_at_cells(batch, seconds), number, merge)

    return take


def merged_spans(table: CellTable, tolerance: float) -> DataFrame:
    """All spans of the table, joined again where cells part them."""
    return coalesce_intervals(table.read().select("media_id", "start", "end"), tolerance)


# --- live results and the final pass ---


def settle_recordings(table: CellTable, final: DataFrame, number: int, decide: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Put the final pass in place of the live rows of its recordings.

    ``table`` has the cells ``media_id`` and a column ``provisional``. ``decide(live, final)``
    gives the rows that stay. They rank above whatever the stream still adds to these
    recordings, so a reader sees the live rows or the final ones, never both or neither.
    """

    def rewrite(live: DataFrame, batch: DataFrame) -> DataFrame:
        return decide(live.where("provisional"), batch).withColumn("provisional", F.lit(False))

    table.replace(final, number, rewrite, writer="final", rank=1)

