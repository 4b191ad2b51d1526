"""Live operators that follow the clock: windows under a watermark, and commits by timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from cueloom.streaming.operators import CHUNK_SECONDS, CONTEXT_SECONDS, FLUSH_SECONDS
from cueloom.streaming.state import ordered_rows

FLUSHED = "media_id long, commit_at double, cause string, at_ms long"
_FLUSHED = [c.split()[0] for c in FLUSHED.split(", ")]


def windowed_chunks(
    decoded: DataFrame, chunk: float = CHUNK_SECONDS, context: float = CONTEXT_SECONDS, delay: int = 60
) -> DataFrame:
    """Chunks with context of all recordings, each when the watermark has passed its end.

    ``decoded``: media_id, begin, end (the seconds of the recording this row decodes) and
    began (when the recording began). Time counts from the last multiple of ``chunk`` before
    ``began``, so that the sliding windows of all recordings lie alike; ``chunk`` and
    ``context`` are whole seconds. A row counts in every chunk it reaches into. The remainder
    of a recording comes with its last window, when the clocks of the others have moved on;
    rows without a media_id are ticks of the clock and do nothing else. Rows more than
    ``delay`` seconds behind the clock are dropped.
    """
    step, reach = int(chunk), int(chunk + context)
    zero = F.floor(F.unix_micros("began") / (step * 1_000_000)) * step
    first = F.floor(F.col("begin") / step) + 1
    # One point per chunk the row reaches into: the ends of chunks inside it, and its own end.
    points = F.transform(
        F.sequence(first, F.greatest(first, F.ceil(F.col("end") / step))),
        lambda n: F.least(n * F.lit(float(step)), F.col("end")),
    )
    spread = decoded.withColumns({"zero": zero, "point": F.explode(F.array_distinct(points))}).withColumn(
        # A point belongs to the chunk it ends, hence just before its time.
        "at", F.timestamp_micros(((F.col("zero") + F.col("point")) * 1_000_000).cast("long") - 1)
    )
    windows = F.window("at", f"{reach} seconds", f"{step} seconds", f"{step - int(context)} seconds")
    full = (
        spread.withWatermark("at", f"{delay} seconds").groupBy("media_id", "zero", windows.alias("w"))
        .agg(F.max(F.when(F.col("media_id").isNotNull(), F.col("point"))).alias("reached"))
    )
    n = F.floor((F.unix_micros("w.start") / 1_000_000 + int(context) - F.col("zero")) / step).cast("long")
    return (
        full.withColumn("n", n).where(F.col("reached") > F.col("n") * step)
        .select(
            "media_id", "n", F.greatest(F.lit(0.0), F.col("n") * F.lit(chunk) - context).alias("start"),
            F.least("reached", (F.col("n") + 1) * F.lit(chunk)).alias("end"),
        )
    )


class _Flushing(StatefulProcessor):
    def __init__(self, clock: str, after: float):
        self.clock, self.after = clock, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "floor double, sent double, due long")

    def _committed(self, key, at: float, cause: str, when: int) -> dict:
        return {"media_id": key[0], "commit_at": at, "cause": cause, "at_ms": when}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wait, known = int(self.after * 1000), self.state.get()
        floor, sent, due = known if known is not None else (None, 0.0, 0)
        before, out = due, []
        for row in ordered_rows(rows, ["seq"]):
            now = row[self.clock].value // 1_000_000
            if floor is None:
                floor = sent = row["start"]
            if due and due <= now:
                # The timer's time came first, whichever micro-batch brings the row.
                out.append(self._committed(key, sent, "timer", due))
                floor, due = sent, 0
            if row["kind"] == "durable":
                floor = max(floor, row["end"])
                due = now + wait if sent > floor else 0
                continue
            sent = max(sent, row["end"])
            if sent - floor >= self.after:
                out.append(self._committed(key, sent, "sent", now))
                floor, due = sent, 0
            elif sent > floor and not due:
                due = now + wait
        self.state.update((floor, sent, due))
        if due != before:
            if before:
                self.handle.deleteTimer(before)
            if due:
                self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame(out, columns=_FLUSHED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        floor, sent, due = self.state.get()
        self.state.update((sent, sent, 0))
        yield pd.DataFrame([self._committed(key, sent, "timer", due)], columns=_FLUSHED)

    def close(self) -> None:
        pass


def flush_by_timer(feed: DataFrame, clock: str, after: float = FLUSH_SECONDS) -> DataFrame:
    """Commit points of a feed: when ``after`` seconds of audio are uncommitted, or when sent
    audio has waited ``after`` seconds by the clock, rows or no rows.

    ``feed``: media_id, seq, kind (sent or durable), start, end and the ``clock`` column, on
    which the stream has a watermark. Counting starts at the first row's ``start``. State is
    one small value a recording.
    """
    return feed.groupBy("media_id").transformWithStateInPandas(
        statefulProcessor=_Flushing(clock, after), outputStructType=StructType.fromDDL(FLUSHED),
        outputMode="Append", timeMode="EventTime",
    )
