"""Interval operators: coalescing, cross-talk, order statistics, activity spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.plans.blocks import (
    Ordered,
    lag,
    lead,
    next_seen,
    row_number,
    running_max,
    running_sum,
    total,
)

INGEST_TOLERANCE = 0.01
ALIGN_TOLERANCE = 0.04


def coalesce_intervals(
    iv: DataFrame, tolerance: float = INGEST_TOLERANCE, by: Sequence[str] = ("media_id",)
) -> DataFrame:
    """Merge intervals that start within ``tolerance`` of the running end."""
    by = list(by)
    # Equal starts always land in one island, so they shrink to one row before the shuffle.
    distinct = (
        iv.where(F.col("end") >= F.col("start")).groupBy(*by, "start").agg(F.max("end").alias("end"))
    )
    placed = Ordered.of(distinct, by, ["start"]).scan(
        __reach=running_max(F.col("end"), inclusive=False)
    )
    opens = F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + tolerance)
    placed = placed.with_df(placed.df.withColumn("__opens", F.when(opens, 1).otherwise(0)))
    return (
        placed.scan(__island=running_sum(F.col("__opens")))
        .rows.groupBy(*by, "__island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("__island")
    )


def mark_crosstalk(cues: DataFrame, id_col: str = "id", flag: str = "crosstalk") -> DataFrame:
    """Flag cues that overlap a cue of a different named speaker; touching is no overlap.

    In (start, end) order a cue overlaps an earlier one exactly when the furthest end
    among earlier cues of *other* speakers passes its start, and a later one exactly when
    the next cue of another speaker starts before its end. The first needs the two best
    ends of different speakers, which two chained running maxima give; no pairs are made.
    """
    named = cues.where(F.coalesce(F.col("speaker"), F.lit("")) != "")
    unnamed = cues.where(F.coalesce(F.col("speaker"), F.lit("")) == "")
    best = F.struct(F.col("end").alias("e"), F.col("speaker").alias("s"))
    placed = Ordered.of(named, ["media_id"], ["start", "end", id_col]).scan(
        __top=running_max(best),
        __before=running_max(best, inclusive=False),
        __prev_speaker=lag(F.col("speaker")),
    )
    new_top = F.col("__before.s").isNotNull() & (F.col("__top.s") != F.col("__before.s"))
    other_end = F.when(new_top, F.col("__before.e")).when(
        F.col("speaker") != F.col("__top.s"), F.col("end")
    )
    turn = F.when(
        F.col("__prev_speaker").isNull() | (F.col("__prev_speaker") != F.col("speaker")),
        F.col("start"),
    )
    placed = placed.scan(
        __second=running_max(other_end, inclusive=False),
        __next_other=next_seen(turn, inclusive=False),
    )
    earlier = F.when(F.col("__before.s") != F.col("speaker"), F.col("__before.e")).otherwise(
        F.col("__second")
    )
    hit = F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("__next_other") < F.col("end"), F.lit(False)
    )
    flagged = placed.rows.select(*cues.columns, hit.alias(flag))
    return flagged.unionByName(unnamed.withColumn(flag, F.lit(False)))


def crosstalk(cues: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of the cues :func:`mark_crosstalk` flags."""
    return mark_crosstalk(cues, id_col).where("crosstalk").select("media_id", id_col)


def ranked_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with how many rows lie below and in all, per group.

    Equal values shrink to one row first; the rest are ordered in blocks, so a group of
    any size is ranked in parallel.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return (
        Ordered.of(counts, by, [value])
        .scan(__upto=running_sum(F.col("__n")), __all=total(F.col("__n")))
        .rows.withColumn("__below", F.col("__upto") - F.col("__n"))
    )


def holds_rank(rank: Column) -> Column:
    """Whether the zero-based ``rank`` falls on this row of :func:`ranked_values`."""
    return (F.col("__below") <= rank) & (rank < F.col("__upto"))


def index_quantile(
    df: DataFrame, value: str, q: float, by: Sequence[str] = ("media_id",), name: str = "quantile"
) -> DataFrame:
    """``sorted[min(n-1, int(n*q))]`` per group: no interpolation."""
    rank = F.least(F.col("__all") - 1, F.floor(F.col("__all") * F.lit(q)))
    return (
        ranked_values(df, by, value)
        .where(holds_rank(rank))
        .select(*by, F.col(value).alias(name))
    )


def exact_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median (mean of the middle two) and count per group."""
    low = F.floor((F.col("__all") - 1) / 2)
    high = F.floor(F.col("__all") / 2)
    ranked = ranked_values(df, by, value)
    return (
        ranked.where(holds_rank(low) | holds_rank(high))
        .groupBy(*by)
        .agg(
            ((F.min(value) + F.max(value)) / 2).alias("median"),
            F.max("__all").alias("samples"),
        )
    )


def activity_intervals(
    levels: DataFrame,
    step: float = 0.02,
    floor_quantile: float = 0.15,
    floor_multiplier: float = 3.0,
    peak_multiplier: float = 0.035,
    min_level: float = 8.0,
    min_windows: int = 3,
) -> DataFrame:
    """Speech-like spans of a level envelope ``levels(media_id, win, rms)``."""
    floor = index_quantile(levels, "rms", floor_quantile, name="floor")
    peak = levels.groupBy("media_id").agg(F.max("rms").alias("peak")).where(F.col("peak") > 0)
    limits = peak.join(floor, "media_id").select(
        "media_id",
        F.greatest(
            F.col("floor") * floor_multiplier, F.col("peak") * peak_multiplier, F.lit(min_level)
        ).alias("threshold"),
    )
    active = levels.join(limits, "media_id").where(F.col("rms") >= F.col("threshold"))
    placed = Ordered.of(active.select("media_id", "win"), ["media_id"], ["win"]).scan(
        __rn=row_number()
    )
    runs = (
        placed.rows.groupBy("media_id", (F.col("win") - F.col("__rn")).alias("__run"))
        .agg(F.min("win").alias("first"), F.max("win").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_windows)
        .select(
            "media_id",
            (F.col("first") * F.lit(step)).alias("start"),
            ((F.col("last") + 1) * F.lit(step)).alias("end"),
        )
    )
    return coalesce_intervals(runs, ALIGN_TOLERANCE)


def speech_gaps(intervals: DataFrame) -> DataFrame:
    """Coalesced intervals with their neighbours' edges."""
    return (
        Ordered.of(intervals, ["media_id"], ["start", "end"])
        .scan(prev_right=lag(F.col("end")), next_left=lead(F.col("start")))
        .rows
    )
