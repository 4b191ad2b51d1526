"""Signal samples: loudness windows and frame-exact slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS = 0.02


def rms_levels(samples: DataFrame, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """(media_id, win, rms) of ``samples(media_id, i, sample, rate)``; a short tail counts."""
    window = F.greatest(F.lit(1), F.floor(F.col("rate") * F.lit(window_seconds)))
    x = F.col("sample").cast("double")
    return samples.groupBy("media_id", F.floor(F.col("i") / window).alias("win")).agg(
        F.sqrt(F.sum(x * x) / F.count(F.lit(1))).alias("rms")
    )


def slice_signal(samples: DataFrame, start: float, end: float) -> DataFrame:
    """Samples of [start, end) by half-even rounded frame."""
    first = F.greatest(F.lit(0.0), F.rint(F.lit(start) * F.col("rate")))
    last = F.rint(F.lit(end) * F.col("rate"))
    return samples.where((F.col("i") >= first) & (F.col("i") < last))
