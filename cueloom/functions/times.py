"""Time functions over columns: ASS times, flexible stamps, labels, estimates, caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASS_TIME = r"^\s*(\d+):(\d{1,2}):(\d{1,2})[.,](\d{1,3})\s*$"


def _pad(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def centiseconds(x: Column) -> Column:
    """Half-even rounding to centiseconds; negative times become zero."""
    return F.greatest(F.lit(0), F.rint(x * 100).cast("long"))


def ass_time(x: Column) -> Column:
    """``H:MM:SS.cc``."""
    c = centiseconds(x)
    return F.concat(
        F.floor(c / 360000).cast("string"), F.lit(":"), _pad(F.floor(c / 6000) % 60),
        F.lit(":"), _pad(F.floor(c / 100) % 60), F.lit("."), _pad(c % 100),
    )


def parse_ass_time(s: Column) -> Column:
    """Seconds of an ASS time in whole centiseconds, NULL when malformed."""
    part = [F.regexp_extract(s, ASS_TIME, i) for i in range(1, 5)]
    frac = part[3].cast("long")
    centis = (
        F.when(F.length(part[3]) == 1, frac * 10)
        .when(F.length(part[3]) == 3, F.rint(frac / 10).cast("long"))
        .otherwise(frac)
    )
    whole = (
        part[0].cast("long") * 360000 + part[1].cast("long") * 6000 + part[2].cast("long") * 100
    )
    return F.when(s.rlike(ASS_TIME), (whole + centis) / 100)


def parse_time(s: Column) -> Column:
    """``h:m:s`` with comma or point fraction, or plain seconds; NULL when malformed."""
    parts = F.split(F.replace(s, F.lit(","), F.lit(".")), ":")
    clock = (
        F.try_element_at(parts, F.lit(1)).try_cast("int") * 3600
        + F.try_element_at(parts, F.lit(2)).try_cast("int") * 60
        + F.try_element_at(parts, F.lit(3)).try_cast("double")
    )
    plain = s.try_cast("double")
    return F.when(F.size(parts) == 3, clock).otherwise(plain)


def json_time(raw: Column, integer_milliseconds: bool) -> Column:
    """Time of a raw JSON scalar: quoted stamp, or number (an integer may mean ms)."""
    text = F.regexp_extract(raw, r'^"(.*)"$', 1)
    number = raw.try_cast("double")
    if integer_milliseconds:
        number = F.when(raw.rlike(r"^-?\d+$"), number / 1000).otherwise(number)
    return F.when(raw.startswith('"'), parse_time(text)).otherwise(number)


def token_time(raw: Column) -> Column:
    """Like :func:`json_time` with integer milliseconds; non-finite values are NULL."""
    value = json_time(raw, True)
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def start_label(x: Column) -> Column:
    """``MM:SS.CC``; from one hour on ``H:MM:SS``."""
    c = centiseconds(x)
    hours, minutes, secs = F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60
    long = F.concat(
        hours.cast("string"), F.lit(":"), _pad(minutes), F.lit(":"), _pad(secs)
    )
    short = F.concat(_pad(minutes), F.lit(":"), _pad(secs), F.lit("."), _pad(c % 100))
    return F.when(hours > 0, long).otherwise(short)


def duration(frames: Column, rate: Column) -> Column:
    """Playable seconds, NULL when the rate or the result is not positive."""
    return F.when((rate > 0) & (frames > 0), frames / rate)


def estimate_seconds(seconds: Column, size_bytes: Column) -> Column:
    """Wall-clock estimate of one whole-file request."""
    # Default length, segment length, most segments, speed, upload rate.
    d = F.when(F.coalesce(seconds, F.lit(0.0)) == 0, F.lit(600.0)).otherwise(seconds)
    segments = F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(d / 480.0)))
    upload = F.greatest(F.lit(0), size_bytes) / 2000000.0
    return F.greatest(F.lit(15.0), F.lit(2.0) + upload + d / (F.lit(25.0) * segments))


def chunk_seconds_cap(
    max_minutes: Column, diarize: Column, over_limit: Column, diarize_minutes: Column
) -> Column:
    """Longest request in seconds; diarized requests may be split shorter."""
    cap = max_minutes * 60
    split = diarize & (over_limit == "split")
    return F.when(split, F.least(cap, diarize_minutes * 60)).otherwise(cap)


def chunk_params_problem(
    max_minutes: Column, overlap_seconds: Column, diarize_minutes: Column, over_limit: Column
) -> Column:
    """Why a set of request parameters is unusable, or NULL."""

    def finite(x):
        return ~F.isnan(x) & (F.abs(x) != float("inf"))

    return (
        F.when(
            ~F.coalesce(finite(max_minutes) & (max_minutes > 0), F.lit(False)),
            F.lit("max-minutes must be a finite positive number"),
        )
        .when(
            ~F.coalesce(finite(overlap_seconds) & (overlap_seconds >= 0), F.lit(False)),
            F.lit("chunk-overlap-seconds must be a finite non-negative number"),
        )
        .when(
            ~F.coalesce(diarize_minutes >= 0, F.lit(False)),
            F.lit("diarize-max-minutes must be a non-negative integer"),
        )
        .when(
            ~F.coalesce(over_limit.isin("disable", "split"), F.lit(False)),
            F.lit("diarize-over-limit must be disable or split"),
        )
    )


def effective_diarization(
    saved_backend: Column,
    saved_enabled: Column,
    backend: Column,
    minutes: Column,
    over_limit: Column,
    seconds: Column,
) -> Column:
    """Struct(enabled, problem): a stored decision wins, else the policy decides."""
    stored = saved_backend.isNotNull()
    split = over_limit == "split"
    problem = (
        F.when(
            stored & (saved_backend != backend),
            F.lit("stored diarization belongs to a different transcription backend"),
        )
        .when(
            stored & split & ~saved_enabled & (minutes > 0),
            F.lit("saved whole-file diarization decision cannot be changed to split"),
        )
        .when(
            ~stored & seconds.isNull(),
            F.lit("cannot measure complete recording duration for diarization"),
        )
    )
    fresh = (minutes > 0) & (split | (seconds < minutes * 60))
    enabled = F.when(stored, (minutes != 0) & saved_enabled).otherwise(fresh)
    return F.struct(
        F.when(problem.isNull(), enabled).alias("enabled"), problem.alias("problem")
    )
