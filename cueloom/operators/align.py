"""Aligning cue boundaries to speech intervals, and choosing among aligned attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import is_special_token, strip
from cueloom.functions.times import token_time
from cueloom.operators.intervals import (
    ALIGN_TOLERANCE,
    coalesce_intervals,
    mark_crosstalk,
    speech_gaps,
)
from cueloom.plans.asof import Probe, asof
from cueloom.plans.blocks import Ordered, lag, lead, row_number, running_sum

# Fixed values of the alignment rules.
TOL = ALIGN_TOLERANCE
LOOKAHEAD = 2.0
MOVED = 0.02
OVERLAP = 0.1
COMPRESSED_SILENCE = 0.1
LONG_SILENCE_ONE_CHAR = 0.0
LONG_SILENCE = 0.32
MIN_REMAINING = 0.8
END_RADIUS = 1.0
EPS = 1e-9
TRIM_SILENCE = 6.0
TRIM_PRE_ROLL = 3.0


def leading_tokens(tokens: Column) -> Column:
    """Struct(text, r1, r2) of an array of (text, raw times) tokens.

    Each token has ``text`` and the raw JSON scalars ``offset_from/to``,
    ``stamp_from/to``; special tokens are skipped and the ranges stop at the first token
    without a usable range.
    """

    def time_range(t):
        def pair(a, b):
            lo_hi = F.struct(token_time(t[a]).alias("start"), token_time(t[b]).alias("end"))
            return let(lo_hi, lambda x: F.when(x["end"] >= x["start"], x))

        return F.coalesce(pair("offset_from", "offset_to"), pair("stamp_from", "stamp_to"))

    real = F.filter(
        tokens, lambda t: t["text"].isNotNull() & (t["text"] != "") & ~is_special_token(t["text"])
    )
    two = F.transform(
        F.slice(real, 1, 2), lambda t: F.struct(t["text"].alias("text"), time_range(t).alias("r"))
    )

    def shape(x):
        first, second = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        return F.struct(
            first["text"].alias("text"), first["r"].alias("r1"),
            F.when(first["r"].isNotNull(), second["r"]).alias("r2"),
        )

    return let(two, shape)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_by(a: str, b: str) -> Column:
    """The later of two intervals that each open a suffix."""
    return F.when(F.col(f"{a}.left") >= F.col(f"{b}.left"), F.col(a)).otherwise(F.col(b))


def compressed_timeline(intervals: DataFrame) -> DataFrame:
    """Each interval's place on the timeline with silences shortened to a fixed gap."""
    placed = Ordered.of(intervals, ["media_id"], ["start", "end"]).scan(
        prev_right=lag(F.col("end")),
        next_left=lead(F.col("start")),
        __speech=running_sum(F.col("end") - F.col("start") + OVERLAP),
        __n=row_number(),
    )
    silence = F.col("__speech") + (F.col("__n") - 1) * COMPRESSED_SILENCE
    return placed.rows.select(
        "media_id", F.col("start").alias("left"), F.col("end").alias("right"), "prev_right",
        "next_left", silence.alias("silence_start"),
        (silence - (F.col("end") - F.col("start") + OVERLAP)).alias("processed_start"),
        (silence + COMPRESSED_SILENCE).alias("silence_end"),
    )


def _with_previous_end(cues: DataFrame) -> DataFrame:
    return (
        Ordered.of(cues, ["media_id"], ["ordinal", "id"])
        .scan(__prev_end=lag(F.col("end")))
        .rows
    )


def long_silence_starts(
    cues: DataFrame, timeline: DataFrame, activity: DataFrame | None = None
) -> DataFrame:
    """(media_id, id, silence_start_at): the start a leading token points past a silence.

    ``cues`` has ``lead`` from :func:`leading_tokens` and ``__prev_end``; ``timeline`` comes
    from :func:`compressed_timeline`. Silences are ordered both on the compressed and the
    real timeline, so each condition cuts a prefix or a suffix of them and the last
    candidate is found by lookups. The variant for a token just before a silence needs the
    signal to be quiet there.
    """
    rows = cues.where(F.col("lead.r1").isNotNull() & F.col("lead.text").isNotNull())
    one_char = F.char_length(strip(F.col("lead.text"))) == 1
    threshold = F.when(one_char, LONG_SILENCE_ONE_CHAR).otherwise(LONG_SILENCE)
    rows = rows.select(
        "media_id", "id", "end", "lead", F.col("__prev_end"),
        threshold.alias("__thr"), one_char.alias("__one"),
    )
    gaps = timeline.where("next_left is not null").withColumn(
        "gap", F.col("next_left") - F.col("right")
    )
    wide = F.col("gap") + EPS >= LONG_SILENCE
    value = F.struct(
        "left", "right", "next_left", "gap", "silence_start", "silence_end", "processed_start"
    )
    te = F.col("lead.r1.end")
    found = asof(
        rows, gaps, ["media_id"], ["id"], value,
        {
            "near": Probe(te - EPS, F.col("silence_start"), "first_ge"),
            "any_token": Probe(te + EPS, F.col("silence_end"), "last_le"),
            "any_end": Probe(F.col("end"), F.col("next_left"), "last_le"),
            "wide_token": Probe(te + EPS, F.col("silence_end"), "last_le", wide),
            "wide_end": Probe(F.col("end"), F.col("next_left"), "last_le", wide),
        },
    )

    def earlier(a, b):
        return F.when(
            F.col(f"{a}.silence_start") <= F.col(f"{b}.silence_start"), F.col(a)
        ).otherwise(F.when(F.col(a).isNotNull(), F.col(b)))

    cross = F.when(F.col("__one"), earlier("any_token", "any_end")).otherwise(
        earlier("wide_token", "wide_end")
    )
    found = found.withColumn("cross", cross)
    prev = F.coalesce(F.col("__prev_end") + TOL, F.lit(float("-inf")))
    crosses = (
        F.col("cross").isNotNull()
        & (F.col("lead.r1.start") <= F.col("cross.silence_start") + EPS)
        & (F.col("cross.next_left") >= prev)
        & (F.col("cross.next_left") <= F.col("end"))
    )
    near = (
        F.col("near").isNotNull()
        & F.col("lead.r2").isNotNull()
        & (F.col("near.gap") + EPS >= F.col("__thr"))
        & (F.col("near.next_left") >= prev)
        & (F.col("near.next_left") <= F.col("end"))
        & (F.col("near.silence_start") - te <= COMPRESSED_SILENCE + EPS)
        & (F.col("lead.r2.start") <= F.col("near.silence_start") + EPS)
        & (F.col("lead.r2.end") + EPS >= F.col("near.silence_end"))
        & (F.col("lead.r1.start") >= F.col("near.processed_start") - EPS)
    )
    found = found.select(
        "media_id", "id",
        F.when(crosses, F.col("cross.next_left")).alias("__cross"),
        F.when(near, F.col("near.next_left")).alias("__near"),
        (F.col("near.left") + F.col("lead.r1.start") - F.col("near.processed_start")).alias("__ts"),
        (F.col("near.left") + te - F.col("near.processed_start")).alias("__te"),
    )
    if activity is None:
        confirmed = found.withColumn("__quiet", F.lit(False))
    else:
        measured = activity.select("media_id").distinct().withColumn("__has", F.lit(True))
        confirmed = asof(
            found, activity, ["media_id"], ["id"], F.struct(F.col("end").alias("right")),
            {"heard": Probe(F.col("__te") + TOL, F.col("start"), "last_le")},
        ).join(measured, "media_id", "left")
        confirmed = confirmed.withColumn(
            "__quiet",
            F.col("__has").isNotNull()
            & ~F.coalesce(F.col("heard.right") >= F.col("__ts") - TOL, F.lit(False)),
        )
    return confirmed.select(
        "media_id", "id",
        F.when(F.col("__near").isNotNull() & F.col("__quiet"), F.col("__near"))
        .otherwise(F.col("__cross"))
        .alias("silence_start_at"),
    ).where("silence_start_at is not null")


def align_starts(
    cues: DataFrame, vad: DataFrame, activity: DataFrame | None = None
) -> DataFrame:
    """Move cue starts to speech and grade them.

    ``cues``: media_id, id, ordinal, start, end, speaker, timing_confidence and, for token
    evidence, ``lead``. Speech comes from ``vad``, or from ``activity`` for recordings
    without any. Adds low_confidence and align_backend. Cross-talk cues stay as they are.
    """
    merged = coalesce_intervals(vad, TOL).withColumn("backend", F.lit("whisper-vad"))
    if activity is not None:
        fallback = activity.join(
            merged.select("media_id").distinct(), "media_id", "left_anti"
        ).withColumn("backend", F.lit("pcm-vad"))
        merged = merged.unionByName(fallback.select("media_id", "start", "end", "backend"))
    backends = merged.select("media_id", F.col("backend").alias("__backend")).distinct()
    timeline = compressed_timeline(merged.select("media_id", "start", "end"))
    rows = _with_previous_end(mark_crosstalk(cues))
    found = asof(
        rows, timeline, ["media_id"], ["id"], F.struct("left", "right"),
        {
            "cover": Probe(F.col("start") + TOL, F.col("left"), "last_le"),
            "alive": Probe(F.col("start") - TOL, F.col("right"), "first_ge"),
            "clear": Probe(F.col("__prev_end") + TOL, F.col("left"), "first_ge"),
        },
    ).join(backends, "media_id", "left")
    if "lead" in cues.columns:
        from_vad = rows.where(~F.col("crosstalk")).join(
            backends.where("__backend = 'whisper-vad'").select("media_id"), "media_id", "left_semi"
        )
        tokens = long_silence_starts(from_vad, timeline, activity)
        found = found.join(tokens, ["media_id", "id"], "left")
    else:
        found = found.withColumn("silence_start_at", F.lit(None).cast("double"))
    enough = F.col("cover.right") - F.col("start") > MIN_REMAINING
    pick = F.when(F.col("__prev_end").isNull(), F.col("alive")).when(
        F.col("alive").isNotNull() & F.col("clear").isNotNull(), _first_by("alive", "clear")
    )
    found = found.withColumn("__pick", pick)
    near = F.col("__pick.left") <= F.least(F.col("end"), F.col("start") + LOOKAHEAD)
    start = (
        F.when(F.col("silence_start_at").isNotNull(), F.col("silence_start_at"))
        .when(enough, F.col("start"))
        .when(near, F.greatest(F.col("start"), F.col("__pick.left")))
    )
    untouched = F.col("crosstalk") | F.col("__backend").isNull()
    confidence = (
        F.when(start.isNull(), 0.35)
        .when(start > F.col("start") + MOVED, 0.9)
        .otherwise(0.75)
    )
    moved = F.least(F.greatest(F.col("start"), F.coalesce(start, F.col("start"))), F.col("end"))
    out = [
        F.when(untouched, F.col("start")).otherwise(moved).alias("start") if c == "start"
        else F.when(untouched, F.col("timing_confidence")).otherwise(confidence).alias(c)
        if c == "timing_confidence"
        else F.col(c)
        for c in cues.columns
    ]
    return found.select(
        *out,
        F.when(F.col("__backend").isNull(), True)
        .when(F.col("crosstalk"), False)
        .otherwise(start.isNull())
        .alias("low_confidence"),
        F.coalesce("__backend", F.lit("whisper-vad-unaligned")).alias("align_backend"),
    )


def refine_ends(cues: DataFrame, intervals: DataFrame, frozen: str | None = None) -> DataFrame:
    """Move ends to the nearest speech end between the cue's start and the next start."""
    rows = (
        Ordered.of(cues, ["media_id"], ["ordinal", "id"]).scan(__next=lead(F.col("start"))).rows
    )
    spans = intervals.select("media_id", F.col("start").alias("left"), F.col("end").alias("right"))
    found = asof(
        rows, spans, ["media_id"], ["id"], F.struct("left", "right"),
        {
            "below": Probe(F.least(F.col("end"), F.col("__next")), F.col("right"), "last_le"),
            "above": Probe(F.col("end"), F.col("right"), "first_gt"),
        },
    )
    reach = END_RADIUS + EPS
    low = F.when(
        (F.col("end") - F.col("below.right") <= reach) & (F.col("below.right") >= F.col("start")),
        F.col("below.right"),
    )
    high = F.when(
        (F.col("above.right") - F.col("end") <= reach)
        & (F.col("above.left") <= F.col("end") + TOL)
        & (F.col("above.right") >= F.col("start"))
        & (F.col("__next").isNull() | (F.col("above.right") <= F.col("__next"))),
        F.col("above.right"),
    )
    nearest = (
        F.when(low.isNull(), high)
        .when(high.isNull(), low)
        .when(high - F.col("end") <= F.col("end") - low, high)
        .otherwise(low)
    )
    end = F.greatest(F.col("start"), F.coalesce(nearest, F.col("end")))
    if frozen:
        end = F.when(F.col(frozen), F.col("end")).otherwise(end)
    return found.select(*[end.alias("end") if c == "end" else F.col(c) for c in cues.columns])


def align_to_speech(
    cues: DataFrame, vad: DataFrame, activity: DataFrame | None = None
) -> DataFrame:
    """Starts, then ends, in one pass over the timeline."""
    started = align_starts(cues, vad, activity)
    frozen = mark_crosstalk(cues).select("media_id", "id", F.col("crosstalk").alias("__frozen"))
    merged = coalesce_intervals(vad, TOL)
    if activity is not None:
        merged = merged.unionByName(
            activity.join(merged.select("media_id").distinct(), "media_id", "left_anti").select(
                "media_id", "start", "end"
            )
        )
    marked = started.join(frozen, ["media_id", "id"]).withColumn(
        "__frozen", F.col("__frozen") | (F.col("align_backend") == "whisper-vad-unaligned")
    )
    return refine_ends(marked, merged, "__frozen").drop("__frozen")


def trim_long_silence(cues: DataFrame, vad: DataFrame) -> DataFrame:
    """Start near the end of the last long silence inside each cue; cross-talk stays."""
    gaps = speech_gaps(coalesce_intervals(vad, TOL))
    long_gap = F.col("prev_right").isNull() | (F.col("start") - F.col("prev_right") > TRIM_SILENCE)
    found = asof(
        mark_crosstalk(cues), gaps, ["media_id"], ["id"],
        F.struct(F.col("start").alias("left"), "prev_right"),
        {"hit": Probe(F.col("end"), F.col("start"), "last_lt", long_gap)},
    )
    quiet_from = F.greatest(F.col("start"), F.col("hit.prev_right"))
    moved = F.when(
        ~F.col("crosstalk") & (F.col("hit.left") - quiet_from > TRIM_SILENCE),
        F.greatest(F.col("start"), F.col("hit.left") - TRIM_PRE_ROLL),
    )
    return found.select(
        *[F.coalesce(moved, F.col("start")).alias("start") if c == "start" else F.col(c)
          for c in cues.columns]
    )


ATTEMPTS = ((0.2, 0.5), (2.0, 2.0))
EDGE = 0.05


def attempt_windows(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """The two padded windows of every cue that is not cross-talk."""
    pads = F.array(*[
        F.struct(F.lit(i + 1).alias("attempt"), F.lit(b).alias("b"), F.lit(a).alias("a"))
        for i, (b, a) in enumerate(ATTEMPTS)
    ])
    return (
        mark_crosstalk(cues)
        .where(~F.col("crosstalk"))
        .join(durations, "media_id")
        .select("media_id", "id", "start", "end", "duration", F.explode(pads).alias("p"))
        .select(
            "media_id", "id", "p.attempt",
            F.greatest(F.lit(0.0), F.col("start") - F.col("p.b")).alias("window_start"),
            F.least(F.col("duration"), F.col("end") + F.col("p.a")).alias("window_end"),
            "duration",
        )
    )


def judge_attempts(windows: DataFrame, scored: DataFrame) -> DataFrame:
    """Outcome of every attempt from its scored words.

    ``scored``: media_id, id, attempt, segment, pos, word, start, end, score, segment_text;
    times are relative to the window. A word with only one time, or outside the recording, spoils the
    attempt; words without any time are skipped; a zero score of the very first word
    rejects it.
    """
    words = scored.join(windows, ["media_id", "id", "attempt"]).withColumns({
        "abs_start": F.col("start") + F.col("window_start"),
        "abs_end": F.col("end") + F.col("window_start"),
    })
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    half = F.col("start").isNotNull() != F.col("end").isNotNull()
    illegal = timed & ~(
        (F.col("abs_end") >= F.col("abs_start"))
        & (F.col("abs_start") >= 0)
        & (F.col("abs_end") <= F.col("duration") + 1e-6)
    )
    per_segment = words.groupBy("media_id", "id", "attempt", "segment").agg(
        F.min_by(F.struct("score"), "pos").alias("first"),
        F.max(half | illegal).alias("bad"),
        F.count_if(timed).alias("timed"),
        F.min(F.when(timed, F.col("abs_start"))).alias("lo"),
        F.max(F.when(timed, F.struct("abs_start", "abs_end"))).alias("hi"),
    )
    zero = F.min_by("first", "segment")["score"] == 0
    per_attempt = per_segment.groupBy("media_id", "id", "attempt").agg(
        F.when(zero, "zero-first-token-score")
        .when(F.max(F.col("bad") | (F.col("timed") == 0)), "failed")
        .alias("fault"),
        F.min("lo").alias("lo"),
        F.max("hi")["abs_end"].alias("hi"),
    )
    out = windows.join(per_attempt, ["media_id", "id", "attempt"], "left")
    clipped = (
        (F.col("window_start") > EDGE) & (F.col("lo") <= F.col("window_start") + EDGE)
    ) | (
        (F.col("window_end") < F.col("duration") - EDGE) & (F.col("hi") >= F.col("window_end") - EDGE)
    )
    outcome = (
        F.when(
            (F.col("window_end") <= F.col("window_start"))
            | (F.col("lo").isNull() & F.col("fault").isNull()),
            "failed",
        )
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(clipped, "boundary-clipped")
        .otherwise("success")
    )
    return out.select(
        "media_id", "id", "attempt", "window_start", "window_end", outcome.alias("outcome")
    )


def mean_score(aligned_words: DataFrame, by: tuple[str, ...] = ("media_id", "id", "segment")) -> DataFrame:
    """Mean word score per aligned cue segment; words without a score do not count."""
    return aligned_words.groupBy(*by).agg(F.avg("score").alias("score"))


def select_alignment(
    cues: DataFrame, windows: DataFrame, scored: DataFrame, fallback: DataFrame
) -> DataFrame:
    """Accepted aligned segments, else the speech-aligned cue, else (cross-talk) the cue.

    Adds segment, align_backend, and the list of attempt outcomes.
    """
    judged = judge_attempts(windows, scored)
    chosen = judged.where("outcome = 'success'").groupBy("media_id", "id").agg(
        F.min("attempt").alias("attempt")
    )
    # A second attempt only happens when the first one was not accepted.
    history = judged.join(
        chosen.withColumnRenamed("attempt", "__last"), ["media_id", "id"], "left"
    ).where(F.col("__last").isNull() | (F.col("attempt") <= F.col("__last")))
    attempts = history.groupBy("media_id", "id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("attempt", "outcome"))), lambda x: x["outcome"]
        ).alias("attempts")
    )
    timed = (
        scored.join(chosen, ["media_id", "id", "attempt"], "left_semi")
        .where(F.col("start").isNotNull() & F.col("end").isNotNull())
        .join(windows.select("media_id", "id", "attempt", "window_start"), ["media_id", "id", "attempt"])
    )
    ordering = F.struct("start", "end")
    aligned = timed.groupBy("media_id", "id", "segment").agg(
        (F.min("start") + F.first("window_start")).alias("__start"),
        (F.max_by("end", ordering) + F.first("window_start")).alias("__end"),
        F.avg("score").alias("__score"),
        F.nullif(strip(F.first("segment_text", ignorenulls=True)), F.lit("")).alias("__text"),
    )
    # A cue cut into several segments takes their texts and loses its translation.
    parts = aligned.groupBy("media_id", "id").agg((F.count(F.lit(1)) > 1).alias("__split"))
    aligned = aligned.join(parts, ["media_id", "id"])
    marked = mark_crosstalk(cues).join(attempts, ["media_id", "id"], "left")
    fb = fallback.select(
        "media_id", "id", F.col("start").alias("__fs"), F.col("end").alias("__fe"),
        F.col("timing_confidence").alias("__fc"),
    )
    joined = marked.join(aligned, ["media_id", "id"], "left").join(fb, ["media_id", "id"], "left")
    forced = F.col("segment").isNotNull()
    keep = F.col("crosstalk")
    columns = [
        F.when(forced, F.col("__start")).when(keep, F.col("start"))
        .otherwise(F.coalesce("__fs", "start")).alias("start") if c == "start"
        else F.when(forced, F.col("__end")).when(keep, F.col("end"))
        .otherwise(F.coalesce("__fe", "end")).alias("end") if c == "end"
        else F.when(forced, F.col("__score")).when(keep, F.col(c))
        .otherwise(F.coalesce("__fc", F.col(c))).alias(c) if c == "timing_confidence"
        else F.when(F.col("__split"), F.coalesce("__text", F.col(c))).otherwise(F.col(c)).alias(c)
        if c == "source"
        else F.when(F.coalesce("__split", F.lit(False)), F.lit(None)).otherwise(F.col(c)).alias(c)
        if c == "translated"
        else F.col(c)
        for c in cues.columns
    ]
    return joined.select(
        *columns, "segment", "attempts",
        F.when(forced, "whisperx").when(keep, F.lit(None)).otherwise("vad-fallback").alias("align_backend"),
    )


def rejected_word_audit(windows: DataFrame, scored: DataFrame) -> DataFrame:
    """Words of zero-first-score attempts, times kept only where they are legal."""
    rejected = judge_attempts(windows, scored).where("outcome = 'zero-first-token-score'")

    def legal(c):
        t = F.col(c) + F.col("window_start")
        return F.when((t >= 0) & (t <= F.col("duration") + 1e-6), t).alias(c)

    return (
        scored.join(rejected.select("media_id", "id", "attempt"), ["media_id", "id", "attempt"], "left_semi")
        .join(windows, ["media_id", "id", "attempt"])
        .select("media_id", "id", "attempt", "segment", "pos", "word", legal("start"), legal("end"), "score")
    )
