"""Live variants of the operators: chunks, feeds, dedup, partials, dispatch, settling."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import norm_key_a, norm_key_c
from cueloom.operators.reconcile import DUPLICATE_SECONDS
from cueloom.operators.words import PAUSE_SECONDS
from cueloom.plans.blocks import Ordered, row_number
from cueloom.streaming.state import fold_stream

# Fixed values of the live rules.
CHUNK_SECONDS, CONTEXT_SECONDS = 15.0, 5.0
FEED_SECONDS, FEED_CONTEXT = 1.0, 1.0
MERGE_TOLERANCE, MERGE_LAST = 0.6, 80
FLUSH_SECONDS = 25.0
KEEP_SECONDS, CAP_SECONDS = 5.0, 60.0


def chunk_windows(
    durations: DataFrame, chunk: float = CHUNK_SECONDS, context: float = CONTEXT_SECONDS
) -> DataFrame:
    """(media_id, n, start, end) of a finished recording; the remainder comes last."""
    whole = F.floor(F.col("duration") / chunk)
    rest = F.col("duration") > whole * chunk
    last = whole - F.when(rest, 0).otherwise(1)
    return (
        durations.where("duration > 0")
        .select("media_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("n"))
        .select(
            "media_id", "n", F.greatest(F.lit(0.0), F.col("n") * F.lit(chunk) - context).alias("start"),
            F.least("duration", (F.col("n") + 1) * F.lit(chunk)).alias("end"),
        )
    )


def stream_chunks(
    decoded: DataFrame, chunk: float = CHUNK_SECONDS, context: float = CONTEXT_SECONDS
) -> DataFrame:
    """Windows as audio arrives. ``decoded``: media_id, seq, end, closed."""

    def step(state, row):
        n, out = state or 0, []
        while row["end"] >= (n + 1) * chunk:
            out.append({"n": n, "start": max(0.0, n * chunk - context), "end": (n + 1) * chunk})
            n += 1
        if row["closed"] and row["end"] > n * chunk:
            out.append({"n": n, "start": max(0.0, n * chunk - context), "end": row["end"]})
            n += 1
        return n, out

    return fold_stream(
        decoded, ["media_id"], ["seq"], step, "media_id long, n long, start double, end double"
    )


def continuous_feed(
    decoded: DataFrame, min_new: float = FEED_SECONDS, context: float = FEED_CONTEXT
) -> DataFrame:
    """Everything new once enough is new, with a little context before it."""

    def step(state, row):
        done = state or 0.0
        if row["end"] < done + min_new:
            return done, []
        return row["end"], [{"start": max(0.0, done - context), "end": row["end"]}]

    return fold_stream(decoded, ["media_id"], ["seq"], step, "media_id long, start double, end double")


def trim_ingested(feed: DataFrame) -> DataFrame:
    """Frames of each excerpt past the fed end. ``feed``: media_id, seq, offset, frames, rate."""

    def step(fed, row):
        offset, frames, rate = row["offset"], int(row["frames"]), int(row["rate"])
        fed = offset if fed is None else fed
        skip = min(frames, max(0, round((fed - offset) * rate)))
        if skip == frames:
            return fed, []
        return max(fed, offset + frames / rate), [
            {"seq": row["seq"], "skip_frames": skip, "fresh_frames": frames - skip, "fed_from": fed}
        ]

    return fold_stream(
        feed, ["media_id"], ["seq"], step,
        "media_id long, seq long, skip_frames long, fresh_frames long, fed_from double",
    )


def fence_generation(events: DataFrame) -> DataFrame:
    """Drop events of a generation older than the newest one seen."""
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    rest = [c for c in events.columns if c != "media_id"]

    def step(current, row):
        current = row["generation"] if current is None else max(current, row["generation"])
        keep = row["generation"] == current
        return current, [{c: row[c] for c in rest}] if keep else []

    schema = ", ".join(f"{c} {types[c]}" for c in ["media_id", *rest])
    return fold_stream(events, ["media_id"], ["seq"], step, schema)


def dedup_words_stream(
    words: DataFrame, tolerance: float = MERGE_TOLERANCE, last: int = MERGE_LAST
) -> DataFrame:
    """Append-only word stream: repeats of the last words and too early words are dropped.

    ``words``: media_id, seq, start, end, text, speaker. Ordinals never change.
    """
    keyed = words.withColumn("key", norm_key_c(F.col("text")))

    def step(state, row):
        count, recent = state or (0, [])
        if recent and row["start"] < recent[-1][0]:
            return [count, recent], []
        # Kept starts never fall, so the near ones are the last ones.
        for s, k in reversed(recent):
            if row["start"] - s > tolerance:
                break
            if k == row["key"]:
                return [count, recent], []
        kept = {"ordinal": count, "start": row["start"], "end": row["end"], "text": row["text"], "speaker": row["speaker"]}
        recent.append([row["start"], row["key"]])
        del recent[:-last]
        return [count + 1, recent], [kept]

    return fold_stream(
        keyed, ["media_id"], ["seq"], step,
        "media_id long, ordinal long, start double, end double, text string, speaker string",
    )


def fold_partials(events: DataFrame, clock: str | None = None, keep: float = CAP_SECONDS) -> DataFrame:
    """Finals that repeat nothing kept, and the changing partial.

    ``events``: media_id, seq, kind (partial, final, closed, error, nomatch), start, end, text.
    Emits kind final (never taken back), partial (replaces the one before; NULL text clears
    it) and ended. Equal texts interact only with each other, so the kept starts are state
    of (recording, text); the partial is state of the recording. With
    ``clock`` (see ``fold_stream``) a text not heard for ``keep`` seconds is forgotten, and so
    are starts more than ``CAP_SECONDS`` before its last one: audio that old is not fed again.
    """
    spoken = events.where("kind in ('partial', 'final') and coalesce(text, '') <> ''")
    keyed = spoken.where("kind = 'final'").withColumn("key", norm_key_a(F.col("text")))

    def judge(starts, row):
        starts = starts or []
        at = bisect_left(starts, row["start"] - DUPLICATE_SECONDS)
        if at < len(starts) and starts[at] <= row["start"] + DUPLICATE_SECONDS:
            return starts, []
        insort(starts, row["start"])
        if clock is not None:
            starts = starts[bisect_left(starts, starts[-1] - CAP_SECONDS):]
        return starts, [{"seq": row["seq"], "kind": "final", "start": row["start"], "end": row["end"], "text": row["text"]}]

    return fold_stream(
        keyed, ["media_id", "key"], ["seq"], judge,
        "media_id long, key string, seq long, kind string, start double, end double, text string",
        clock, keep,
    ).drop("key")


def current_partial(events: DataFrame) -> DataFrame:
    """The partial after every event that changes it, and the end of the session."""

    def step(shown, row):
        if row["kind"] in ("partial", "final") and row["text"]:
            text = row["text"] if row["kind"] == "partial" else None
            made = {"seq": row["seq"], "kind": "partial", "start": row["start"], "end": row["end"], "text": text}
            return (text, [made]) if text is not None or shown is not None else (None, [])
        if row["kind"] in ("closed", "error"):
            return shown, [{"seq": row["seq"], "kind": "ended", "start": None, "end": None, "text": row["text"] or row["kind"]}]
        return shown, []

    return fold_stream(
        events, ["media_id"], ["seq"], step,
        "media_id long, seq long, kind string, start double, end double, text string",
    )


def number_finals(finals: DataFrame) -> DataFrame:
    """Ids of the finals by (start, end), as the durable timeline numbers them."""
    placed = Ordered.of(finals, ["media_id"], ["start", "end", "seq"]).scan(n=row_number())
    return placed.rows.withColumn("id", F.col("n").cast("string")).drop("n")


def emit_deltas(
    cues: DataFrame, changed: bool = False, clock: str | None = None, keep: float = CAP_SECONDS
) -> DataFrame:
    """Only cues not emitted before, or also cues whose content changed.

    ``cues``: media_id, id, seq, and the content. State is per cue, so a long recording
    spreads over the cluster. With ``clock`` (see ``fold_stream``; not part of the content) a
    cue not sent for ``keep`` seconds is forgotten: its timeline has moved on.
    """
    types = {f.name: f.dataType.simpleString() for f in cues.schema.fields}
    rest = [c for c in cues.columns if c not in ("media_id", "id", clock)]
    content = [c for c in rest if c != "seq"]

    def step(known, row):
        now = [row[c] for c in content]
        if known is not None and (not changed or known == now):
            return known, []
        return now, [{c: row[c] for c in rest}]

    schema = ", ".join(f"{c} {types[c]}" for c in ["media_id", "id", *rest])
    return fold_stream(cues, ["media_id", "id"], ["seq"], step, schema, clock, keep)


def dispatch_stream(words: DataFrame, target: int) -> DataFrame:
    """Full-size word batches that end at a silence, each range once.

    ``words``: media_id, ordinal, start, end. Words after the last qualified silence are
    held back; state keeps the silences since the last dispatched word only.
    """
    hard, low = 2 * target, max(0, target // 2 - 1)

    def cut(first, usable, gaps):
        """End of the batch that begins at ``first``; None while it is not full-size."""
        left = usable - first
        if left <= hard:
            return usable if left >= target else None
        window = [(g, -o) for o, g in gaps if first + low <= o <= first + target - 1]
        if window:
            return -max(window)[1] + 1
        later = [o for o, _ in gaps if first + target <= o <= first + hard - 2]
        return later[0] + 1 if later else first + hard

    def step(state, row):
        first, reach, gaps = state or (0, None, [])
        out = []
        if reach is not None and row["start"] - reach >= PAUSE_SECONDS:
            gaps = [*gaps, [row["ordinal"] - 1, row["start"] - reach]]
            stop = cut(first, row["ordinal"], gaps)
            while stop is not None:
                # A cut short of the target is passed over; the final pass takes its words.
                if stop - first >= target:
                    out.append({"first_ordinal": first, "last_ordinal": stop - 1})
                first, gaps = stop, [g for g in gaps if g[0] >= stop]
                stop = cut(first, row["ordinal"], gaps)
        reach = row["end"] if reach is None else max(reach, row["end"])
        return [first, reach, gaps], out

    # A batch shorter than the target waits: the words held back keep growing.
    return fold_stream(
        words, ["media_id"], ["ordinal"], step, "media_id long, first_ordinal long, last_ordinal long"
    )


def forced_flush(feed: DataFrame, after: float = FLUSH_SECONDS) -> DataFrame:
    """Commit points once too much sent audio is uncommitted.

    ``feed``: media_id, seq, kind (sent or durable), end.
    """

    def step(floor, row):
        floor = floor or 0.0
        if row["kind"] == "durable":
            return max(floor, row["end"]), []
        if row["end"] - floor >= after:
            return row["end"], [{"seq": row["seq"], "commit_at": row["end"]}]
        return floor, []

    return fold_stream(feed, ["media_id"], ["seq"], step, "media_id long, seq long, commit_at double")


def retained(
    buffer: DataFrame, marks: DataFrame, keep: float = KEEP_SECONDS, cap: float = CAP_SECONDS
) -> DataFrame:
    """Buffered pieces still needed: ``marks`` has media_id, durable_end, fed_end."""
    cut = F.greatest(F.col("durable_end") - keep, F.col("fed_end") - cap)
    return (
        buffer.join(marks, "media_id", "left")
        .where(F.coalesce(F.col("end") > cut, F.lit(True)))
        .select(*buffer.columns)
    )


def resume_offset(words: DataFrame, overlap: float = KEEP_SECONDS) -> DataFrame:
    """Where a broken session resumes: a little before the last durable word's end."""
    return words.groupBy("media_id").agg(
        F.greatest(F.lit(0.0), F.max_by("end", "ordinal") - overlap).alias("resume_at")
    )
