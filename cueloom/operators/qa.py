"""Subtitle checks: event problems, artifact equivalence, publish blockers, style fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions.times import ass_time
from cueloom.plans.blocks import Ordered, running_max


def event_problems(events: DataFrame) -> DataFrame:
    """Ordering and overlap defects in file order.

    ``events``: artifact, media_id, pos, start, end, name. Overlap of two different named
    speakers is legitimate; every other overlap is a defect.
    """
    key = ["artifact", "media_id"]
    unnamed = F.when(F.col("name") == "", F.col("end"))
    placed = Ordered.of(events, key, ["pos"]).scan(
        __start=running_max(F.col("start"), inclusive=False),
        __any=running_max(F.col("end"), inclusive=False),
        __unnamed=running_max(unnamed, inclusive=False),
    )
    per_name = Ordered.of(placed.rows, [*key, "name"], ["pos"]).scan(
        __same=running_max(F.col("end"), inclusive=False)
    )
    at = F.concat(F.lit("event at "), ass_time(F.col("start")))
    label = F.when(F.col("name") == "", at).otherwise(
        F.concat(at, F.lit(" ("), F.col("name"), F.lit(")"))
    )
    named = F.col("name") != ""
    crowded = F.coalesce(F.col("start") < F.greatest("__same", "__unnamed"), F.lit(False))
    alone = F.coalesce(F.col("start") < F.col("__any"), F.lit(False))

    def problem(rank, kind, tail, when):
        return F.when(
            when,
            F.struct(
                F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                F.concat(label, F.lit(tail)).alias("message"),
            ),
        )

    found = F.array(
        problem(0, "end_before_start", " ends before it starts", F.col("end") < F.col("start")),
        problem(1, "out_of_order", " starts before the event above it", F.col("start") < F.col("__start")),
        problem(
            2, "overlap", " overlaps an earlier cue of the same or an unnamed speaker", named & crowded
        ),
        problem(2, "overlap", " has no speaker and overlaps an earlier cue", ~named & alone),
    )
    return (
        per_name.rows.select(*key, "pos", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p"))
        .select(*key, "pos", "p.rank", "p.kind", "p.message")
    )


def artifact_mismatch(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Drift of each artifact from the recording's reference artifact.

    ``events``: artifact, media_id, pos, start, end, name with dense positions.
    ``reference``: media_id, artifact of the file the others must agree with.
    """
    ref = reference.select("media_id", F.col("artifact").alias("reference"))
    tagged = events.join(ref, "media_id")
    base = tagged.where(F.col("artifact") == F.col("reference"))
    others = tagged.where(F.col("artifact") != F.col("reference"))
    n_base = base.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_ref"))
    n_other = others.groupBy("media_id", "artifact", "reference").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = n_other.join(n_base, "media_id")
    by_count = counts.where("n <> n_ref").select(
        "media_id", "artifact",
        F.format_string("%s has %d cues but %s has %d", "artifact", "n", "reference", "n_ref").alias("message"),
    )
    b = base.select(
        "media_id", "pos", F.col("start").alias("b_start"), F.col("end").alias("b_end"),
        F.col("name").alias("b_name"),
    )
    same = (
        (F.col("start") == F.col("b_start"))
        & (F.col("end") == F.col("b_end"))
        & (F.col("name") == F.col("b_name"))
    )
    # Positions are dense and the counts agree, so the n-th of one meets the n-th of the other.
    equal = counts.where("n = n_ref").select("media_id", "artifact")
    by_pos = (
        others.join(equal, ["media_id", "artifact"], "left_semi")
        .join(b, ["media_id", "pos"])
        .where(~same)
        .groupBy("media_id", "artifact", "reference")
        .agg(F.min("pos").alias("pos"))
        .select(
            "media_id", "artifact",
            F.format_string(
                "%s cue %d does not share the timing and speaker of %s", "artifact", "pos", "reference"
            ).alias("message"),
        )
    )
    return by_count.unionByName(by_pos).select(
        "media_id", "artifact", F.lit("artifact_mismatch").alias("kind"), "message"
    )


def tolerated_kinds(*problems: DataFrame) -> DataFrame:
    """(media_id, kind): defects the pipeline's own rendering, or the originals, already have."""
    out = problems[0].select("media_id", "kind")
    for p in problems[1:]:
        out = out.unionByName(p.select("media_id", "kind"))
    return out.distinct()


def publish_blockers(
    files: DataFrame, events: DataFrame, problems: DataFrame, tolerated: DataFrame
) -> DataFrame:
    """Why staged files may not be published.

    ``files``: artifact, media_id, content (binary). A file without cues or with a broken
    encoding is always refused; other problems only when their kind is not tolerated.
    """
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    checked = files.select("artifact", "media_id", readable.alias("ok"))
    encoding = checked.where("not ok").select(
        "media_id", "artifact", F.lit("is not valid UTF-8").alias("message")
    )
    filled = events.select("artifact", "media_id").distinct()
    empty = (
        checked.where("ok")
        .join(filled, ["artifact", "media_id"], "left_anti")
        .select("media_id", "artifact", F.lit("contains no subtitle cues").alias("message"))
    )
    bad = encoding.unionByName(empty)
    real = (
        problems.join(tolerated, ["media_id", "kind"], "left_anti")
        .join(bad.select("media_id", "artifact"), ["media_id", "artifact"], "left_anti")
        .select("media_id", "artifact", "message")
    )
    return bad.unionByName(real)


def fill_styles(events: DataFrame) -> DataFrame:
    """Default lines of a named speaker take that speaker's first other style.

    ``events``: artifact, pos, name, style.
    """
    first = (
        events.where((F.col("name") != "") & (F.col("style") != "Default"))
        .groupBy("artifact", "name")
        .agg(F.min_by("style", "pos").alias("__style"))
    )
    return events.join(first, ["artifact", "name"], "left").select(
        *[
            F.when(F.col("style") == "Default", F.coalesce("__style", "style"))
            .otherwise(F.col("style"))
            .alias("style")
            if c == "style"
            else F.col(c)
            for c in events.columns
        ]
    )
