"""Chunk operators: frame-exact planning, overlap matching, speaker mapping, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import norm_key_b
from cueloom.plans.blocks import Ordered, lag, lead, row_number
from cueloom.plans.chains import path_roots
from cueloom.session import materialize

# Container header bytes, time tolerance, tolerances in a cell, tie tolerance, votes needed.
HEADER_BYTES = 45
MATCH_TOLERANCE = 0.6
CELL = 4
TIE = 1e-6
TIE_RELATIVE = 1e-9
MIN_VOTES = 2


def _chunk_shape(media: DataFrame) -> DataFrame:
    """Adds cap, overlap and why the row cannot be planned.

    ``media``: media_id, frames, rate, bytes_per_frame, max_seconds, overlap_seconds,
    max_bytes.
    """
    by_size = F.floor((F.col("max_bytes") - HEADER_BYTES) / F.col("bytes_per_frame"))
    limit = F.least(F.col("max_seconds") * F.col("rate"), (by_size + 1).cast("double"))
    cap = F.ceil(limit) - 1
    cap = F.when(cap / F.col("rate") >= F.col("max_seconds"), cap - 1).otherwise(cap)
    shaped = media.withColumn("cap", cap.cast("long"))
    raw = F.col("overlap_seconds") * F.col("rate")
    shaped = shaped.withColumn("overlap", F.rint(raw).cast("long"))
    problem = F.when(
        (F.col("frames") <= 0) | (F.col("cap") <= 0),
        "needs nonempty audio and a limit of at least one frame",
    ).when(
        (raw >= F.col("cap")) | (F.col("overlap") >= F.col("cap")),
        "overlap must be smaller than the chunk length",
    )
    return shaped.withColumn("problem", problem)


def plan_chunks(media: DataFrame) -> DataFrame:
    """(media_id, chunk, start_frame, end_frame, rate), strictly below both caps."""
    stride = F.col("cap") - F.col("overlap")
    count = F.when(F.col("frames") <= F.col("cap"), F.lit(1)).otherwise(
        F.ceil((F.col("frames") - F.col("cap")) / stride) + 1
    )
    return (
        _chunk_shape(media)
        .where("problem is null")
        .select(
            "media_id", "frames", "rate", "cap", stride.alias("stride"),
            F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("chunk"),
        )
        .select(
            "media_id", "chunk", (F.col("chunk") * F.col("stride")).alias("start_frame"),
            F.least("frames", F.col("chunk") * F.col("stride") + F.col("cap")).alias("end_frame"),
            "rate",
        )
    )


def rejected_plans(media: DataFrame) -> DataFrame:
    return _chunk_shape(media).where("problem is not null").select("media_id", "problem")


def _chunk_times(chunks: DataFrame) -> DataFrame:
    timed = chunks.select(
        "media_id", "chunk",
        (F.col("start_frame") / F.col("rate")).alias("c_start"),
        (F.col("end_frame") / F.col("rate")).alias("c_end"),
    )
    return (
        Ordered.of(timed, ["media_id"], ["chunk"])
        .scan(
            prev_end=lag(F.col("c_end")), next_start=lead(F.col("c_start")),
        )
        .rows
    )


def _absolute(chunk_words: DataFrame, times: DataFrame) -> DataFrame:
    return chunk_words.join(times, ["media_id", "chunk"]).withColumns({
        "start": F.col("start") + F.col("c_start"), "end": F.col("end") + F.col("c_start"),
    })


def _zones() -> tuple[Column, Column]:
    """Whether a word touches the overlap with the chunk before, and with the one after."""
    before = (
        (F.col("c_start") < F.col("prev_end"))
        & (F.col("end") >= F.col("c_start"))
        & (F.col("start") <= F.col("prev_end"))
    )
    after = (
        (F.col("next_start") < F.col("c_end"))
        & (F.col("end") >= F.col("next_start"))
        & (F.col("start") <= F.col("c_end"))
    )
    return F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))


def match_overlap_words(words: DataFrame) -> DataFrame:
    """Reciprocal unique-nearest pairs of equal words in adjacent overlapping chunks.

    ``words``: absolute times, media_id, chunk, pos, text, c_start, c_end, prev_end,
    next_start. Returns media_id, chunk, pos (later chunk) and prev_pos (earlier chunk).

    Copies with one key and one time tie with each other, so they shrink to a single row
    with a count before the join; pairs are formed only within the tolerance.
    """
    return _matches(_keyed(words), []).select("media_id", "chunk", "pos", "prev_pos")


def _keyed(words: DataFrame) -> DataFrame:
    """Adds before and after, as ``_zones``, and the key of words in an overlap."""
    before, after = _zones()
    return words.withColumns({"before": before, "after": after}).withColumn(
        "key", norm_key_b(F.when(F.col("before") | F.col("after"), F.col("text")))
    )


def _matches(keyed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The matches with the columns ``keep`` of the later word and, as prev_, of the earlier."""
    # Cells of several tolerances: most words reach into one cell only.
    width, reach = CELL * MATCH_TOLERANCE, MATCH_TOLERANCE * 1.001
    around = F.explode(F.array_distinct(F.array(
        F.floor((F.col("start") - reach) / width), F.floor((F.col("start") + reach) / width)
    )))

    def shrink(side, chunk, cell):
        # Placed for the join below, so that copies shrink without a shuffle of their own.
        place = ["media_id", "k", "key", "cell"]
        return (
            side.where("key <> ''")
            .select("media_id", chunk.alias("k"), "key", cell.alias("cell"), "start", "end", "pos", *keep)
            .repartition(*place).groupBy(*place, "start", "end")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", *keep)).alias("w"))
        )

    l_side = shrink(keyed.where("after"), F.col("chunk") + 1, around).alias("l")
    r_side = shrink(keyed.where("before"), F.col("chunk"), F.floor(F.col("start") / width)).alias("r")
    near = (
        (F.col("r.start") - MATCH_TOLERANCE <= F.col("l.start"))
        & (F.col("l.start") <= F.col("r.start") + MATCH_TOLERANCE)
        & (F.abs(F.col("l.end") - F.col("r.end")) <= MATCH_TOLERANCE)
    )
    pairs = l_side.join(
        r_side,
        (F.col("l.media_id") == F.col("r.media_id"))
        & (F.col("l.k") == F.col("r.k"))
        & (F.col("l.key") == F.col("r.key"))
        & (F.col("l.cell") == F.col("r.cell"))
        & near,
    ).select(
        F.col("r.media_id").alias("media_id"), F.col("r.k").alias("chunk"),
        F.col("r.w.pos").alias("pos"), F.col("l.w.pos").alias("prev_pos"),
        F.col("r.n").alias("r_n"), F.col("l.n").alias("l_n"),
        *[F.col(f"r.w.{c}").alias(c) for c in keep],
        *[F.col(f"l.w.{c}").alias(f"prev_{c}") for c in keep],
        (
            F.abs(F.col("l.start") - F.col("r.start")) + F.abs(F.col("l.end") - F.col("r.end"))
        ).alias("d"),
    )
    # Both windows lie inside a chunk, so its pairs are placed once.
    pairs = pairs.repartition("media_id", "chunk")
    # The candidates of one word are the distinct times of its token around it, so these
    # groups are small; rank and runner-up decide whether the nearest is unique.
    for_right = Window.partitionBy("media_id", "chunk", "pos").orderBy("d", "prev_pos")
    for_left = Window.partitionBy("media_id", "chunk", "prev_pos").orderBy("d", "pos")

    def tied(second):
        return F.coalesce(
            F.abs(F.col(second) - F.col("d"))
            <= F.greatest(F.lit(TIE), F.lit(TIE_RELATIVE) * F.greatest(second, "d")),
            F.lit(False),
        )

    ranked = pairs.withColumns({
        "r_rank": F.row_number().over(for_right), "r_second": F.lead("d").over(for_right),
    }).withColumns({
        "l_rank": F.row_number().over(for_left), "l_second": F.lead("d").over(for_left),
    })
    return ranked.where(
        (F.col("r_rank") == 1) & (F.col("l_rank") == 1)
        & (F.col("l_n") == 1) & (F.col("r_n") == 1)
        & ~tied("r_second") & ~tied("l_second")
    ).select("media_id", "chunk", "pos", "prev_pos", *keep, *[f"prev_{c}" for c in keep])


def map_speakers(words: DataFrame, matches: DataFrame) -> DataFrame:
    """(media_id, chunk, speaker, global_speaker).

    ``matches`` may bring the speaker and prev_speaker of its words; else they are looked up.
    Inside a chunk different labels never share a global id, so the votes can be judged on
    the labels of the two chunks alone; the global id is then the root of the chain of
    accepted links, numbered by first appearance.
    """
    named = words.where("speaker is not null").select("media_id", "chunk", "pos", "speaker")
    if "prev_speaker" not in matches.columns:
        earlier = named.select(
            "media_id", (F.col("chunk") + 1).alias("chunk"), F.col("pos").alias("prev_pos"),
            F.col("speaker").alias("prev_speaker"),
        )
        matches = matches.join(named, ["media_id", "chunk", "pos"]).join(
            earlier, ["media_id", "chunk", "prev_pos"]
        )
    votes = (
        matches.where("speaker is not null and prev_speaker is not null")
        .groupBy("media_id", "chunk", "speaker", "prev_speaker")
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    # Voting rows are label pairs of one chunk, so these groups are a few rows each.
    mine = Window.partitionBy("media_id", "chunk", "speaker")
    theirs = Window.partitionBy("media_id", "chunk", "prev_speaker")
    accepted = votes.withColumns({
        "choices": F.count(F.lit(1)).over(mine), "voters": F.count(F.lit(1)).over(theirs),
    }).where((F.col("choices") == 1) & (F.col("voters") == 1) & (F.col("votes") >= MIN_VOTES))
    labels = named.groupBy("media_id", "chunk", "speaker").agg(F.min("pos").alias("first_pos"))

    def node(chunk, speaker):
        return F.struct(
            F.col("media_id"), chunk.cast("long").alias("chunk"), speaker.alias("speaker")
        )

    linked = labels.join(
        accepted.select("media_id", "chunk", "speaker", "prev_speaker"),
        ["media_id", "chunk", "speaker"],
        "left",
    )
    links = linked.where("prev_speaker is not null").select(
        node(F.col("chunk"), F.col("speaker")).alias("node"),
        node(F.col("chunk") - 1, F.col("prev_speaker")).alias("parent"),
    )
    roots = path_roots(links, "node", "parent")
    own = node(F.col("chunk"), F.col("speaker"))
    rooted = labels.withColumn("node", own).join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    fresh = (
        Ordered.of(
            rooted.where(F.col("root") == F.col("node")).select("media_id", "chunk", "first_pos", "root"),
            ["media_id"], ["chunk", "first_pos"],
        )
        .scan(n=row_number())
        .rows.select("root", (F.col("n") - 1).cast("string").alias("global_speaker"))
    )
    return rooted.join(fresh, "root").select("media_id", "chunk", "speaker", "global_speaker")


def merge_chunks(chunks: DataFrame, chunk_words: DataFrame) -> DataFrame:
    """One word stream from overlapping chunks, speakers reconciled, ordinals dense.

    ``chunk_words``: media_id, chunk, pos (unique in its chunk), start, end (relative to the
    chunk), text, speaker.

    A word in no match stays if its chunk owns its time, so only words in an overlap meet
    the matches; of matched words one stays.
    """
    times = _chunk_times(chunks)
    left_cut = (F.col("prev_end") + F.col("c_start")) / 2
    right_cut = (F.col("c_end") + F.col("next_start")) / 2
    middle = (F.col("start") + F.col("end")) / 2
    owned = (left_cut.isNull() | (left_cut <= middle)) & (right_cut.isNull() | (middle < right_cut))
    words = materialize(_keyed(_absolute(chunk_words, times).withColumn("owned", owned)))
    single = F.col("prev_end").isNull() & F.col("next_start").isNull()
    columns = ["media_id", "chunk", "pos", "start", "end", "text", "speaker"]
    alone = words.where(single).select(*columns)
    many = words.where(~single)
    matches = materialize(_matches(many, ["speaker", "owned"]))
    mapping = map_speakers(many, matches)

    def node(chunk, pos):
        return F.struct(
            F.col("media_id"), chunk.cast("long").alias("chunk"), pos.cast("long").alias("pos")
        )

    links = matches.select(
        node(F.col("chunk"), F.col("pos")).alias("node"),
        node(F.col("chunk") - 1, F.col("prev_pos")).alias("parent"), "owned", "prev_owned",
    )
    roots = path_roots(links, "node", "parent", ["parent", "owned", "prev_owned"])

    def member(at, owned):
        return F.struct((~F.col(owned)).alias("u"), F.col(f"{at}.chunk"), F.col(f"{at}.pos"))

    # Every node is a member of its path; the root comes with the node whose parent it is.
    mine, first = member("node", "owned"), member("parent", "prev_owned")
    ends = F.col("parent") == F.col("root")
    members = roots.select(
        "root", F.explode(F.when(ends, F.array(mine, first)).otherwise(F.array(mine))).alias("m")
    )
    best = F.min("m").over(Window.partitionBy("root"))
    fate = members.select(
        F.col("root.media_id").alias("media_id"), "m.chunk", "m.pos", (F.col("m") == best).alias("wins")
    )
    inside = (
        many.where("before or after").join(fate, ["media_id", "chunk", "pos"], "left")
        .where(F.coalesce("wins", "owned")).select(*columns)
    )
    kept = inside.unionByName(many.where("not (before or after) and owned").select(*columns))
    kept = kept.join(mapping, ["media_id", "chunk", "speaker"], "left").select(
        *columns[:-1], F.col("global_speaker").alias("speaker")
    )
    return (
        Ordered.of(kept.unionByName(alone), ["media_id"], ["start", "end", "chunk", "pos"])
        .scan(ordinal=row_number())
        .rows.select(
            "media_id", (F.col("ordinal") - 1).alias("ordinal"), "start", "end", "text", "speaker"
        )
    )


def detected_language(chunk_lang: DataFrame) -> DataFrame:
    """First non-empty language in chunk order."""
    return (
        chunk_lang.where(F.coalesce("language", F.lit("")) != "")
        .groupBy("media_id")
        .agg(F.min_by("language", "chunk").alias("language"))
    )


def resume_plan(inputs: DataFrame, manifest: DataFrame, plan: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks still to do per recording, or why a stored plan cannot be resumed.

    ``inputs``/``manifest``: media_id, request, sha256, frames, rate, width (the last four
    from ``sources.pcm.fingerprints``).
    """
    audio = ["sha256", "frames", "rate", "width"]
    both = inputs.alias("i").join(manifest.alias("m"), "media_id", "left")
    same_audio = F.lit(True)
    for c in audio:
        same_audio = same_audio & F.col(f"i.{c}").eqNullSafe(F.col(f"m.{c}"))
    judged = both.select(
        "media_id",
        F.when(F.col("m.request").isNull(), "new")
        .when(F.col("i.request") != F.col("m.request"), "different request settings")
        .when(~same_audio, "different audio")
        .otherwise("reuse")
        .alias("decision"),
    )
    todo = plan.join(done, ["media_id", "chunk"], "left_anti").groupBy("media_id").agg(
        F.count(F.lit(1)).alias("todo")
    )
    full = plan.groupBy("media_id").agg(F.count(F.lit(1)).alias("all"))
    return judged.join(todo, "media_id", "left").join(full, "media_id", "left").select(
        "media_id", "decision",
        F.when(F.col("decision") == "reuse", F.coalesce("todo", F.lit(0)))
        .when(F.col("decision") == "new", F.col("all"))
        .otherwise(F.lit(0))
        .alias("chunks_to_do"),
    )
