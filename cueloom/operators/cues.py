"""Cue operators: batches with context, end extension, onsets, clamping, numbering, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.operators.intervals import index_quantile, mark_crosstalk
from cueloom.plans.blocks import (
    Ordered,
    following,
    lag,
    last_seen,
    lead,
    preceding,
    row_number,
)
from cueloom.session import materialize, spread

# Fixed values of the end-extension policy.
SHORT_GAP = 0.7
LONG_GAP = 1.0
END_EXTENSION = 0.5
# Windows of one cue that are tested together for an onset.
TILE = 1000


def valid_cues(cues: DataFrame) -> DataFrame:
    return cues.where((F.col("start") >= 0) & (F.col("end") >= F.col("start")))


def rejected_cues(cues: DataFrame) -> DataFrame:
    """Rows that break ``start >= 0 and end >= start``, with the reason."""
    ok = F.coalesce((F.col("start") >= 0) & (F.col("end") >= F.col("start")), F.lit(False))
    reason = F.when(F.col("start").isNull() | F.col("end").isNull(), "missing time").when(
        F.col("start") < 0, "negative start"
    ).otherwise("end before start")
    return cues.where(~ok).withColumn("reason", reason)


def _context(side: DataFrame | None, cues: DataFrame, name: str) -> DataFrame:
    """Attach an outside context list (media_id, ids) per recording."""
    empty = F.array().cast("array<string>")
    if side is None:
        return cues.withColumn(name, empty)
    joined = cues.join(side.select("media_id", F.col("ids").alias(name)), "media_id", "left")
    return joined.withColumn(name, F.coalesce(name, empty))


def _collect_batches(rows: DataFrame, keys: list[str]) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list(F.struct("__pos", "id"))), lambda x: x["id"])
    return rows.groupBy("media_id", *keys).agg(
        F.min("__pos").alias("first_pos"),
        ids.alias("ids"),
        F.min_by("__prev", "__pos").alias("preceding"),
        F.max_by("__next", "__pos").alias("following"),
    )


def missing_cue_batches(
    cues: DataFrame, size: int, k_prev: int, k_next: int, excluded: DataFrame | None = None
) -> DataFrame:
    """Runs of untranslated cues cut to ``size``, with the neighbouring cues of each batch.

    ``cues``: media_id, id, ordinal, translated. ``excluded``: media_id, id.
    """
    if excluded is not None:
        cues = cues.join(
            excluded.select("media_id", "id").distinct().withColumn("__x", F.lit(True)),
            ["media_id", "id"],
            "left",
        )
    else:
        cues = cues.withColumn("__x", F.lit(None).cast("boolean"))
    missing = F.col("__x").isNull() & (F.coalesce("translated", F.lit("")) == "")
    slim = cues.select("media_id", "id", "ordinal", missing.alias("__missing"))
    placed = Ordered.of(slim, ["media_id"], ["ordinal", "id"]).scan(
        __pos=row_number(),
        __before=lag(F.col("__missing")),
        __prev=preceding(F.col("id"), k_prev),
        __next=following(F.col("id"), k_next),
    )
    opens = F.col("__missing") & ~F.coalesce(F.col("__before"), F.lit(False))
    placed = placed.with_df(placed.df.withColumn("__open", F.when(opens, F.col("__pos"))))
    rows = placed.scan(__run=last_seen(F.col("__open"))).rows.where("__missing")
    rows = rows.withColumn("__batch", F.floor((F.col("__pos") - F.col("__run")) / size))
    return _collect_batches(rows, ["__run", "__batch"]).select(
        "media_id", (F.col("first_pos") - 1).alias("first_pos"), "ids", "preceding", "following"
    )


def fixed_batches(
    cues: DataFrame,
    size: int,
    k_prev: int,
    k_next: int,
    before: DataFrame | None = None,
    after: DataFrame | None = None,
) -> DataFrame:
    """Batches of ``size`` cues with context, drawn also from outside the given cues."""
    placed = Ordered.of(
        cues.select("media_id", "id", "ordinal"), ["media_id"], ["ordinal", "id"]
    ).scan(
        __pos=row_number(),
        __prev=preceding(F.col("id"), k_prev),
        __next=following(F.col("id"), k_next),
    )
    rows = placed.rows.withColumn("__batch", F.floor((F.col("__pos") - 1) / size))
    out = _collect_batches(rows, ["__batch"])
    out = _context(after, _context(before, out, "__outer_prev"), "__outer_next")
    all_prev = F.concat("__outer_prev", "preceding")
    last = F.when(
        F.size(all_prev) > k_prev,
        F.slice(all_prev, F.size(all_prev) - k_prev + 1, F.lit(k_prev)),
    ).otherwise(all_prev)
    return out.select(
        "media_id",
        F.col("__batch").alias("batch"),
        "ids",
        (last if k_prev else F.slice(all_prev, 1, 0)).alias("preceding"),
        F.slice(F.concat("following", "__outer_next"), 1, k_next).alias("following"),
    )


def extend_ends(cues: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Extend each cue's end towards the next start; cross-talk stays untouched."""
    placed = Ordered.of(mark_crosstalk(cues), ["media_id"], ["start", "end", "id"]).scan(
        __next=lead(F.col("start"))
    )
    rows = placed.rows
    if durations is not None:
        rows = rows.join(
            durations.select(
                "media_id", F.greatest(F.lit(0.0), F.col("duration")).alias("__max")
            ),
            "media_id",
            "left",
        )
    else:
        rows = rows.withColumn("__max", F.lit(None).cast("double"))
    limit = F.coalesce("__max", F.lit(float("inf")))
    start = F.least(limit, F.col("start"))
    base = F.least(limit, F.greatest(start, F.col("end")))
    following_start = F.least(limit, F.greatest(F.lit(0.0), F.col("__next")))
    gap = following_start - base
    longer = F.least(limit, base + END_EXTENSION)
    end = (
        F.when(F.col("__next").isNull(), longer)
        .when(gap <= SHORT_GAP, following_start)
        .when(gap < LONG_GAP, (base + following_start) * 0.5)
        .otherwise(longer)
    )
    return rows.select(
        *[
            F.when(F.col("crosstalk"), F.col("start")).otherwise(start).alias("start")
            if c == "start"
            else F.when(F.col("crosstalk"), F.col("end"))
            .otherwise(F.greatest(start, end))
            .alias("end")
            if c == "end"
            else F.col(c)
            for c in cues.columns
        ]
    )


def clamp_timeline(cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Clamp to [0, duration] except cross-talk."""
    rows = mark_crosstalk(cues).join(
        durations.select("media_id", F.col("duration").alias("__d")), "media_id", "left"
    )
    limit = F.coalesce("__d", F.lit(float("inf")))
    start = F.least(limit, F.greatest(F.lit(0.0), F.col("start")))
    end = F.least(limit, F.greatest(start, F.col("end")))
    return rows.select(
        *[
            F.when(F.col("crosstalk"), F.col("start")).otherwise(start).alias("start")
            if c == "start"
            else F.when(F.col("crosstalk"), F.col("end")).otherwise(end).alias("end")
            if c == "end"
            else F.col(c)
            for c in cues.columns
        ]
    )


def _timed(cues: DataFrame, tie: list[str]) -> Ordered:
    keyed = cues.withColumn("__speaker", F.coalesce("speaker", F.lit("")))
    return Ordered.of(keyed, ["media_id"], ["start", "end", "__speaker", *tie])


def renumber(cues: DataFrame, tie: str = "id") -> DataFrame:
    """Number cues 1..n in time order and remember the first id as ``parent_id``."""
    parent = F.coalesce("parent_id", "id") if "parent_id" in cues.columns else F.col("id")
    rows = _timed(cues.withColumn("__parent", parent), [tie]).scan(__n=row_number()).rows
    kept = [c for c in cues.columns if c not in ("id", "parent_id")]
    return rows.select(
        F.col("__n").cast("string").alias("id"), *kept, F.col("__parent").alias("parent_id")
    )


def time_order(cues: DataFrame, tie: str = "ordinal") -> DataFrame:
    """Rank of every cue in (start, end, speaker) order, earlier ``tie`` first."""
    return _timed(cues, [tie]).scan(rank=row_number()).rows.drop("__speaker")


def list_by_ordinal(
    cues: DataFrame, stable_only: bool = False, ids: DataFrame | None = None
) -> DataFrame:
    """Rows in ordinal order, optionally stable ones or the given ids only."""
    rows = cues.where("stable") if stable_only else cues
    if ids is not None:
        rows = rows.join(ids.select("media_id", "id"), ["media_id", "id"], "left_semi")
    return rows.orderBy("media_id", "ordinal")


def nearest_context(
    points: DataFrame, cues: DataFrame, words: DataFrame, k_cues: int, k_words: int
) -> DataFrame:
    """Last ``k_cues`` cues starting before a point, first ``k_words`` words after it.

    ``points``: media_id, point, start, last_ordinal. Points join the cue order as rows, so
    the neighbours come from one ordered scan.
    """
    tagged = cues.select(
        "media_id", F.col("start").alias("__t"), F.lit(1).alias("__tag"), F.col("end").alias("__e"),
        F.col("id").alias("__id"), F.lit(None).cast("long").alias("point"),
    ).unionByName(
        points.select(
            "media_id", F.col("start").alias("__t"), F.lit(0).alias("__tag"),
            F.lit(None).cast("double").alias("__e"), F.lit(None).cast("string").alias("__id"),
            F.col("point").cast("long").alias("point"),
        )
    )
    # Equal starts sort points first: only strictly earlier cues precede. Points between
    # two cues are skipped by numbering the cues and fetching the k last numbers.
    placed = Ordered.of(tagged, ["media_id"], ["__t", "__tag", "__e", "__id", "point"])
    counted = placed.scan(__rn=row_number())
    cue_rows = Ordered.of(
        counted.rows.where("__tag = 1").select("media_id", "__rn", "__id"), ["media_id"], ["__rn"]
    ).scan(__before=preceding(F.col("__id"), k_cues - 1) if k_cues > 1 else preceding(F.col("__id"), 1))
    lists = cue_rows.rows.select(
        "media_id", "__rn",
        F.concat("__before", F.array("__id")).alias("__list")
        if k_cues > 1 else F.array("__id").alias("__list"),
    )
    joined = counted.rows.join(lists, ["media_id", "__rn"], "left")
    seen = Ordered.of(joined, ["media_id"], ["__rn"]).scan(__prev=last_seen(F.col("__list")))
    prev = seen.rows.where("__tag = 0").select(
        "media_id", "point",
        F.coalesce("__prev", F.array().cast("array<string>")).alias("preceding"),
    )
    wanted = points.select(
        "media_id", "point",
        F.explode(F.sequence(F.lit(1), F.lit(k_words))).alias("__i"), "last_ordinal",
    ).select("media_id", "point", "__i", (F.col("last_ordinal") + F.col("__i")).alias("ordinal"))
    after = (
        wanted.join(words.select("media_id", "ordinal", "text"), ["media_id", "ordinal"])
        .groupBy("media_id", "point")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]
            ).alias("following")
        )
    )
    return prev.join(after, ["media_id", "point"], "left").select(
        "media_id", "point", "preceding",
        F.coalesce("following", F.array().cast("array<string>")).alias("following"),
    )


def refine_onsets(cues: DataFrame, levels: DataFrame, step: float = 0.02) -> DataFrame:
    """Move cue starts past leading silence of a level envelope; adds ``volume_start``.

    ``levels``: media_id, win (dense from 0), rms; read several times, so a stored table.
    """
    # Fixed values of the detector.
    noise_q, back_seconds, cap_mult, cap_margin = 0.2, 0.4, 1.5, 3.0
    weak_mult, strong_mult, weak_peak, strong_peak = 1.3, 2.0, 0.0005, 0.003
    weak_min, strong_min, pre_roll, min_shift = 4.0, 8.0, 0.06, 0.005
    back = max(1, round(back_seconds / step))

    shape = levels.groupBy("media_id").agg(
        F.max("rms").alias("__top"), (F.max("win") + 1).alias("__n")
    ).where("__top > 0")
    floor = index_quantile(levels, "rms", noise_q, name="__global")
    shape = shape.join(floor, "media_id")
    marked = mark_crosstalk(cues)
    spans = (
        marked.where(~F.col("crosstalk"))
        .join(shape, "media_id")
        .select(
            "media_id", "id", "start", "__global",
            F.greatest(F.lit(0), F.floor(F.col("start") / step)).alias("__i0"),
            F.least("__n", F.ceil(F.col("end") / step)).alias("__i1"),
        )
        .where("__i1 > __i0")
    )
    # A cue's windows and the few before it, whose quantile is its local noise.
    search = materialize(
        spans.select(
            "media_id", "id", "start", "__global", "__i0",
            F.explode(
                F.sequence(F.greatest(F.lit(0), F.col("__i0") - back), F.col("__i1") - 1)
            ).alias("win"),
        ).join(spread(levels.select("media_id", "win", "rms")), ["media_id", "win"])
    )
    inside = F.col("win") >= F.col("__i0")
    ranked = F.col("__before")
    local = F.try_element_at(
        ranked, F.least(F.size(ranked), F.floor(F.size(ranked) * F.lit(noise_q)) + 1).cast("int")
    )
    cap = F.col("__global") * cap_mult + cap_margin
    noise = F.greatest("__global", F.least(F.coalesce("__local", "__global"), cap))
    peaks = (
        search.groupBy("media_id", "id")
        .agg(
            F.max(F.when(inside, F.col("rms"))).alias("__peak"),
            F.sort_array(F.collect_list(F.when(~inside, F.col("rms")))).alias("__before"),
            F.first("__global").alias("__global"), F.first("start").alias("start"),
        )
        .where("__peak is not null")
        .withColumn("__local", F.when(F.size(ranked) > 0, local))
        .withColumn("__noise", noise)
    )
    limits = peaks.select(
        "media_id", "id", "start", "__noise",
        F.greatest(
            F.col("__noise") * weak_mult, F.col("__peak") * weak_peak, F.lit(weak_min)
        ).alias("__weak"),
        F.greatest(
            F.col("__noise") * strong_mult, F.col("__peak") * strong_peak, F.lit(strong_min)
        ).alias("__strong"),
    )
    limits = materialize(limits)
    # Tiles of a cue's windows, with the edges the neighbouring tiles look at, so that a
    # long cue is no single group.
    tile = F.floor(F.col("win") / TILE)
    edge = F.col("win") % TILE
    tested = search.where(inside).join(
        limits.select("media_id", "id", "__weak", "__strong"), ["media_id", "id"]
    ).select(
        "media_id", "id", "win",
        (F.col("rms") > F.col("__weak")).cast("int").alias("w"),
        (F.col("rms") > F.col("__strong")).alias("s"),
        tile.alias("__own"),
        F.explode(
            F.when(edge < 2, F.array(tile, tile - 1))
            .when(edge >= TILE - 3, F.array(tile, tile + 1))
            .otherwise(F.array(tile))
        ).alias("__tile"),
    )
    along = Window.partitionBy("media_id", "id", "__tile").orderBy("win")
    run = (F.col("w") == 1) & (F.sum("w").over(along.rowsBetween(-3, 0)) == 4)
    strong = F.col("s") & (F.sum("w").over(along.rowsBetween(0, 2)) >= 2)
    trigger = (
        tested.withColumns({"__strong": strong, "__run": run})
        .where((F.col("__tile") == F.col("__own")) & (F.col("__strong") | F.col("__run")))
        .groupBy("media_id", "id")
        .agg(F.min(F.struct("win", (~F.col("__strong")).alias("weak"))).alias("__hit"))
    )
    onset_win = F.col("__hit.win") - F.when(F.col("__hit.weak"), 3).otherwise(0)
    onset = F.greatest(F.col("start"), onset_win * F.lit(step))
    refined = F.greatest(F.col("start"), onset - pre_roll)
    found = limits.join(trigger, ["media_id", "id"]).where(
        refined > F.col("start") + min_shift
    ).select(
        "media_id", "id",
        F.struct(
            F.col("start").alias("original_start"), onset.alias("detected_start"),
            refined.alias("refined_start"), F.col("__noise").alias("noise_floor"),
            F.col("__weak").alias("weak_threshold"), F.col("__strong").alias("strong_threshold"),
        ).alias("volume_start"),
    )
    return cues.join(found, ["media_id", "id"], "left").select(
        *[
            F.coalesce("volume_start.refined_start", "start").alias("start") if c == "start"
            else F.col(c)
            for c in cues.columns
        ],
        "volume_start",
    )
