"""Final ids for the part of a live timeline that can no longer change.

The settled prefix is a function of the landed cues, the open junctions and the known
words alone. It is therefore worked out from those tables, in a batch query or in
``foreachBatch`` after each delta has landed, and gives the same ids either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.operators.reconcile import _suspicious
from cueloom.plans.blocks import Ordered, row_number
from cueloom.session import materialize


def _known(cues: DataFrame, words: DataFrame) -> DataFrame:
    """(media_id, word, landed, start, spoken): each word with the last landing of a cue over it.

    Words and the ranges of cues meet in one grouping of numbers; what else is known of a cue
    is looked up for the few words beside a cut.
    """
    none = F.lit(None)
    spoken = words.select(
        "media_id", F.col("ordinal").cast("long").alias("word"), none.cast("long").alias("landed"), "start", F.lit(1).alias("spoken")
    )
    covered = cues.select(
        "media_id", F.explode(F.sequence(F.col("first_word").cast("long"), F.col("last_word").cast("long"))).alias("word"),
        F.col("landed").cast("long").alias("landed"), none.cast("double").alias("start"), none.cast("int").alias("spoken"),
    )
    return spoken.unionByName(covered).groupBy("media_id", "word").agg(
        F.max("landed").alias("landed"), F.min("start").alias("start"), F.max("spoken").alias("spoken")
    )


def settle(
    cues: DataFrame, junctions: DataFrame, words: DataFrame, closed: DataFrame | None = None
) -> DataFrame:
    """(media_id, id, final_id) of the settled prefix.

    ``cues``: media_id, id, landed (order of landing), start, end, speaker, first_word,
    last_word. ``junctions``: media_id, ordinal, forced, for cuts a repair has not finished
    with. ``words``: media_id, ordinal, start. ``closed``: media_id of ended streams; None
    means all are.
    """
    ranges = cues.where("first_word <= last_word")
    known = materialize(_known(ranges, words))
    owner = ranges.select(
        "media_id", F.col("landed").cast("long").alias("landed"), F.struct("id", "start", "end", "speaker", "first_word").alias("c")
    )
    merged = junctions.groupBy("media_id", "ordinal").agg(F.max("forced").alias("forced"))

    def side(k: int):
        return F.first(F.when(F.col("side") == k, F.col("c")), ignorenulls=True)

    sides = (
        merged.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("word", (F.col("ordinal") + F.col("side")).cast("long"))
        .join(known.select("media_id", "word", "landed"), ["media_id", "word"]).join(owner, ["media_id", "landed"])
        .groupBy("media_id", "ordinal", "forced").agg(side(0).alias("l"), side(1).alias("r"))
    ).select(F.struct("media_id", "ordinal", "forced").alias("j"), "l", "r")
    both = F.col("l.id").isNotNull() & F.col("r.id").isNotNull()
    clean = both & ((F.col("l.id") == F.col("r.id")) | ~_suspicious(F.col("j.forced")))
    open_left = sides.where(~clean & F.col("l.id").isNotNull()).select(
        "j.media_id", F.col("l.first_word").alias("from_word")
    )
    reach = known.where("spoken = 1").groupBy("media_id").agg(
        (F.max("word") + 1).alias("total"), F.min(F.when(F.col("landed").isNull(), F.col("word"))).alias("gap")
    ).withColumn("cursor", F.coalesce("gap", "total"))
    if closed is None:
        reach = reach.withColumn("closed", F.lit(True))
    else:
        ended = closed.select("media_id").distinct().withColumn("closed", F.lit(True))
        reach = reach.join(ended, "media_id", "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    # The last covered word before a gap, or the last known word of an open stream.
    edge = (
        reach.where((F.col("cursor") > 0) & ((F.col("cursor") < F.col("total")) | ~F.col("closed")))
        .select("media_id", (F.col("cursor") - 1).alias("word"))
        .join(known.select("media_id", "word", "landed"), ["media_id", "word"]).join(owner, ["media_id", "landed"])
        .select("media_id", F.col("c.first_word").alias("from_word"))
    )
    mutable = open_left.unionByName(edge).groupBy("media_id").agg(F.min("from_word").alias("mutable_from"))
    frontier = (
        known.where("spoken = 1").join(mutable, "media_id")
        .where(F.col("word") >= F.col("mutable_from"))
        .groupBy("media_id")
        .agg(F.min("start").alias("frontier"))
    )
    limits = (
        reach.where("cursor > 0")
        .join(mutable, "media_id", "left")
        .join(frontier, "media_id", "left")
        .select(
            "media_id", F.coalesce("mutable_from", "total").alias("mutable_from"),
            F.coalesce("frontier", F.lit(float("inf"))).alias("frontier"),
        )
    )
    # Texts and whatever else the cues carry are not placed.
    keyed = ranges.select(
        "media_id", "id", "start", "end", F.coalesce("speaker", F.lit("")).alias("__s"), "landed", "last_word"
    )
    ranked = Ordered.of(keyed, ["media_id"], ["start", "end", "__s", "landed"]).scan(rank=row_number()).rows
    held = (F.col("last_word") + 1 > F.col("mutable_from")) | (F.col("start") >= F.col("frontier"))
    judged = ranked.join(limits, "media_id").withColumn("held", held)
    first_held = judged.where("held").groupBy("media_id").agg(F.min("rank").alias("stop"))
    return (
        judged.join(first_held, "media_id", "left")
        .where(F.col("stop").isNull() | (F.col("rank") < F.col("stop")))
        .select("media_id", "id", F.col("rank").cast("string").alias("final_id"))
    )


def renames(settled: DataFrame) -> DataFrame:
    """(media_id, id, new_id) of settled cues that still carry another id."""
    return settled.where("id <> final_id").select("media_id", "id", F.col("final_id").alias("new_id"))
