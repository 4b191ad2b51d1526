"""A mixture of sources with exact shares, in columns only.

Every document gets a hash-random key. Inside its source the keys are cut into ranges,
range sums are added up to offsets, and a window inside one range gives the exact number
of words before each document. A source's budget is then taken from the start of that
order: whole passes over the source first, then documents up to the budget, the last one
in part. A hot source spreads over all its ranges, so no task holds a source.

Defined results: a null or blank text has size 0 and nothing is taken from it. A null
source is a source of its own and comes last. Rows that agree in id, source and size are
interchangeable; every other tie has an order. A source without words has target 0. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
RANGE_DIGITS = 3
SPACE = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``target`` of each source: shares by weight, none above ``most`` times its size.

    ``sizes`` has one row per source (``__no`` true for null, ``__source``, ``source_size``),
    a bounded list: the mixture's recipe names a weight for each. Filling all sources at
    the speed of their weights stops each at its limit; a source is at its limit when the
    level reached with everything it precedes frozen is beyond limit / weight.
    """
    order = Window.orderBy("__no", "__source")
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy("__ratio", "__no", "__source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = F.sum("__weight").over(everything) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0))
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    ) / onward
    found = (
        sizes.withColumn("__weight", weight)
        .withColumn("__limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("__ratio", F.col("__limit") / F.col("__weight"))
        .withColumn("__level", level)
        .withColumn("__full", F.col("__ratio") <= F.col("__level"))
    )
    # Past the first source below its limit the level only falls.
    free = F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything)
    return found.withColumn(
        "target", F.when(F.col("__full"), F.col("__limit")).otherwise(F.col("__weight") * free)
    ).drop("__weight", "__limit", "__ratio", "__level", "__full")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    most: float = MOST, seed: str = "mixture", range_digits: int = RANGE_DIGITS,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken; same-named columns are replaced.

    ``taken`` counts words, repeats included: a document of 10 words taken once and to a
    third a second time has 13. ``range_digits`` sets the ranges per source to 16 to that
    power; the result does not depend on it.
    """
    added = ("size", "source_size", "target", "taken")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = (
        docs.select(*[c for c in docs.columns if c not in added], size_of(F.col("text")).alias("size"))
        .withColumn("__no", F.col("source").isNull())
        .withColumn("__source", F.coalesce("source", F.lit("")))
        .withColumn("__key", key).withColumn("__range", F.substring("__key", 1, range_digits))
    )
    cell = ["__no", "__source", "__range"]
    ranges = keyed.groupBy(*cell).agg(F.sum("size").alias("__sum"))
    earlier = (
        Window.partitionBy("__no", "__source").orderBy("__range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = ranges.withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    sources = ranges.groupBy("__no", "__source").agg(F.sum("__sum").alias("source_size"))
    goals = F.broadcast(targets(sources, weights, share, most))  # one row per source
    offsets = offsets.drop("__sum").join(goals, ["__no", "__source"])
    inside = (
        Window.partitionBy(*cell).orderBy("__key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("__offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    passes = F.coalesce(F.floor(budget / F.col("source_size")), F.lit(0)).cast("long")
    rest = budget - passes * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(rest - F.col("__before"), F.lit(0)))
    return (
        keyed.join(offsets, cell).withColumn("__before", before)
        .withColumn("taken", (passes * F.col("size") + last).cast("long"))
        .drop(*cell, "__key", "__offset", "__before")
    )
