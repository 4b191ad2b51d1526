"""Nearest-in-time lookups without a range join.

Probe points and target rows are merged into one time order and the last or next target
is carried to each probe by an ordered scan. No pair of rows is ever formed, so the cost
stays linear however many rows share a recording or overlap one another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.plans.blocks import Ordered, last_seen, next_seen


@dataclass(frozen=True)
class Probe:
    """``pick`` is last_le, last_lt, first_ge or first_gt of ``axis`` against ``at``."""

    at: Column
    axis: Column
    pick: str
    where: Column | None = None


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    value: Column,
    probes: dict[str, Probe],
) -> DataFrame:
    """``left`` plus, per probe, the struct ``value`` of the row of ``right`` it finds.

    ``key`` identifies a row of ``left`` inside ``by``.
    """
    names = list(probes)
    targets = []
    for i, name in enumerate(names):
        p = probes[name]
        rows = right if p.where is None else right.where(p.where)
        targets.append(
            rows.select(
                *by,
                F.lit(i).alias("__axis"),
                p.axis.cast("double").alias("__t"),
                F.lit(1).alias("__tag"),
                value.alias("__v"),
            ).where(F.col("__t").isNotNull())
        )
    points = F.array(*[
        F.struct(
            F.lit(i).alias("axis"),
            probes[n].at.cast("double").alias("t"),
            F.lit(2 if probes[n].pick in ("last_le", "first_gt") else 0).alias("tag"),
        )
        for i, n in enumerate(names)
    ])
    carried = [c for c in left.columns if c not in by and c not in key]
    probing = left.select(
        *by, *key, F.struct(F.lit(0).alias("__x"), *carried).alias("__row"), F.explode(points).alias("__p")
    ).select(
        *by,
        *key,
        F.col("__p.axis").alias("__axis"),
        F.col("__p.t").alias("__t"),
        F.col("__p.tag").alias("__tag"),
        F.when(F.col("__p.axis") == 0, F.col("__row")).alias("__row"),
    )
    merged = reduce(lambda a, b: a.unionByName(b), targets).unionByName(
        probing, allowMissingColumns=True
    )
    found = (
        Ordered.of(merged, [*by, "__axis"], ["__t", "__tag", "__v", *key])
        .scan(__last=last_seen(F.col("__v")), __next=next_seen(F.col("__v")))
        .rows.where(F.col("__tag") != 1)
    )
    def answer(i, n):
        side = "__last" if probes[n].pick.startswith("last") else "__next"
        hit = (F.col("__axis") == i) & F.col("__t").isNotNull()
        return F.first(F.when(hit, F.col(side)), ignorenulls=True).alias(n)

    grouped = found.groupBy(*by, *key).agg(
        F.first("__row", ignorenulls=True).alias("__row"), *[answer(i, n) for i, n in enumerate(names)]
    )
    return grouped.select(
        *by, *key, *[F.col(f"__row.{c}").alias(c) for c in carried], *names
    )
