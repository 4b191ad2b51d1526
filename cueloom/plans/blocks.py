"""Ordered scans that stay parallel when one key holds most of the rows.

A window partitioned by recording puts a whole recording into one task. Here the rows
are range-partitioned by (key, order) instead, so a large recording spans many blocks.
Every scan is then done in two steps: a window inside each block, and a correction
carried in from the neighbouring blocks. At most one key enters and one key leaves each
block, so the carried corrections number at most two rows per block, a bound that depends
on the partition count and not on the data; they are broadcast. A table whose counted
rows fit one task skips all that: plain windows give the same answer.

``order`` must be a total order inside a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.session import materialize

BLOCK = "__block"


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column | None = None
    inclusive: bool = True
    k: int = 1


def row_number() -> Scan:
    return Scan("row_number")


def running_sum(value: Column) -> Scan:
    return Scan("running_sum", value)


def running_max(value: Column, inclusive: bool = True) -> Scan:
    return Scan("running_max", value, inclusive)


def suffix_min(value: Column, inclusive: bool = True) -> Scan:
    return Scan("suffix_min", value, inclusive)


def total(value: Column) -> Scan:
    return Scan("total", value)


def lag(value: Column) -> Scan:
    return Scan("lag", value)


def lead(value: Column) -> Scan:
    return Scan("lead", value)


def last_seen(value: Column, inclusive: bool = True) -> Scan:
    """The latest non-null value up to this row."""
    return Scan("last_seen", value, inclusive)


def next_seen(value: Column, inclusive: bool = True) -> Scan:
    """The earliest non-null value from this row on."""
    return Scan("next_seen", value, inclusive)


def preceding(value: Column, k: int) -> Scan:
    """The values of up to ``k`` rows before this one, in order."""
    return Scan("preceding", value, k=k)


def following(value: Column, k: int) -> Scan:
    """The values of up to ``k`` rows after this one, in order."""
    return Scan("following", value, k=k)


WHOLE_ROWS = "spark.cueloom.wholeRows"


def whole_rows(spark: SparkSession) -> int:
    """Up to this many rows a table is scanned with its keys whole, above it in blocks."""
    return int(spark.conf.get(WHOLE_ROWS, "1000000"))


class Ordered:
    """Rows placed in ordered blocks; ``scan`` adds columns, ``rows`` gives them back."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], blocks: int):
        self.df, self.by, self.order, self.blocks = df, list(by), list(order), blocks

    @classmethod
    def of(
        cls, df: DataFrame, by: Sequence[str], order: Sequence[str], blocks: int | None = None
    ) -> Ordered:
        spark = df.sparkSession
        n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Both steps of a scan must see the same rows, also after an executor is lost.
        base = materialize(df)
        if n == 1 or base.count() <= whole_rows(spark):
            # The counted rows fit one task even if one key holds them all.
            return cls(base.withColumn(BLOCK, F.pmod(F.hash(*by), F.lit(n))), by, order, 1)
        placed = base.repartitionByRange(n, *by, *order).withColumn(BLOCK, F.spark_partition_id())
        return cls(materialize(placed), by, order, n)

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(BLOCK)

    def with_df(self, df: DataFrame) -> Ordered:
        """The same blocks after a row-wise change or a filter."""
        return Ordered(df, self.by, self.order, self.blocks)

    def scan(self, **scans: Scan) -> Ordered:
        by, order = self.by, self.order
        inside = Window.partitionBy(BLOCK, *by).orderBy(*order)
        whole = Window.partitionBy(BLOCK, *by)
        # Spark recomputes a frame that ends unbounded-following for every row, so
        # backward scans run forward over the reversed order.
        inside_back = Window.partitionBy(BLOCK, *by).orderBy(*[F.desc(c) for c in order])
        unb = Window.unboundedPreceding
        at = F.struct(*[F.col(c) for c in order])
        local, parts, carries = {}, {}, {}
        across = Window.partitionBy(*by).orderBy(BLOCK)
        before = across.rowsBetween(unb, -1)
        after = Window.partitionBy(*by).orderBy(F.desc(BLOCK)).rowsBetween(unb, -1)
        others = Window.partitionBy(*by)

        for name, s in scans.items():
            p, v = f"__p_{name}", s.value
            upto = inside.rowsBetween(unb, 0 if s.inclusive else -1)
            onward = inside_back.rowsBetween(unb, 0 if s.inclusive else -1)
            if s.kind == "row_number":
                local[name] = F.row_number().over(inside).cast("long")
                parts[p], carries[p] = F.count(F.lit(1)), F.sum(p).over(before)
            elif s.kind == "running_sum":
                local[name] = F.sum(v).over(upto)
                parts[p], carries[p] = F.sum(v), F.sum(p).over(before)
            elif s.kind == "running_max":
                local[name] = F.max(v).over(upto)
                parts[p], carries[p] = F.max(v), F.max(p).over(before)
            elif s.kind == "suffix_min":
                local[name] = F.min(v).over(onward)
                parts[p], carries[p] = F.min(v), F.min(p).over(after)
            elif s.kind == "total":
                local[name] = F.sum(v).over(whole)
                parts[p], carries[p] = F.sum(v), F.sum(p).over(others) - F.col(p)
            elif s.kind == "lag":
                local[name] = F.lag(F.struct(v.alias("v"))).over(inside)
                parts[p] = F.max_by(F.struct(v.alias("v")), at)
                carries[p] = F.lag(p).over(across)
            elif s.kind == "lead":
                local[name] = F.lead(F.struct(v.alias("v"))).over(inside)
                parts[p] = F.min_by(F.struct(v.alias("v")), at)
                carries[p] = F.lead(p).over(across)
            elif s.kind == "last_seen":
                local[name] = F.last(v, ignorenulls=True).over(upto)
                parts[p] = F.max_by(v, F.when(v.isNotNull(), at))
                carries[p] = F.last(p, ignorenulls=True).over(before)
            elif s.kind == "next_seen":
                local[name] = F.last(v, ignorenulls=True).over(onward)
                parts[p] = F.min_by(v, F.when(v.isNotNull(), at))
                carries[p] = F.last(p, ignorenulls=True).over(after)
            elif s.kind in ("preceding", "following"):
                near = s.kind == "preceding"
                frame = inside.rowsBetween(-s.k, -1) if near else inside.rowsBetween(1, s.k)
                item = F.struct(v.alias("v"))
                local[name] = F.collect_list(item).over(frame)
                # Only the k rows at the block's edge travel.
                gap = F.count(F.lit(1)).over(
                    (inside_back if near else inside).rowsBetween(unb, -1)
                )
                local[f"__edge_{name}"] = gap
                kept = F.when(F.col(f"__edge_{name}") < s.k, F.struct(at.alias("o"), item.alias("i")))
                parts[p] = F.transform(F.sort_array(F.collect_list(kept)), lambda x: x["i"])
                reach = across.rowsBetween(-s.k, -1) if near else across.rowsBetween(1, s.k)
                carries[p] = F.flatten(F.collect_list(p).over(reach))
            else:
                raise ValueError(s.kind)

        edges = {n: c for n, c in local.items() if n.startswith("__edge_")}
        base = self.df.withColumns(edges) if edges else self.df
        local = {n: c for n, c in local.items() if n not in edges}
        out = base.withColumns({f"__l_{n}": c for n, c in local.items()})
        if self.blocks > 1:
            summary = base.groupBy(*by, BLOCK).agg(*[c.alias(p) for p, c in parts.items()])
            spread = Window.partitionBy(*by)
            carried = (
                summary.withColumn("__span", F.count(F.lit(1)).over(spread))
                .withColumns({f"__c{p}": c for p, c in carries.items()})
                .where(F.col("__span") > 1)
                .select(
                    *[F.col(c).alias(f"__k_{c}") for c in by],
                    F.col(BLOCK).alias("__k_block"),
                    *[f"__c{p}" for p in carries],
                )
            )
            match = out[BLOCK] == carried["__k_block"]
            for c in by:
                match = match & out[c].eqNullSafe(carried[f"__k_{c}"])
            out = out.join(F.broadcast(carried), match, "left")
        merged = {}
        for name, s in scans.items():
            mine = F.col(f"__l_{name}")
            if self.blocks > 1:
                far = F.col(f"__c__p_{name}")
                if s.kind in ("row_number", "running_sum", "total"):
                    mine = F.when(far.isNull(), mine).when(mine.isNull(), far).otherwise(mine + far)
                elif s.kind == "running_max":
                    mine = F.greatest(mine, far)
                elif s.kind == "suffix_min":
                    mine = F.least(mine, far)
                elif s.kind == "preceding":
                    mine = F.concat(F.coalesce(far, F.slice(mine, 1, 0)), mine)
                    mine = F.when(
                        F.size(mine) > s.k, F.slice(mine, F.size(mine) - s.k + 1, F.lit(s.k))
                    ).otherwise(mine)
                elif s.kind == "following":
                    mine = F.slice(F.concat(mine, F.coalesce(far, F.slice(mine, 1, 0))), 1, s.k)
                else:
                    mine = F.coalesce(mine, far)
            if s.kind in ("lag", "lead"):
                mine = mine["v"]
            elif s.kind in ("preceding", "following"):
                mine = F.transform(mine, lambda x: x["v"])
            merged[name] = mine
        keep = [c for c in self.df.columns if c not in merged]
        done = out.select(*keep, *[c.alias(n) for n, c in merged.items()])
        return self.with_df(done)
