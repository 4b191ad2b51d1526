"""Following links: roots of paths, and the stops of a bounded-stride walk."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.session import materialize, spread


def path_roots(
    links: DataFrame, node: str, parent: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(node, root, keep) for nodes that each have at most one parent.

    Pointer doubling: every round halves the remaining distance, so a path of length n
    takes log2(n) rounds of an equi-join on unique keys.
    """
    current = links.select(node, F.col(parent).alias("root"), *keep)
    while True:
        up = current.select(F.col(node).alias("__n"), F.col("root").alias("__up"))
        current = materialize(
            current.join(up, F.col("root") == F.col("__n"), "left").select(
                node,
                F.coalesce("__up", "root").alias("root"),
                *keep,
                F.col("__up").isNotNull().alias("__moved"),
            )
        )
        if current.where("__moved").limit(1).count() == 0:
            return current.select(node, "root", *keep)
        current = current.select(node, "root", *keep)


# jump(block_start, size, total, marks) -> (next position, forced) arrays of length size
Jump = Callable[[int, int, int, pd.DataFrame], tuple[np.ndarray, np.ndarray]]


def walk_stops(
    totals: DataFrame,
    marks: DataFrame,
    by: list[str],
    jump: Jump,
    stride: int,
    block: int = 65536,
    fan: int = 64,
) -> DataFrame:
    """Stops of the walk 0 -> next(0) -> ... over positions 0..n-1 of every key.

    ``next`` depends only on the marks within ``stride`` positions, so it is worked out for
    every position of a block at once. A block then shrinks to a table (entry -> exit) of at
    most ``stride`` rows; tables of ``fan`` blocks combine level by level until one entry per
    key remains, and the true entries are handed back down. Groups stay bounded by the block
    size and the fan, however long one recording is. A key of one block is entered at 0 and
    needs no table; many such keys share a group, for a group of its own takes far longer
    than its walk.

    ``totals``: by, n. ``marks``: by, pos, and whatever ``jump`` reads.
    Returns by, pos, stop (exclusive end), forced.
    """
    if block < stride:
        raise ValueError("block must be at least one stride long")
    types = {f.name: f.dataType.simpleString() for f in totals.schema.fields}
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)
    totals = totals.where("n > 0")
    inside = totals.where(F.col("n") <= block)
    short = _short_walks(inside, marks.where(F.col("pos") < block), by, jump, keys)
    totals = totals.where(F.col("n") > block)
    if totals.isEmpty():
        return short
    marks = marks.join(spread(totals.select(*by)), by, "left_semi")
    grid = totals.select(
        *by,
        F.col("n").cast("long").alias("n"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))).alias("b"),
    )
    own = (F.floor(F.col("pos") / block)).cast("long")
    near = marks.withColumn(
        "b",
        F.explode(
            F.when(
                (F.col("pos") % block < stride) & (own > 0), F.array(own, own - 1)
            ).otherwise(F.array(own))
        ),
    )

    def block_table(key, grid_pdf, marks_pdf):
        if grid_pdf.empty:
            return pd.DataFrame(columns=[*by, "b", "entry", "exit"])
        n, b = int(grid_pdf["n"].iloc[0]), int(grid_pdf["b"].iloc[0])
        start = b * block
        size = min(block, n - start)
        nxt, _ = jump(start, size, n, marks_pdf)
        exits = nxt.copy()
        for i in range(size - 1, -1, -1):
            if nxt[i] - start < size:
                exits[i] = exits[nxt[i] - start]
        # Only the first block is entered at its very start alone.
        entries = 1 if b == 0 else min(stride, size)
        out = pd.DataFrame({"b": b, "entry": start + np.arange(entries), "exit": exits[:entries]})
        for c, v in zip(by, key):
            out[c] = v
        return out[[*by, "b", "entry", "exit"]]

    def grouped(df, level="b"):
        # Fresh column ids: both sides of a cogroup may stem from one table.
        return df.toDF(*df.columns).groupBy(*by, level)

    level = materialize(
        grouped(grid).cogroup(grouped(near)).applyInPandas(
            block_table, f"{keys}, b long, entry long, exit long"
        )
    )
    levels, span = [level], block

    def combine(pdf):
        # Blocks of one parent, walked from the last to the first.
        exits = dict(zip(pdf["entry"], pdf["exit"]))
        reached = {}
        for entry in sorted(exits, reverse=True):
            reached[entry] = reached.get(exits[entry], exits[entry])
        first = pdf["b"].min()
        keep = pdf[pdf["b"] == first].copy()
        keep["exit"] = [reached[e] for e in keep["entry"]]
        keep["b"] = keep["up"]
        return keep.drop(columns="up")

    while level.where("b > 0").limit(1).count():
        span *= fan
        up = level.withColumn("up", F.floor(F.col("b") / fan).cast("long"))
        level = materialize(
            up.groupBy(*by, "up").applyInPandas(
                combine, f"{keys}, b long, entry long, exit long"
            )
        )
        levels.append(level)

    # Hand the entries down: position 0 enters the single top block.
    entered = level.where("entry = 0").select(*by, "b", "entry")

    def descend(key, top_pdf, table_pdf):
        exits = dict(zip(table_pdf["entry"], zip(table_pdf["b"], table_pdf["exit"])))
        out = []
        if not top_pdf.empty:
            at = int(top_pdf["entry"].iloc[0])
            while at in exits:
                b, after = exits[at]
                out.append((*key[:-1], b, at))
                at = after
        return pd.DataFrame(out, columns=[*by, "b", "entry"])

    for table in reversed(levels[:-1]):
        table = table.withColumn("up", F.floor(F.col("b") / fan).cast("long"))
        top = entered.withColumnRenamed("b", "up")
        entered = (
            grouped(top, "up")
            .cogroup(grouped(table, "up"))
            .applyInPandas(descend, f"{keys}, b long, entry long")
        )

    def stops(key, grid_pdf, marks_pdf):
        out = []
        if not grid_pdf.empty:
            n, b = int(grid_pdf["n"].iloc[0]), int(grid_pdf["b"].iloc[0])
            start = b * block
            size = min(block, n - start)
            nxt, forced = jump(start, size, n, marks_pdf)
            at = int(grid_pdf["entry"].iloc[0]) - start
            while 0 <= at < size:
                out.append((*key[:-1], start + at, int(nxt[at]), bool(forced[at])))
                at = int(nxt[at]) - start
        return pd.DataFrame(out, columns=[*by, "pos", "stop", "forced"])

    located = grid.join(spread(entered), [*by, "b"])
    return (
        grouped(located)
        .cogroup(grouped(near))
        .applyInPandas(stops, f"{keys}, pos long, stop long, forced boolean")
        .unionByName(short)
    )


def _short_walks(totals: DataFrame, marks: DataFrame, by: list[str], jump: Jump, keys: str) -> DataFrame:
    """``walk_stops`` of keys of one block, many to a group."""
    n = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(df):
        # A fixed number of partitions: small as the tables are, they would come to one task.
        pack = F.pmod(F.xxhash64(*by), F.lit(8 * n)).cast("int")
        return df.withColumn("pack", pack).toDF(*df.columns, "pack").repartition(n, "pack").groupBy("pack")

    def walks(totals_pdf, marks_pdf):
        at = marks_pdf.groupby(by, sort=False, dropna=False).indices
        out = []
        for key, total in zip(totals_pdf[by].itertuples(index=False, name=None), totals_pdf["n"].tolist()):
            mine = at.get(key if len(by) > 1 else key[0], [])
            nxt, forced = jump(0, total, total, marks_pdf.iloc[mine])
            pos = 0
            while pos < total:
                out.append((*key, pos, int(nxt[pos]), bool(forced[pos])))
                pos = int(nxt[pos])
        return pd.DataFrame(out, columns=[*by, "pos", "stop", "forced"])

    return packed(totals.select(*by, F.col("n").cast("long").alias("n"))).cogroup(packed(marks)).applyInPandas(
        walks, f"{keys}, pos long, stop long, forced boolean"
    )
