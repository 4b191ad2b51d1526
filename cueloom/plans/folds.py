"""Greedy folds over ordered blocks.

Some decisions depend on earlier decisions. Rows flagged ``reset`` start afresh whatever
came before, so every block folds the rows after its first reset on its own, all blocks at
once. The rows before the first reset (the head) belong to a stretch that began in an
earlier block; they are folded next, with the state that block ended in. A head whose
block holds no reset at all passes its state on to the next round, so a stretch of any
length is exact and never sits in one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.plans.blocks import BLOCK, Ordered, running_sum
from cueloom.session import materialize

# step(rows, state) -> (one decision per row, state); rows carry their own resets.
Step = Callable[[pd.DataFrame, object], tuple[list, object]]


def fold(placed: Ordered, reset: str, step: Step, decision_type: str = "boolean") -> DataFrame:
    """Add ``decision`` to the rows; ``reset`` must hold on the first row of every key."""
    by, order = placed.by, placed.order
    # Only a run of rows before the first reset of its (block, key) is a head.
    local = Ordered(placed.df, [BLOCK, *by], order, 1)
    rows = local.scan(__seen=running_sum(F.col(reset).cast("int"))).df
    rows = rows.withColumn("__head", F.col("__seen") == 0).drop("__seen")
    if placed.blocks > 1:
        rows = materialize(rows)  # the tails, the marks and every round of heads read them
    columns = [c for c in rows.columns]
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields
    ) + f", decision {decision_type}, __exit string"
    sort_by = [*by, *order]

    def run(pdf: pd.DataFrame, state) -> pd.DataFrame:
        pdf = pdf.sort_values(sort_by, kind="stable", na_position="first")
        decisions, state = step(pdf, state)
        pdf = pdf[columns].copy()
        pdf["decision"] = pd.Series(decisions, index=pdf.index, dtype=object)
        pdf["__exit"] = None
        pdf.loc[pdf.index[-1], "__exit"] = json.dumps(state)
        return pdf

    def run_fresh(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, None)

    tails = rows.where(~F.col("__head")).groupBy(BLOCK).applyInPandas(run_fresh, schema)
    if placed.blocks == 1:
        # Keys are whole, and every key begins with a reset: no heads.
        return tails.drop("__head", "__exit")
    tails = materialize(tails)
    done = [tails]
    heads = rows.where("__head")
    # One small row per block: its number and whether a head or a tail is in it.
    marks = (
        rows.groupBy(BLOCK)
        .agg(F.max("__head").alias("head"), F.min("__head").alias("only_head"))
        .orderBy(BLOCK)
        .collect()
    )
    previous = {m[BLOCK]: p[BLOCK] for p, m in zip(marks, marks[1:])}
    waiting = {m[BLOCK]: m["only_head"] for m in marks if m["head"]}
    exits = tails.where(F.col("__exit").isNotNull()).select(BLOCK, "__exit")
    spark = placed.df.sparkSession

    def run_head(rows_pdf: pd.DataFrame, state_pdf: pd.DataFrame) -> pd.DataFrame:
        return run(rows_pdf, json.loads(state_pdf["__exit"].iloc[0]))

    while waiting:
        ready = [b for b in waiting if not (previous[b] in waiting and waiting[previous[b]])]
        link = spark.createDataFrame([(b, previous[b]) for b in ready], "b int, p int")
        entry = exits.join(F.broadcast(link), F.col(BLOCK) == F.col("p")).select(
            F.col("b").alias(BLOCK), "__exit"
        )
        mine = heads.join(F.broadcast(link.select(F.col("b").alias(BLOCK))), BLOCK, "left_semi")
        solved = materialize(
            mine.select(*columns)
            .toDF(*columns)
            .groupBy(BLOCK)
            .cogroup(entry.toDF(BLOCK, "__exit").groupBy(BLOCK))
            .applyInPandas(run_head, schema)
        )
        done.append(solved)
        carried_on = [b for b in ready if waiting[b]]
        fresh = solved.where(F.col("__exit").isNotNull() & F.col(BLOCK).isin(carried_on or [-1]))
        exits = exits.unionByName(fresh.select(BLOCK, "__exit"))
        for b in ready:
            del waiting[b]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("__head", "__exit")
