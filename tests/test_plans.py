"""The block scans, lookups, folds and walks against plain windows and loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cueloom.plans import blocks as B
from cueloom.plans.asof import Probe, asof
from cueloom.plans.chains import path_roots, walk_stops
from cueloom.operators import reconcile, words
from cueloom.plans.folds import fold


def hot_rows(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [
        # One key holds most rows; a NULL key and NULL values occur.
        (None if i % 37 == 0 else "hot" if i % 5 else f"k{i % 7}", i, rng.randint(0, 50) if i % 4 else None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k string, o long, v long")


@pytest.mark.parametrize("n_blocks", [1, 3, 8])
def test_scans_equal_plain_windows(spark, blocks, n_blocks):
    df = hot_rows(spark)
    v = F.col("v")
    got = B.Ordered.of(df, ["k"], ["o"], n_blocks).scan(
        rn=B.row_number(), rs=B.running_sum(v), mx=B.running_max(v), mxp=B.running_max(v, inclusive=False),
        sm=B.suffix_min(v), smx=B.suffix_min(v, inclusive=False), tot=B.total(v), lg=B.lag(v), ld=B.lead(v),
        ls=B.last_seen(v), lsx=B.last_seen(v, inclusive=False), nx=B.next_seen(v, inclusive=False), ns=B.next_seen(v),
        pr=B.preceding(v, 3), fo=B.following(v, 5),
    ).rows
    w = Window.partitionBy("k").orderBy("o")
    up, up_x = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    down, down_x = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(1, Window.unboundedFollowing)
    one = F.struct("v")
    values = lambda c: F.transform(c, lambda x: x["v"])
    want = df.select(
        "k", "o", "v", F.row_number().over(w).cast("long").alias("rn"), F.sum(v).over(up).alias("rs"),
        F.max(v).over(up).alias("mx"), F.max(v).over(up_x).alias("mxp"), F.min(v).over(down).alias("sm"),
        F.min(v).over(down_x).alias("smx"), F.sum(v).over(Window.partitionBy("k")).alias("tot"),
        F.lag(v).over(w).alias("lg"), F.lead(v).over(w).alias("ld"), F.last(v, True).over(up).alias("ls"),
        F.last(v, True).over(up_x).alias("lsx"), F.first(v, True).over(down_x).alias("nx"),
        F.first(v, True).over(down).alias("ns"),
        values(F.collect_list(one).over(w.rowsBetween(-3, -1))).alias("pr"),
        values(F.collect_list(one).over(w.rowsBetween(1, 5))).alias("fo"),
    )
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_hot_key_spans_several_blocks(spark, blocks):
    placed = B.Ordered.of(hot_rows(spark), ["k"], ["o"], 8)
    assert placed.df.where("k = 'hot'").select(B.BLOCK).distinct().count() > 3
    # No block holds much more than its share.
    assert placed.df.groupBy(B.BLOCK).count().agg(F.max("count")).first()[0] < 400 / 8 * 2.5


def test_asof_equals_search(spark, either):
    rng = random.Random(5)
    left = [("m", i, float(rng.randint(0, 60))) for i in range(80)] + [("n", 0, 3.0)]
    right = [("m", float(rng.randint(0, 60)), j) for j in range(30)]
    got = asof(
        spark.createDataFrame(left, "m string, i long, t double"),
        spark.createDataFrame(right, "m string, x double, j long"), ["m"], ["i"], F.struct("x"),
        {
            "le": Probe(F.col("t"), F.col("x"), "last_le"), "lt": Probe(F.col("t"), F.col("x"), "last_lt"),
            "ge": Probe(F.col("t"), F.col("x"), "first_ge"), "gt": Probe(F.col("t"), F.col("x"), "first_gt"),
            "even": Probe(F.col("t"), F.col("x"), "last_le", F.col("j") % 2 == 0),
        },
    ).collect()
    assert len(got) == len(left)
    for r in got:
        xs = [x for m, x, _ in right if m == r.m]
        ev = [x for m, x, j in right if m == r.m and j % 2 == 0]
        want = {
            "le": max((x for x in xs if x <= r.t), default=None), "lt": max((x for x in xs if x < r.t), default=None),
            "ge": min((x for x in xs if x >= r.t), default=None), "gt": min((x for x in xs if x > r.t), default=None),
            "even": max((x for x in ev if x <= r.t), default=None),
        }
        assert {k: r[k] and r[k].x for k in want} == want


@pytest.mark.parametrize("every", [3, 50, 10**6])
def test_fold_without_resets_crosses_blocks(spark, blocks, every):
    """Cut whenever the running sum would pass 20; resets are rare or absent."""
    rng = random.Random(every)
    rows = [("a" if i < 150 else "b", i, rng.randint(1, 9), i in (0, 150) or i % every == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, v long, reset boolean")

    def step(pdf, state):
        out = []
        for v, reset in zip(pdf["v"], pdf["reset"]):
            cut = bool(reset) or state + v > 20
            state = int(v) if cut else state + int(v)
            out.append(cut)
        return out, state

    got = fold(B.Ordered.of(df, ["k"], ["o"], 8), "reset", step).orderBy("o").collect()
    state, want = 0, []
    for _, _, v, reset in rows:
        cut = reset or state + v > 20
        state = v if cut else state + v
        want.append(cut)
    assert [r.decision for r in got] == want


def test_path_roots(spark):
    links = [(i, i - 1) for i in range(1, 40)] + [(101, 100)]
    got = dict(map(tuple, path_roots(spark.createDataFrame(links, "n long, p long"), "n", "p").collect()))
    assert got == {**{i: 0 for i in range(1, 40)}, 101: 100}


@pytest.mark.parametrize("block,fan", [(8, 2), (16, 3), (4096, 64)])
def test_walk_stops_over_many_levels(spark, block, fan):
    rng = random.Random(block)
    strides = {k: [rng.randint(1, 7) for _ in range(n)] for k, n in (("a", 500), ("b", 1), ("c", 37))}
    marks = [(k, i, s) for k, row in strides.items() for i, s in enumerate(row)]
    totals = spark.createDataFrame([(k, len(r)) for k, r in strides.items()], "k string, n long")

    def jump(start, size, total, pdf):
        nxt = np.zeros(size, dtype=np.int64)
        for pos, s in zip(pdf["pos"], pdf["s"]):
            if start <= pos < start + size:
                nxt[pos - start] = min(total, pos + s)
        return nxt, np.zeros(size, dtype=bool)

    got = walk_stops(
        totals, spark.createDataFrame(marks, "k string, pos long, s long"), ["k"], jump, 8, block, fan
    ).select("k", "pos", "stop").collect()
    want = []
    for k, row in strides.items():
        at = 0
        while at < len(row):
            want.append((k, at, min(len(row), at + row[at])))
            at += row[at]
    assert sorted(map(tuple, got)) == sorted(want)
    assert isinstance(pd.DataFrame(got), pd.DataFrame)


def test_short_walks_share_their_groups(spark):
    """Hundreds of keys of one block come to Python together, with the marks of their own."""
    import glob
    import tempfile

    seen = tempfile.mkdtemp(prefix="walks-", dir="/tmp")
    rng = random.Random(5)
    strides = {(k % 3, k): [rng.randint(1, 7) for _ in range(rng.randint(1, 20))] for k in range(600)}
    strides[(0, 600)] = [rng.randint(1, 7) for _ in range(90)]
    marks = [(*k, i, s) for k, row in strides.items() for i, s in enumerate(row)]
    totals = spark.createDataFrame([(*k, len(r)) for k, r in strides.items()], "m long, k long, n long")

    def jump(start, size, total, pdf):
        tempfile.NamedTemporaryFile(dir=seen, prefix="j", delete=False).close()
        nxt = np.zeros(size, dtype=np.int64)
        for pos, s in zip(pdf["pos"], pdf["s"]):
            if start <= pos < start + size:
                nxt[pos - start] = min(total, pos + s)
        return nxt, np.zeros(size, dtype=bool)

    got = walk_stops(
        totals, spark.createDataFrame(marks, "m long, k long, pos long, s long"), ["m", "k"], jump, 8, 32, 4
    ).select("m", "k", "pos", "stop").collect()
    want = []
    for k, row in strides.items():
        at = 0
        while at < len(row):
            want.append((*k, at, min(len(row), at + row[at])))
            at += row[at]
    assert sorted(map(tuple, got)) == sorted(want)
    # Once for each short key, twice for the three blocks of the long one: its table and its stops.
    assert len(glob.glob(f"{seen}/j*")) == 600 + 2 * 3


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def ranged(spark, path, n=3):
    """Few rows, stored, whose word ranges explode to many."""
    cues = spark.createDataFrame([(1, f"c{i}", i * 10.0, i * 1000, i * 1000 + 899) for i in range(n)],
                                 "media_id long, id string, start double, first_word int, last_word int")
    heard = spark.range(n * 1000).select(F.lit(1).cast("long").alias("media_id"), F.col("id").cast("int").alias("ordinal"))
    cues.write.parquet(f"{path}/cues")
    return heard, spark.read.parquet(f"{path}/cues")


def test_exploded_ranges_are_never_broadcast(spark, tmp_path):
    heard, cues = ranged(spark, str(tmp_path))
    left = words.uncovered(heard, cues)
    assert broadcasts(left) == 0
    assert sorted(r.ordinal for r in left.collect()) == [i for i in range(3000) if i % 1000 >= 900]


def test_preview_cues_are_matched_without_broadcast(spark, tmp_path):
    _, cues = ranged(spark, str(tmp_path))
    preview = cues.withColumns({"id": F.concat(F.lit("p"), "id"), "first_word": F.col("first_word") + 899, "last_word": F.col("first_word") + 950})
    late = preview.withColumns({"id": F.concat(F.lit("q"), "id"), "first_word": F.col("first_word") + 1})
    got = reconcile.timeline_view(cues, preview.unionByName(late))
    assert broadcasts(got) == 0
    assert sorted(r.id for r in got.collect()) == ["c0", "c1", "c2", "qpc0", "qpc1", "qpc2"]


def test_boundaries_meet_cues_by_stretches(spark, tmp_path):
    cut = spark.createDataFrame([(1, 899 + 100, False), (1, 1999, True), (1, 70, True)], "media_id long, ordinal int, forced boolean")
    _, cues = ranged(spark, str(tmp_path))
    cues = cues.withColumns({"last_word": F.col("first_word") + 999, "ordinal": F.col("first_word") / 1000, "end": F.col("start") + 9.5, "speaker": F.lit("a")})
    got = reconcile.suspicious_junctions(cut, cues)
    assert "explode(sequence(first_word" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ordinal, r.left_id, r.right_id, r.low, r.high) for r in got.collect()) == [(999, "c0", "c1", 0, 1999), (1999, "c1", "c2", 1000, 2999)]
