"""Exact top-k search against brute force, and on awkward rows."""

import math
import random

import numpy as np
import pytest

from cueloom.llm import op13_topk

SCHEMA = "vec_id long, embedding array<float>, row string, query int, v int, rank int, copy int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1, 2, 3, 4) for i, e in rows], SCHEMA)


def brute(rows, every, k):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in rows]
    out = []
    for n, (i, q) in enumerate(whole):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(whole) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def answer(df, condition, **parameters):
    return sorted(map(tuple, op13_topk.top_products(df, condition, **parameters).collect()))


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_equals_brute_force(spark, scale):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400 + i, [0.0] * 12) for i in range(9)]
    rows += [(10, rows[3][1]), (20, rows[20][1])]
    want = brute(rows, 10, 5)
    assert answer(frame(spark, rows).repartition(3), "vec_id % 10 = 0", block=50, round_queries=16) == want
    assert answer(frame(spark, rows).repartition(2), "vec_id % 10 = 0", steps=3, few=1) == want


def test_large_scores_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-(1 << 20), 1 << 20)) for _ in range(4)]) for i in range(60)]
    assert answer(frame(spark, rows), "vec_id % 6 = 0", block=7) == brute(rows, 6, 5)


def test_awkward_rows(spark):
    good = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 0.25]), (0, [0.0, 0.0]), (3, [0.001, -0.001])]
    bad = [(4, None), (5, []), (6, [1.0]), (7, [None, 1.0]), (8, [math.nan, 1.0]), (9, [math.inf, 1.0]),
           (None, [1.0, 1.0]), (11, [3e38, 1.0])]
    assert answer(frame(spark, good + bad), "vec_id % 2 = 0") == brute(good, 2, 5)
    assert answer(frame(spark, bad), "vec_id % 2 = 0") == []
    assert answer(frame(spark, [(0, [1.0, 2.0])]), "vec_id % 2 = 0") == []
    assert answer(frame(spark, []), "vec_id % 2 = 0") == []


def test_reading_stops_early_on_a_clear_winner():
    values = np.zeros((4096, 8))
    values[:, 0] = np.arange(4096)
    values[17] = 5000.0
    lists = op13_topk.Lists(values)
    which, place, score, read = op13_topk.search(lists, np.ones((1, 8)), np.array([-1]), np.array([-np.inf]), 1)
    assert place[np.argmax(score)] == 17 and score.max() == 40000 and read[0] <= values.size // 4
