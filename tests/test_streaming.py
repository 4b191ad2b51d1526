"""Streams replayed in one, two and four steps, with a restart between steps."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.queries.live import steps
from cueloom.streaming import operators as L
from cueloom.streaming.run import replay_through


def run(spark, rows, schema, operator, parts):
    df = spark.createDataFrame(rows, schema)
    return replay_through(*steps(df, parts), operator).collect()


def words(seed, n=150):
    rng = random.Random(seed)
    out, t = [], 0.0
    for i in range(n):
        t = max(0.0, t + rng.choice([0.1, 0.2, 0.9, -0.3]))
        out.append((1, i, round(t, 2), round(t + 0.3, 2), rng.choice(["a ", "B ", "b", "Straße", "STRASSE"]), None))
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_dedup_words(spark, parts):
    rows = words(1)
    got = run(spark, rows, "media_id long, seq long, start double, end double, text string, speaker string", L.dedup_words_stream, parts)
    kept = []
    for _, _, s, e, text, _ in rows:
        key = text.strip().casefold()
        if any(k == key and abs(x - s) <= 0.6 for x, _, k in kept[-80:]) or (kept and s < kept[-1][0]):
            continue
        kept.append((s, e, key))
    assert sorted((r.ordinal, r.start, r.text.strip().casefold()) for r in got) == [(i, s, k) for i, (s, _, k) in enumerate(kept)]


def test_the_known_overlap_cases(spark):
    rows = [(1, 0, 0.0, 0.5, "one ", None), (1, 1, 0.6, 1.0, "two ", None), (1, 2, 0.65, 1.05, "two ", None), (1, 3, 1.2, 1.6, "three", None),
            (2, 0, 0.0, 0.5, "one ", None), (2, 1, 2.0, 2.5, "three", None), (2, 2, 1.0, 1.5, "two ", None)]
    got = run(spark, rows, "media_id long, seq long, start double, end double, text string, speaker string", L.dedup_words_stream, 2)
    assert sorted((r.media_id, r.ordinal, r.text) for r in got) == [(1, 0, "one "), (1, 1, "two "), (1, 2, "three"), (2, 0, "one "), (2, 1, "three")]


@pytest.mark.parametrize("parts", [1, 4])
def test_dispatch_never_repeats_a_word(spark, parts):
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(200):
        t += rng.choice([0.3, 0.3, 0.3, 1.4])
        rows.append((1, i, i, round(t, 2), round(t + 0.3, 2)))
    got = sorted((r.first_ordinal, r.last_ordinal) for r in run(
        spark, rows, "media_id long, ordinal long, seq long, start double, end double", lambda s: L.dispatch_stream(s, 10), parts))
    assert len(got) > 5 and all(b[0] > a[1] for a, b in zip(got, got[1:]))
    assert all(10 <= b - a + 1 <= 20 for a, b in got)
    # Unless forced, a batch ends where everyone pauses; words passed over are few.
    ends = {i for i in range(199) if rows[i + 1][3] - rows[i][4] >= 0.8}
    assert all(b in ends or b - a + 1 == 20 for a, b in got)
    assert all(b[0] - a[1] - 1 < 10 for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("parts", [1, 3])
def test_feeds_and_flushes(spark, parts):
    rng = random.Random(4)
    ends, t = [], 0.0
    for _ in range(60):
        t += rng.choice([0.2, 0.6, 1.5, 9.0])
        ends.append(round(t, 2))
    rows = [(1, i, e) for i, e in enumerate(ends)]
    got = sorted((r.start, r.end) for r in run(spark, rows, "media_id long, seq long, end double", L.continuous_feed, parts))
    done, want = 0.0, []
    for e in ends:
        if e >= done + 1.0:
            want.append((max(0.0, done - 1.0), e))
            done = e
    assert got == sorted(want)
    marked = [(1, i, "durable" if i % 7 == 6 else "sent", e) for i, e in enumerate(ends)]
    got = sorted(r.commit_at for r in run(spark, marked, "media_id long, seq long, kind string, end double", L.forced_flush, parts))
    floor, want = 0.0, []
    for _, _, kind, e in marked:
        if kind == "durable":
            floor = max(floor, e)
        elif e - floor >= 25.0:
            want.append(e)
            floor = e
    assert got == want and want


def test_partials_are_replaced_and_finals_stay(spark):
    rows = [(1, i, k, float(s), s + 0.1, x) for i, (k, s, x) in enumerate([
        ("partial", 0, "pre"), ("partial", 0, "preview"), ("final", 0, "hello"), ("nomatch", 1, None), ("final", 1, "HELLO"),
        ("final", 9, "hello"), ("partial", 10, "ta"), ("final", 10, "tail"), ("closed", 11, None)])]
    schema = "media_id long, seq long, kind string, start double, end double, text string"
    finals = spark.createDataFrame(run(spark, rows, schema, L.fold_partials, 3), "media_id long, seq long, kind string, start double, end double, text string")
    assert [(r.id, r.text) for r in L.number_finals(finals).orderBy("start").collect()] == [("1", "hello"), ("2", "hello"), ("3", "tail")]
    shown = sorted((r.seq, r.kind, r.text) for r in run(spark, rows, schema, L.current_partial, 3))
    assert shown == [(0, "partial", "pre"), (1, "partial", "preview"), (2, "partial", None), (6, "partial", "ta"), (7, "partial", None), (8, "ended", "closed")]


def test_retained_and_resume(spark):
    buffer = spark.createDataFrame([(1, float(i), i + 1.0) for i in range(100)], "media_id long, start double, end double")
    marks = spark.createDataFrame([(1, 50.0, 100.0)], "media_id long, durable_end double, fed_end double")
    assert L.retained(buffer, marks).agg(F.min("end")).first()[0] == 46.0
    w = spark.createDataFrame([(1, 0, 3.0), (1, 1, 20.0), (2, 0, 2.0)], "media_id long, ordinal long, end double")
    assert sorted(map(tuple, L.resume_offset(w).collect())) == [(1, 15.0), (2, 0.0)]
