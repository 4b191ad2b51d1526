"""Streams that keep little and forget: settlement, retention, timers, windows, tables."""

import gc
import pathlib
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cueloom.queries.live import steps
from cueloom.session import scratch_dir
from cueloom.streaming import operators as L
from cueloom.streaming import tables as T
from cueloom.streaming import timed
from cueloom.streaming.run import drain, replay, replay_through
from cueloom.streaming.state import SLICE, ordered_rows
from cueloom.streaming.settlement import EVENTS, Suffix, settle_stream, taken

# --- settlement ---


def event(kind, first_word=None, **rest):
    return {"kind": kind, "id": None, "start": None, "end": None, "speaker": None, "last_word": None, "forced": None,
            "first_word": first_word, **rest}


def recording(seed, n=40, leave=0.0):
    """Words in cues of one to three, some cuts, cues landing out of order, repairs."""
    rng = random.Random(seed)
    t, at, events = 0.0, 0, []
    for k in range(n):
        speaker, first = rng.choice(["1", "2", None]), at
        words = []
        for _ in range(rng.randrange(1, 4)):
            t = max(0.0, t + rng.choice([0.3, 0.5, 1.6, -0.4]))
            words.append((at, round(t, 2)))
            at += 1
        cue = dict(start=words[0][1], end=round(words[-1][1] + 0.2, 2), speaker=speaker, first_word=first, last_word=at - 1)
        events += [(k * 10 + i * 0.1, event("word", o, start=s)) for i, (o, s) in enumerate(words)]
        cut, forced = rng.random() < 0.4, rng.random() < 0.3
        if cut:
            events.append((k * 10 + 5, event("junction", at - 1, forced=forced)))
        land = k * 10 + 6 + rng.choice([0, 10, 10, 120])
        events.append((land, event("cue", id=f"w{k}", **{**cue})))
        if cut and rng.random() >= leave:
            if forced and rng.random() < 0.7:
                events += [(land + 30, event("removed", id=f"w{k}")), (land + 30.1, event("cue", id=f"r{k}", **{**cue}))]
            events.append((land + 200, event("resolved", at - 1)))
    return [e for _, e in sorted(events, key=lambda x: x[0])]


@pytest.mark.parametrize("seed", range(12))
def test_words_taken_together_make_what_they_make_one_by_one(seed):
    rng = random.Random(seed)
    events = recording(seed, 120, leave=0.1 * (seed % 2))
    if seed % 3 == 0:  # some cues land before their words
        events = [e for _, e in sorted(enumerate(events), key=lambda x: x[0] + rng.choice([0, 0, 0, 25]))]
        words = iter(sorted((e for e in events if e["kind"] == "word"), key=lambda e: e["first_word"]))
        events = [next(words) if e["kind"] == "word" else e for e in events]
    events.append(event("closed"))
    one, many = Suffix(None, {}, {}, []), Suffix(None, {}, {}, [])
    want = [m for e in events for m in one.take(e)]
    rows = pd.DataFrame([{**e, "seq": k} for k, e in enumerate(events)])
    whole = "Int64" if seed % 2 else float  # with nulls, whole numbers come as floats
    types = {"first_word": whole, "last_word": whole, "start": float, "end": float}
    got = []
    for begin in range(0, len(rows), 37):
        part = pa.Table.from_pandas(rows[begin : begin + 37].astype(types), preserve_index=False)
        got += [m for _, found in taken(many, part) for m in found]
    assert got == want and (want or seed == 11)
    assert all(type(o) is int for o, _ in many.open_words())
    assert many.open_words() == one.open_words() and many.mark() == one.mark()


def from_scratch(events):
    """What is final, worked out from everything that has happened, all at once."""
    words, cues, cuts, closed = {}, {}, {}, False
    owners = lambda: {o: i for i, (c, _) in sorted(cues.items(), key=lambda x: x[1][1]) for o in range(c["first_word"], c["last_word"] + 1)}
    for n, e in enumerate(events):
        if e["kind"] == "word":
            words[e["first_word"]] = e["start"]
        elif e["kind"] == "cue":
            cues[e["id"]] = (e, n)
        elif e["kind"] == "removed":
            cues.pop(e["id"], None)
        elif e["kind"] == "junction":
            cuts[e["first_word"]] = e["forced"]
        elif e["kind"] == "resolved":
            cuts.pop(e["first_word"], None)
        else:
            closed = True
        owner = owners()
        for j, forced in list(cuts.items()):
            a, b = cues.get(owner.get(j)), cues.get(owner.get(j + 1))
            if a and b and (a is b or not (forced or (a[0]["speaker"] == b[0]["speaker"] and b[0]["start"] - a[0]["end"] < 0.8))):
                del cuts[j]
    owner, total = owners(), len(words)
    reach = next(o for o in range(total + 1) if o not in owner)
    bars = [j for j in cuts if j in owner] + ([reach - 1] if reach and (reach < total or not closed) else [])
    mutable = min([cues[owner[j]][0]["first_word"] for j in bars], default=total)
    frontier = min([s for o, s in words.items() if o >= mutable], default=float("inf")) if bars else float("inf")
    out = []
    for id, (c, _) in sorted(cues.items(), key=lambda x: (x[1][0]["start"], x[1][0]["end"], x[1][0]["speaker"] or "", x[1][1])):
        if not reach or c["last_word"] >= mutable or c["start"] >= frontier:
            break
        out.append((id, str(len(out) + 1)))
    return out


def in_turn(events):
    suffix, out, most = Suffix(None, {}, {}, []), [], 0
    for n, e in enumerate(events):
        out += [x for x in suffix.take(e)]
        if n % 7 == 0:  # what a micro-batch boundary keeps
            most = max(most, len(suffix.cues) + len(suffix.pending) + len(suffix.open_words()))
            suffix = Suffix(suffix.mark(), dict(suffix.pending), dict(suffix.cues), suffix.open_words())
    return out, most


@pytest.mark.parametrize("seed", range(12))
def test_settling_in_turn_equals_settling_from_scratch(seed):
    events = recording(seed, leave=0.1 if seed % 2 else 0.0) + ([event("closed")] if seed % 3 else [])
    got, _ = in_turn(events)
    assert {x["kind"] for x in got} <= {"settled"}
    assert [(x["id"], x["final_id"]) for x in got] == from_scratch(events)


def test_settlement_state_follows_the_open_suffix():
    short, long = in_turn(recording(5, 60))[1], in_turn(recording(5, 600))[1]
    assert long <= short + 20


def test_an_event_looks_only_at_the_cuts_it_touches(monkeypatch):
    """A cut that is never repaired holds everything open; the work an event takes stays small."""
    events = recording(4, 1500, leave=1.0)
    looked, clean = [], Suffix._clean
    monkeypatch.setattr(Suffix, "_clean", lambda *args: looked.append(1) or clean(*args))
    suffix = Suffix(None, {}, {}, [])
    for e in events:
        list(suffix.take(e))
    assert len(suffix.pending) > 100 and len(looked) <= 5 * len(events)


def test_rows_of_one_key_are_objects_a_slice_at_a_time():
    parts = [pd.DataFrame({"seq": range(k, 20000, 4), "text": None if k == 1 else "x", "n": [None if k == 2 else k] * 5000}) for k in (3, 1, 2, 0)]
    rows = ordered_rows(iter(parts), ["seq"])
    first = [next(rows) for _ in range(4)]
    assert [(r["seq"], r["text"], r["n"]) for r in first] == [(0, "x", 0), (1, None, 1), (2, "x", None), (3, "x", 3)]
    assert sum(1 for o in gc.get_objects() if isinstance(o, dict) and "seq" in o and "text" in o) <= SLICE + 4
    assert [r["seq"] for r in rows] == list(range(4, 20000))


def test_a_word_is_compared_with_near_words_only(monkeypatch):
    steps_, looked = [], []
    monkeypatch.setattr(L, "fold_stream", lambda s, key, order, step, schema: steps_.append(step))
    monkeypatch.setattr(L, "norm_key_c", lambda c: c)

    class Key(str):
        __hash__ = str.__hash__

        def __eq__(self, other):
            looked.append(1)
            return str.__eq__(self, other)

    class Words:
        def withColumn(self, *_):  # noqa: N802
            return self

    monkeypatch.setattr(L.F, "col", lambda c: c)
    L.dedup_words_stream(Words())
    state, made = None, []
    for i in range(300):
        state, out = steps_[0](state, {"start": float(i), "end": i + 0.5, "text": "a", "speaker": None, "key": Key("a")})
        made += out
    assert len(made) == 300 and len(looked) <= 300 and len(state[1]) == L.MERGE_LAST


def test_what_comes_too_late_changes_nothing():
    cue = dict(start=0.0, end=0.9, speaker="a", first_word=0, last_word=1)
    events = [event("word", 0, start=0.0), event("word", 1, start=0.5), event("cue", id="w0-1", **cue), event("closed")]
    late = [event("junction", 1, forced=True), event("cue", id="again", **cue), event("removed", id="w0-1")]
    got, _ = in_turn(events + late)
    assert [(x["kind"], x["id"], x["final_id"], x["ordinal"]) for x in got] == [
        ("settled", "w0-1", "1", 0), ("late junction", None, None, 1), ("late cue", "again", None, 0)]


@pytest.mark.parametrize("parts", [1, 8])
def test_settlement_as_a_stream(spark, parts):
    rows, want = [], []
    for media in (1, 2):
        events = recording(media + 40) + [event("closed")] * (media - 1)
        want += [(media, *x) for x in from_scratch(events)]
        rows += [tuple({"media_id": media, "seq": n, **e}[c.split()[0]] for c in EVENTS.split(", ")) for n, e in enumerate(events)]
    df = spark.createDataFrame(rows, EVENTS)
    got = replay_through(*steps(df, parts), settle_stream).collect()
    assert sorted((r.media_id, r.id, r.final_id) for r in got) == sorted(want) and len(got) > 60


# --- retention ---


def heard(spark, minutes):
    rows = [(1, i, "final", float(i * 5), i * 5 + 1.0, f"text {i // 2 % 40 if i % 4 else i}") for i in range(minutes * 12)]
    df = spark.createDataFrame(rows, "media_id long, seq long, kind string, start double, end double, text string")
    return df.withColumn("at", F.timestamp_seconds(F.col("start") + 1_700_000_000))


def test_forgotten_texts_leave_the_state_flat(spark):
    most, sizes = [], []
    for minutes in (4, 40):
        df, sizes = heard(spark, minutes), []
        out, state = scratch_dir(spark, "out"), scratch_dir(spark, "state")
        forgetting = lambda s: L.fold_partials(s.withWatermark("at", "1 second"), "at", keep=20)
        got = replay(*steps(df, 4 if minutes == 4 else 10), lambda s: drain(forgetting(s), out, state, sizes))
        plain = replay_through(*steps(df, 1), L.fold_partials)
        assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in plain.collect())
        most.append(sizes[-1])
    assert most[1] <= most[0] + 2 and most[1] < 20


# --- timers and windows ---


def test_a_feed_that_stops_is_flushed_and_late_feeds_start_at_their_start(spark):
    rows = [(1, 0, "sent", 100.0, 101.0, 0), (1, 1, "sent", 101.0, 103.0, 2), (1, 2, "durable", 101.0, 102.0, 5),
            (2, 0, "sent", 0.0, 24.0, 1), (2, 1, "sent", 24.0, 25.0, 4), (2, 2, "sent", 25.0, 26.0, 40), (2, 3, "sent", 26.0, 27.0, 41)]
    df = spark.createDataFrame(rows, "media_id long, seq long, kind string, start double, end double, t int")
    df = df.withColumn("at", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")
    for parts in (1, 2):
        got = replay_through(df, F.floor(F.col("seq") / 2) if parts == 2 else F.lit(0), parts,
                             lambda s: timed.flush_by_timer(s.withWatermark("at", "0 seconds"), "at")).collect()
        assert sorted((r.media_id, r.commit_at, r.cause, r.at_ms - 1_700_000_000_000) for r in got) == [
            (1, 103.0, "timer", 30000), (2, 25.0, "sent", 4000)]


def test_windows_of_recordings_that_begin_apart(spark):
    rows = [(1, 0, 0.0, 16.0, 7), (2, 1, 0.0, 4.0, 31), (1, 2, 16.0, 46.0, 7), (2, 3, 4.0, 30.0, 31), (1, 4, 46.0, 47.5, 7),
            (None, 5, 0.0, 200.0, 0)]
    df = spark.createDataFrame(rows, "media_id long, seq long, begin double, end double, b int")
    df = df.withColumn("began", F.timestamp_seconds(F.col("b") + 1_700_000_000)).drop("b")
    got = replay_through(*steps(df, 3), timed.windowed_chunks).collect()
    assert sorted((r.media_id, r.n, r.start, r.end) for r in got) == [
        (1, 0, 0.0, 15.0), (1, 1, 10.0, 30.0), (1, 2, 25.0, 45.0), (1, 3, 40.0, 47.5), (2, 0, 0.0, 15.0), (2, 1, 10.0, 30.0)]


# --- tables ---


def test_a_batch_run_again_adds_nothing(spark):
    table = T.CellTable(spark, scratch_dir(spark, "t"), "media_id long, first long, note string", ["media_id"])
    batch = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 0, "c")], table.schema)
    table.append_once(batch, 0, ["media_id", "first"])
    table.append_once(batch, 0, ["media_id", "first"])
    table.append_once(batch.unionByName(spark.createDataFrame([(1, 5, "d")], table.schema)), 1, ["media_id", "first"])
    assert sorted((r.media_id, r.first) for r in table.read().collect()) == [(1, 0), (1, 5), (2, 0)]
    assert table.done("stream", 0) and not table.done("stream", 2)


def test_a_failed_attempt_is_never_read(spark, monkeypatch):
    table = T.CellTable(spark, scratch_dir(spark, "t"), "media_id long, first long", ["media_id"])
    batch = spark.createDataFrame([(1, 0), (2, 7)], table.schema)
    with monkeypatch.context() as m:
        # The data are written, the log is not.
        m.setattr(type(batch), "coalesce", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.append_once(batch, 0, ["media_id", "first"])
    assert table.read().count() == 0
    table.append_once(batch, 0, ["media_id", "first"])
    assert table.read().count() == 2


def test_only_touched_cells_are_read_and_written(spark):
    table = T.CellTable(spark, scratch_dir(spark, "t"), T.PIECES, ["media_id", "cell"])
    take = T.remerge_touched(table, 0.04, 10.0)
    span = lambda *rows: spark.createDataFrame([tuple(map(float, r)) for r in rows], "m double, start double, end double").selectExpr("cast(m as long) media_id", "start", "end")
    take(span((1, 1, 2), (1, 15, 37), (2, 3, 4), (1, 95, 96)), 0)
    take(span((1, 36, 41), (1, 2.03, 3), (1, 8, 7)), 1)
    assert sorted((r.media_id, r.start, r.end) for r in T.merged_spans(table, 0.04).collect()) == [
        (1, 1.0, 3.0), (1, 15.0, 41.0), (1, 95.0, 96.0), (2, 3.0, 4.0)]
    root = pathlib.Path(table.path.removeprefix("file:")) / "data"
    for part in root.rglob("*.parquet"):
        if "cell=3" not in str(part) and "cell=4" not in str(part):
            part.write_bytes(b"unreadable")
    take(span((1, 36.5, 42)), 2)
    near = table.read(T.cut_at_cells(span((1, 36, 41)), 10.0)).collect()
    assert sorted((r.cell, r.start, r.end) for r in near) == [(3, 30.0, 40.0), (4, 40.0, 42.0)]


def test_live_rows_give_way_to_the_final_pass_at_once(spark):
    table = T.CellTable(spark, scratch_dir(spark, "t"), "media_id long, id string, provisional boolean", ["media_id"])
    rows = lambda *x: spark.createDataFrame([(m, i, True) for m, i in x], table.schema)
    table.append_once(rows((1, "a"), (2, "b")), 0, ["media_id", "id"])
    T.settle_recordings(table, rows((1, "z")), 0, lambda live, final: final.unionByName(live))
    table.append_once(rows((1, "c"), (2, "d")), 1, ["media_id", "id"])
    assert sorted((r.media_id, r.id, r.provisional) for r in table.read().collect()) == [
        (1, "a", False), (1, "z", False), (2, "b", True), (2, "d", True)]
