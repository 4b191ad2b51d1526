"""Stored tables, and steps that read them once."""

import random

from pyspark.sql import functions as F

import pyarrow as pa

from cueloom.operators import chunks as K
from cueloom.operators import cues as C
from cueloom.operators import words as W
from cueloom.plans import blocks
from cueloom.queries import alignment, views
from cueloom.session import materialize

SF = "/root/testdata/sf0.001"


def test_stored_tables_are_columns_not_serialized_rows(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    out = materialize(df)
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_onsets_do_not_depend_on_the_tiles_of_a_cue(spark, monkeypatch):
    rng = random.Random(5)
    rms = [rng.choice([1.0, 2.0, 3.0, 6.0, 9.0, 400.0 if i % 50 == 0 else 2.0]) for i in range(600)]
    levels = spark.createDataFrame([(1, i, r) for i, r in enumerate(rms)], "media_id long, win long, rms double")
    rows = [(1, f"c{k}", k, k * 0.5, k * 0.5 + 0.3 + k % 5, None) for k in range(24)]
    cues = spark.createDataFrame(
        rows, "media_id long, id string, ordinal long, start double, end double, speaker string"
    )

    def onset(start, end):
        """The rule window by window."""
        i0, i1 = int(start // 0.02), min(len(rms), -int(-end // 0.02))
        level = sorted(rms)[int(len(rms) * 0.2)]
        back = sorted(rms[max(0, i0 - 20) : i0])
        noise = max(level, min(back[int(len(back) * 0.2)] if back else level, level * 1.5 + 3))
        peak = max(rms[i0:i1])
        weak, strong = max(noise * 1.3, peak * 0.0005, 4.0), max(noise * 2, peak * 0.003, 8.0)
        w = [x > weak for x in rms[i0:i1]]
        for j in range(len(w)):
            if rms[i0 + j] > strong and w[j] and sum(w[j : j + 3]) >= 2:
                at = i0 + j
            elif j >= 3 and all(w[j - 3 : j + 1]):
                at = i0 + j - 3
            else:
                continue
            moved = max(start, max(start, at * 0.02) - 0.06)
            return moved if moved > start + 0.005 else start
        return start

    def starts():
        return {r["id"]: round(r["start"], 6) for r in C.refine_onsets(cues, levels).collect()}

    whole = starts()
    assert whole == {r[1]: round(onset(r[3], r[4]), 6) for r in rows}
    assert any(whole[r[1]] != r[3] for r in rows)
    monkeypatch.setattr(C, "TILE", 8)
    assert starts() == whole


def test_lines_are_placed_once_when_read(spark, monkeypatch):
    from cueloom.sources import subtitles as T

    text = "[Script Info]\nDialogue: 0,no event\n[Events]\n" + "\n".join([
        "Dialogue: 0,0:00:01.00,0:00:02.00,Default,ann,0,0,0,,one\\Ntwo",
        "Dialogue: 0,oops",
        "Comment: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,no",
        "dialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,, \\N ",
        "Dialogue: 0,0:00:05.00,0:00:06.00,Default,,0,0,0,,a, b",
    ])
    placements, of = [], T.Ordered.of.__func__
    monkeypatch.setattr(T.Ordered, "of", classmethod(lambda cls, *a, **k: placements.append(1) or of(cls, *a, **k)))
    events, problems = T.read_ass(T.ass_file_lines(spark.createDataFrame([("s", 1, text)], "artifact string, media_id long, content string")))
    assert [(r["pos"], r["start"], r["name"], r["text_lines"]) for r in events.orderBy("pos").collect()] == [
        (1, 1.0, "ann", ["one", "two"]), (2, 5.0, "", ["a, b"]),
    ]
    assert [(r["n"], r["kind"]) for r in problems.orderBy("n").collect()] == [(2, "unparsable"), (3, "empty_text")]
    assert len(placements) == 1


def test_words_are_timed_without_a_shuffle_of_their_own(spark):
    lengths = pa.array([[3, 4], [5], [1, 1, 1]], pa.list_(pa.int64()))
    assert views.running_ends(lengths).to_pylist() == [[3, 7], [5], [1, 2, 3]]
    assert views.running_ends(lengths.slice(1)).to_pylist() == [[5], [1, 2, 3]]
    plan = views.words(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan[: plan.index("Generate")]


def test_segments_place_the_words_once(spark, monkeypatch):
    placed = []

    def of(df, *args, kept=blocks.Ordered.of):
        placed.append("text" in df.columns)
        return kept(df, *args)

    words = spark.createDataFrame(
        [(1, i, i * 0.5, i * 0.5 + 0.4, "ab. " if i % 4 == 3 else "ab ", "s") for i in range(10)],
        "media_id long, ordinal long, start double, end double, text string, speaker string",
    )
    monkeypatch.setattr(blocks.Ordered, "of", of)
    got = W.segment_words(words).select("first_word", "last_word").collect()
    assert sorted(map(tuple, got)) == [(0, 3), (4, 7), (8, 9)]
    assert placed.count(True) == 1


def test_votes_and_members_come_with_the_matches(spark, monkeypatch):
    plan, rows = alignment.chunked_words(spark, SF)
    found, kept = [], K.map_speakers

    def seen(words, matches):
        found.append(matches)
        return kept(words, matches)

    monkeypatch.setattr(K, "map_speakers", seen)
    K.merge_chunks(plan, rows)
    names = found[0].columns
    assert {"speaker", "prev_speaker", "owned", "prev_owned"} <= set(names)
    bare = kept(K._absolute(rows, K._chunk_times(plan)), found[0].select(*names[:4]))
    brought = kept(K._absolute(rows, K._chunk_times(plan)), found[0])
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, brought.collect()))


def test_squeeze_repair_places_no_texts(spark, monkeypatch):
    placed = []

    def of(df, *args, kept=blocks.Ordered.of):
        placed.append(df.columns)
        return kept(df, *args)

    words = spark.createDataFrame(
        [(1, 0, 0.0, 0.5, "ab ", "s"), (1, 1, 0.5, 0.51, "abc ", "s"), (1, 2, 3.0, 3.4, "cd ", "t")],
        "media_id long, ordinal long, start double, end double, text string, speaker string",
    )
    monkeypatch.setattr(blocks.Ordered, "of", of)
    got = {r.ordinal: (r.start, round(r.end, 6)) for r in W.repair_squeezed(words).collect()}
    assert got == {0: (0.0, 0.5), 1: (0.5, 0.68), 2: (3.0, 3.4)}
    assert placed and not any("text" in c for c in placed)
