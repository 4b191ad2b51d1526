"""Boundary cases as rows: one recording per case, many cases per Spark job."""

import json
import math

import pytest
from pyspark.sql import functions as F

from cueloom.functions import names, replies, text, times
from cueloom.operators import align, chunks, cues, qa, reconcile, words
from cueloom.queries import QUERIES, SQL
from cueloom.sources import recognition, signals, sinks, subtitles, traces
from cueloom.streaming import operators as live
from cueloom.streaming.settle import renames, settle

CUE = "media_id long, id string, ordinal long, start double, end double, speaker string, timing_confidence double"


def cue_frame(spark, cases):
    rows = [(m, c[0], i, float(c[1]), float(c[2]), c[3] if len(c) > 3 else None, None) for m, case in enumerate(cases) for i, c in enumerate(case)]
    return spark.createDataFrame(rows, CUE)


def spans(spark, cases):
    return spark.createDataFrame(
        [(m, float(a), float(b)) for m, case in enumerate(cases) for a, b in case], "media_id long, start double, end double"
    )


def test_starts_and_ends_follow_speech(spark, either):
    # cues, speech, expected starts, expected ends
    cases = [
        ([("a", 0, 1), ("b", 1, 2.5)], [(0, 0.8), (1.5, 2.3)], [0, 1.5], [0.8, 2.3]),
        ([("a", 0.5, 2)], [(0, 0.2), (0.8, 1.2), (1.5, 1.8)], [0.8], [1.8]),
        ([("a", 0, 1), ("b", 1.1, 3)], [(0, 2), (2.5, 3)], [0, 1.1], [1, 3]),
        ([("a", 0, 1), ("b", 1.2, 3)], [(0, 2), (2.5, 3)], [0, 2.5], [2, 3]),
        ([("a", 0, 2), ("b", 3.8, 4.6)], [(0, 1.6), (2, 2.3), (3.8, 4.5)], [0, 3.8], [2.3, 4.5]),
        ([("a", 0, 2), ("b", 4, 4.8)], [(0, 0.9), (4, 4.7)], [0, 4], [2, 4.7]),
        # Cross-talk keeps its times; the cue after it still moves.
        ([("a", 0, 3, "A"), ("b", 2, 4, "B"), ("c", 4, 6, "A")], [(0, 1), (5, 5.5)], [0, 2, 5], [3, 4, 5.5]),
        # No speech at all: nothing moves and everything is of low confidence.
        ([("a", 1, 2)], [], [1], [2]),
    ]
    got = align.align_to_speech(cue_frame(spark, [c[0] for c in cases]), spans(spark, [c[1] for c in cases]))
    rows = {(r.media_id, r.ordinal): r for r in got.collect()}
    for m, (_, _, starts, ends) in enumerate(cases):
        assert [rows[m, i].start for i in range(len(starts))] == pytest.approx(starts), m
        assert [rows[m, i].end for i in range(len(ends))] == pytest.approx(ends), m
    assert rows[7, 0].low_confidence and rows[7, 0].align_backend == "whisper-vad-unaligned"
    assert rows[0, 1].timing_confidence == 0.9 and rows[2, 1].timing_confidence == 0.75


def test_tokens_crossing_a_silence_move_the_start(spark):
    # token ranges in ms, text, speech, signal spans (None: no signal), start, expected
    cases = [
        ([(1050, 1250)], " source", [(0, 1), (2, 3)], None, (0.5, 2.5), 2),
        ([(1000, 2500)], " source", [(0, 1), (2, 3), (4, 5)], None, (0.5, 4.5), 4),
        ([(1050, 1250)], " source", [(0, 1), (1.319, 3)], None, (0.5, 2.5), 0.5),
        ([(1050, 1250)], " source", [(0, 1), (1.32, 3)], None, (0.5, 2.5), 1.32),
        ([(1050, 1250)], "字", [(0, 1), (1.1, 3)], None, (0.5, 2.5), 1.1),
        ([(950, 1050), (1050, 1300)], "first", [(0, 1), (2, 3)], [(2, 3)], (0.5, 2.5), 2),
        ([(950, 1050), (1050, 1300)], "first", [(0, 1), (2, 3)], [(0.9, 1.2)], (0.5, 2.5), 0.5),
        ([(950, 1050), (1050, 1300)], "first", [(0, 1), (2, 3)], None, (0.5, 2.5), 0.5),
    ]
    rows = []
    for m, (ranges, first, _, _, (s, e), _) in enumerate(cases):
        toks = [{"text": "[_BEG_]", "offsets": {"from": 0, "to": 0}}]
        toks += [{"text": first if i == 0 else "second", "offsets": {"from": a, "to": b}} for i, (a, b) in enumerate(ranges)]
        rows.append((m, "cue", 0, s, e, None, None, json.dumps({"tokens": toks})))
    df = spark.createDataFrame(rows, CUE + ", metadata string")
    df = df.withColumn("lead", align.leading_tokens(recognition.segment_tokens(F.col("metadata"))))
    signal = [(m, float(a), float(b)) for m, c in enumerate(cases) for a, b in c[3] or []]
    activity = spark.createDataFrame(signal, "media_id long, start double, end double")
    got = {r.media_id: r.start for r in align.align_starts(df, spans(spark, [c[2] for c in cases]), activity).collect()}
    assert got == pytest.approx({m: c[5] for m, c in enumerate(cases)})


def test_trim_long_silence_boundary(spark, either):
    cases = [
        ([("id", 1, 50)], [(0, 2), (13, 15), (30, 32), (40, 45)], [37]),
        ([("exact", 0, 20), ("trailing", 20, 50)], [(0, 2), (8, 14), (20, 22)], [0, 20]),
        ([("a", 0, 30, "A"), ("b", 5, 9, "B")], [(0, 1), (20, 21)], [0, 5]),
    ]
    got = align.trim_long_silence(cue_frame(spark, [c[0] for c in cases]), spans(spark, [c[1] for c in cases]))
    rows = {(r.media_id, r.ordinal): r.start for r in got.collect()}
    assert rows == {(m, i): s for m, c in enumerate(cases) for i, s in enumerate(c[2])}


def test_extend_ends_gap_policy(spark, either):
    gaps = [(1.7, 1.7), (1.8, 1.4), (2.0, 1.5), (2.2, 1.5), (0.5, 0.5)]
    cases = [[("a", 0, 1), ("b", s, s + 0.5)] for s, _ in gaps]
    cases.append([("a", 0, 5, "A"), ("b", 3, 6, "B"), ("c", 6.2, 7, "A")])
    got = cues.extend_ends(cue_frame(spark, cases), spark.createDataFrame([(5, 7.2)], "media_id long, duration double"))
    rows = {(r.media_id, r.id): r.end for r in got.collect()}
    assert [rows[m, "a"] for m in range(len(gaps))] == pytest.approx([e for _, e in gaps])
    assert [rows[5, c] for c in "abc"] == [5, 6, 7.2]


def test_plan_chunks_is_strictly_below_the_caps(spark):
    plans = [(5999, 0.0, 1), (6000, 0.0, 2), (6001, 0.0, 2), (19000, 30.0, 6), (19000, 0.0, 4)]
    rows = [(i, f, 100, 2, 60.0, o, 10**9) for i, (f, o, _) in enumerate(plans)]
    rows += [(90, 0, 100, 2, 60.0, 0.0, 10**9), (91, 500, 100, 2, 60.0, 60.0, 10**9), (92, 500, 100, 2, 60.0, 0.0, 46), (93, 50, 100, 2, 60.0, 0.0, 65)]
    media = spark.createDataFrame(rows, "media_id long, frames long, rate int, bytes_per_frame int, max_seconds double, overlap_seconds double, max_bytes long")
    got = {}
    for r in chunks.plan_chunks(media).collect():
        got.setdefault(r.media_id, []).append(r)
    assert [len(got[i]) for i in range(len(plans))] == [n for _, _, n in plans]
    for rs in got.values():
        assert max(r.end_frame for r in rs) == rows[[x[0] for x in rows].index(rs[0].media_id)][1]
        assert all(r.end_frame - r.start_frame < 6000 for r in rs)
    assert all(44 + 2 * (r.end_frame - r.start_frame) < 65 for r in got[93])
    assert {r.media_id for r in chunks.rejected_plans(media).collect()} == {90, 91, 92}


def test_squeezed_run_is_spread_at_the_speakers_pace(spark):
    run = [(10.80, 11.14, "我觉得"), (11.14, 11.40, "这件"), (11.40, 11.64, "东西"), (11.64, 11.65, "事"), (11.65, 11.66, "情"), (11.66, 11.67, "很"), (11.67, 11.68, "重要")]
    rows = [(1, i, s, e, t, "1") for i, (s, e, t) in enumerate(run)] + [(1, 7, 11.75, 12.30, "那个", "2")]
    df = spark.createDataFrame(rows, "media_id long, ordinal int, start double, end double, text string, speaker string")
    got = words.repair_squeezed(df).orderBy("ordinal").collect()
    assert got[3].start == 11.64 and got[6].end == pytest.approx(12.24)
    assert [w.end - w.start for w in got[3:7]] == pytest.approx([0.12, 0.12, 0.12, 0.24])


def test_segments_and_word_items(spark):
    doc = {"transcription": [
        {"timestamps": {"from": "00:00:01,000", "to": "00:00:02,000"}, "text": " hello "},
        {"offsets": {"from": 2500, "to": 4000}, "text": "world"}, {"text": "  "},
    ]}
    seg = {"transcription": [], "segments": [{"start": 5, "end": 7, "text": "x"}, {"start": 9.5, "end": 8, "text": "back"}, {"offsets": {"from": 2500.0}, "text": "float"}]}
    files = spark.createDataFrame([("a", json.dumps(doc)), ("b", json.dumps(seg))], "media_id string, content string")
    got = sorted((r.media_id, r.id, r.start, r.end, r.source) for r in recognition.read_segments(files).collect())
    assert got == [
        ("a", "1", 1.0, 2.0, "hello"), ("a", "2", 2.5, 4.0, "world"),
        ("b", "1", 5.0, 7.0, "x"), ("b", "2", 9.5, 9.5, "back"), ("b", "3", 2500.0, 2500.0, "float"),
    ]
    items = [
        {"type": "spacing", "text": " "}, {"type": "word", "text": "Hello", "start": 1, "end": 2, "speaker_id": "speaker_1"},
        {"type": "spacing", "text": " "}, {"type": "audio_event", "text": "(laughter)"}, {"text": "world", "start": 3, "end": 2.5, "logprob": -0.1},
    ]
    got = recognition.word_parser("spaced")(spark.createDataFrame([("a", json.dumps(items))], "media_id string, content string")).orderBy("ordinal").collect()
    assert [(r.text, r.start, r.end, r.speaker, r.logprob) for r in got] == [("Hello ", 1.0, 2.0, "1", None), ("world", 3.0, 3.0, None, -0.1)]
    with pytest.raises(ValueError):
        recognition.word_parser("other")


def test_phrase_words_rejoin_their_phrase(spark):
    phrase = {"phrases": [{"speaker": 3, "text": "Hello, New  World!", "words": [
        {"text": t, "offsetMilliseconds": i * 100, "durationMilliseconds": 50} for i, t in enumerate(["hello", "new", "xx", " ", "WORLD"])]}]}
    rows = recognition.read_words_phrases(spark.createDataFrame([("m", json.dumps(phrase))], "media_id string, content string")).orderBy("ordinal").collect()
    assert [r.text for r in rows] == ["Hello, ", "New ", "xx  ", "World! "]
    assert rows[3].start == 0.4 and rows[0].speaker == "3"


def test_scalar_boundaries(spark):
    row = spark.range(1)
    pick = lambda *c: list(row.select(*c).first())
    assert pick(*[times.ass_time(F.lit(x)) for x in (1.235, -0.5, 3661.5, 0.125)]) == ["0:00:01.24", "0:00:00.00", "1:01:01.50", "0:00:00.12"]
    assert pick(*[times.parse_ass_time(F.lit(x)) for x in (" 0:00:01.5 ", "0:00:01,235", "0:00:01.245", "x", "1:2:3.04")]) == [1.5, 1.24, 1.24, None, 3723.04]
    assert pick(*[text.norm_lang(F.lit(x)) for x in ("zh-CN", "en_US", "JA", "auto", " ")]) == ["zh", "en", "ja", None, None]
    assert pick(*[text.norm_speaker(F.lit(x)) for x in ("speaker_3", " A ", " ")]) == ["3", "A", None]
    assert pick(*[text.text_weight(F.lit(x)) for x in ("abc", "漢字a", "ｱ", "")]) == [3, 5, 1, 0]
    assert pick(text.norm_key_b(F.lit("Ｓtraße, №1!")), text.norm_key_a(F.lit("  A  ẞ ")), text.norm_key_c(F.lit(" ẞ "))) == ["strasseno1", "a ss", "ss"]
    assert pick(*[text.is_word_cue_id(F.lit(x)) for x in ("w1-2", "w1", "preview-1")]) == [True, False, False]
    assert pick(times.duration(F.lit(10), F.lit(0)), times.duration(F.lit(0), F.lit(5)), times.start_label(F.lit(59.999)), times.start_label(F.lit(3600.0))) == [None, None, "01:00.00", "1:00:00"]
    assert pick(*[times.token_time(F.lit(x)) for x in ("1500", "1.5", '"00:00:02,5"', '"nan"', "true", "null")]) == [1.5, 1.5, 2.5, None, None, None]
    assert pick(*[text.is_url(F.lit(x)) for x in ("HTTPS://a/b", "http:///x", "/a", "ftp://a")]) == [True, False, False, False]


def test_layouts_and_replies(spark):
    row = spark.range(1)
    read = lambda n, s=None, t=None: row.select(names.subtitle_layout(F.lit(n), F.lit(s), F.lit(t)).alias("l")).first().l
    assert tuple(read("a.SOURCE.ass")) == ("source", "a", None, None)
    assert tuple(read("talk.ja-zh-cn.ass", "ja")) == ("bilingual", "talk", "ja", "zh-cn")
    assert tuple(read("talk.ja-zh-cn.ass")) == ("bilingual", "talk", None, None)
    assert tuple(read("talk.en-de.ass", "EN", "xx")) == ("bilingual", "talk", "EN", "de")
    assert read("talk.ass") is None and read("x.y.ass") is None and read(".source.ass") is None
    got = [row.select(replies.extract_json(F.lit(x), True).alias("j")).first().j for x in (
        '{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'so {"a": 1}.', '{"result": "{\\"a\\": 1}"}', '{"a": {"b": 1}, {"a": 1}', "[1]", "none")]
    assert got == ['{"a":1}'] * 5 + [None, None]
    deep = json.dumps({"result": json.dumps({"result": json.dumps({"b": [1], "a": "{"})})})
    odd = [row.select(replies.extract_json(F.lit(x)).alias("j")).first().j for x in (
        deep, '{"a":1} {"b":2}', '{"a": 1, "a": 2}', "", "null", 'x ```\n[{"a": 1}]\n``` {"b": 2}')]
    assert odd == ['{"a":"{","b":[1]}', None, None, None, None, None]


def test_ass_files_parse_and_render(spark, either):
    content = "﻿[Script Info]\r\nDialogue: 0,x\r\n[Events]\r\n" + "\r\n".join([
        "Dialogue: 0,0:00:01.00,0:00:02.5,Default, Ann ,0,0,0,,{b}Hi, you\\Nsecond\\n ",
        "dialogue: 0,0:00:03.00", "Comment: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,no",
        "Dialogue: 0,bad,0:00:02.00,Default,,0,0,0,,text", "Dialogue: 0,0:00:04.00,0:00:05.00,Default,,0,0,0,, \\N ",
        "[Fonts]", "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,outside",
    ])
    files = spark.createDataFrame([("f", 1, content)], "artifact string, media_id long, content string")
    lines = subtitles.ass_file_lines(files)
    events, problems = subtitles.read_ass(lines)
    assert [(r.pos, r.start, r.end, r.name, r.text_lines) for r in events.collect()] == [(1, 1.0, 2.5, "Ann", ["{b}Hi, you", "second"])]
    assert [(r.kind, r.message) for r in problems.orderBy("n").collect()] == [
        ("unparsable", "event 2 has fewer than 10 Dialogue fields"), ("unparsable", "event 3 has an invalid timestamp"),
        ("empty_text", "event 4 has no subtitle text"),
    ]
    cue = subtitles.ass_to_cues(events).first()
    assert (cue.source, cue.translated, cue.speaker) == ("second", "{b}Hi, you", "Ann")
    assert sinks.canonicalize_ass(lines).count() == 0  # a damaged file is left alone
    drawn = sinks.render_ass(events).orderBy("line_no").collect()
    assert drawn[-1].line == "Dialogue: 0,0:00:01.00,0:00:02.50,Default,Ann,0,0,0,,｛b｝Hi, you\\Nsecond"
    assert drawn[11].line.split(",")[2] == "64" and [r.line_no for r in drawn] == list(range(len(drawn)))


def test_canonical_files_are_left_alone(spark):
    ev = [("f", 1, 1, 2.0, 3.0, "", ["b"]), ("f", 1, 2, 1.0, 1.5, "", ["a"]), ("g", 1, 1, 1.0, 1.5, "", ["a"])]
    events = spark.createDataFrame(ev, "artifact string, media_id long, pos long, start double, end double, name string, text_lines array<string>")
    lines = sinks.render_ass(events)
    whole = lines.unionByName(lines.groupBy("artifact", "media_id").agg((F.max("line_no") + 1).alias("line_no"), F.lit("").alias("line")))
    fixed = sinks.canonicalize_ass(whole)
    assert {r.artifact for r in fixed.collect()} == {"f"}
    assert [r.line[-1] for r in fixed.where("line_no > 14").orderBy("line_no").collect()] == ["a", "b"]
    assert [tuple(r) for r in sinks.canonical_play_res(whole).collect()] == [("g", 1, 1920, 1080)]


def test_event_rules(spark):
    def found(*events):
        rows = [("f", 1, i, float(s), float(e), n) for i, (s, e, n) in enumerate(events)]
        df = spark.createDataFrame(rows, "artifact string, media_id long, pos long, start double, end double, name string")
        return sorted((r.pos, r.kind) for r in qa.event_problems(df).collect())

    assert found((0, 5, "A"), (3, 6, "B")) == []
    assert found((0, 5, "A"), (3, 6, "A")) == [(1, "overlap")]
    assert found((0, 5, ""), (3, 6, "A")) == [(1, "overlap")]
    assert found((0, 9, "A"), (1, 2, "B"), (3, 4, "A")) == [(2, "overlap")]
    assert found((5, 4, "A"), (1, 2, "B")) == [(0, "end_before_start"), (1, "out_of_order")]


def test_stored_cue_semantics(spark):
    s = "media_id long, id string, ordinal long, start double, end double, source string, translated string, speaker string, stable boolean"
    base = spark.createDataFrame([(1, "1", 0, 0.0, 1.0, "a", "A", None, True), (1, "2", 5, 1.0, 2.0, "b", None, None, True)], s)
    delta = spark.createDataFrame(
        [(1, "2", 0, 1.5, 2.0, "b2", None, "S", True), (1, "9", 1, 3.0, 4.0, "n", "N", None, True), (1, "1", 2, 0.5, 1.0, "a2", None, "T", False)],
        s.replace("ordinal", "seq"),
    )
    got = {r.id: r for r in reconcile.upsert_cues(base, delta).collect()}
    assert [(got[i].ordinal, got[i].source, got[i].translated) for i in ("1", "2", "9")] == [(0, "a2", "A"), (5, "b2", None), (7, "n", "N")]
    got = {(r.id, r.stable): r for r in reconcile.replace_transcript(base, delta.where("id <> '2'")).collect()}
    assert (got["1", True].source, got["1", True].translated, got["1", True].start, got["1", True].speaker) == ("a", "A", 0.5, "T")
    assert got["2", False].ordinal == 1000005 and got["9", True].ordinal == 0


def test_settlement_holds_back_and_settles(spark):
    def run(landed, words_, cuts=(), closed=True):
        cues_ = spark.createDataFrame([(1, f"w{a}-{b}", i, s, e, sp, a, b) for i, (a, b, s, e, sp) in enumerate(landed)], "media_id long, id string, landed long, start double, end double, speaker string, first_word int, last_word int")
        w = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(words_)], "media_id long, ordinal int, start double")
        j = spark.createDataFrame([(1, o, f) for o, f in cuts], "media_id long, ordinal int, forced boolean")
        ended = w.select("media_id").distinct() if closed else w.select("media_id").where("1 = 0")
        out = settle(cues_, j, w, ended)
        return {r.id: r.final_id for r in out.collect()}, {r.new_id for r in renames(out).collect()}

    two = [(0, 1, 0.0, 0.9, "1"), (2, 3, 2.0, 2.9, "1")]
    times_ = [0.0, 0.5, 2.0, 2.5]
    assert run(two, times_, closed=False) == ({"w0-1": "1"}, {"1"})
    assert run(two, times_)[0] == {"w0-1": "1", "w2-3": "2"}
    assert run(two[:1], times_, [(1, False)])[0] == {}  # the other side has not landed
    assert run(two, times_, [(1, False)])[0] == {"w0-1": "1", "w2-3": "2"}  # clean on arrival
    assert run(two, times_, [(1, True)])[0] == {}  # a forced cut waits for its repair
    # A later word that starts earlier holds back the cue before it.
    assert run(two[:1], [0.0, 0.5, -0.0, 2.5])[0] == {}


def test_traces_and_levels(spark):
    lines = [
        {"type": "item.completed", "item": {"type": "agent_message", "id": 1, "text": '{"cues": []}'}},
        {"type": "item.completed", "item": {"type": "command_execution", "command": "ls", "exit_code": 2, "output": "x" * 3000}},
        {"type": "turn.failed", "error": {"message": "no"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "row long, line string")
    got = {r.row: r for r in traces.normalize_traces(df, "items").collect()}
    assert set(got) == {1, 2} and got[1].message == "Run ls · exit 2" and len(got[1].detail) == 3000
    cut = df.select(traces.shortened(F.repeat(F.lit("x"), F.lit(3000))).alias("s")).first().s
    assert len(cut) == 2002 and cut.endswith("\n…")
    assert (got[2].kind, got[2].message) == ("error", "message: no")
    block = lambda role, *content, **more: {"type": role, "message": {"content": list(content)}, **more}
    told = [
        block("assistant", "loose", {"type": "text", "text": " hi "}, {"type": "text", "text": ""},
              {"type": "tool_use", "id": 7, "input": {"b": {"z": [1, "{}"], "y": None}, "a": '{"k": 1}'}}),
        block("user", {"type": "tool_result", "id": "q", "content": [{"text": "one"}, "two"]}),
        block("system", error={"code": 5}), [1], {"type": "assistant", "message": "no"},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(told)] + [(9, "{"), (10, None)], "row long, line string")
    got = [tuple(r) for r in traces.normalize_traces(df, "blocks").orderBy("row", "n").collect()]
    assert got == [
        (0, 0, "agent_message", "hi", None, None),
        (0, 1, "tool_start", "Call tool", "7", 'b: z: - 1\n- {}\ny:\na: {"k": 1}'),
        (1, 0, "tool_result", "Tool result", "q", "- text: one\n- two"),
        (2, 0, "error", "code: 5", None, None),
    ]
    said = [
        {"type": "result", "status": "error", "error": {"message": " bad "}}, {"type": "result", "status": "error", "error": {}},
        {"type": "result", "status": "error", "error": "worse"}, {"type": "result", "status": "success"}, {"type": "error"},
        {"type": "tool_result", "tool_id": "t", "output": ["a", True]}, {"type": "tool_result", "status": "error", "error": {"message": "no"}},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(said)], "row long, line string")
    got = [tuple(r) for r in traces.normalize_traces(df, "stream").drop("n").orderBy("row").collect()]
    assert got == [
        (0, "error", "bad", None, None), (2, "error", "worse", None, None), (4, "error", "Gemini error", None, None),
        (5, "tool_result", "Tool result", "t", "- a\n- true"), (6, "tool_result", "Tool error", None, "no"),
    ]
    samples = spark.createDataFrame([(1, i, v, 100) for i, v in enumerate([3, 4, 5, 0, 7])], "media_id long, i long, sample int, rate int")
    rms = [r.rms for r in signals.rms_levels(samples).orderBy("win").collect()]
    assert rms == pytest.approx([math.sqrt(12.5), math.sqrt(12.5), 7.0])


def test_live_windows_of_a_finished_recording(spark):
    got = live.chunk_windows(spark.createDataFrame([(1, 31.0), (2, 30.0), (3, 4.0)], "media_id long, duration double"))
    rows = sorted((r.media_id, r.start, r.end) for r in got.collect())
    assert rows == [(1, 0.0, 15.0), (1, 10.0, 30.0), (1, 25.0, 31.0), (2, 0.0, 15.0), (2, 10.0, 30.0), (3, 0.0, 4.0)]


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 120


def test_retired_ordinals_move_by_a_fixed_amount(spark):
    new = spark.range(1000002).select(
        F.lit(1).cast("long").alias("media_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.col("id").alias("seq"), F.lit(0.0).alias("start"),
        F.lit(1.0).alias("end"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("translated"), F.lit(None).cast("string").alias("speaker"), F.lit(True).alias("stable"))
    old = new.limit(1).withColumnRenamed("seq", "ordinal").withColumns({"id": F.lit("gone"), "ordinal": F.lit(5).cast("long")})
    for replace in (reconcile.replace_transcript, reconcile.promote_authoritative):
        assert [r.ordinal for r in replace(old, new).where("id = 'gone'").collect()] == [1000005]


def test_canonical_files_keep_equal_events_in_order(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, f"2024-01-01 00:{i % 3:02d}:00", 3, "click" if i % 2 else "view", 1.0, f"p{i}") for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.to_timestamp_ntz("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.line_no, r.line) for r in QUERIES["canonicalize_ass"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(f"select line_no, line from ({SQL['canonicalize_ass']})").fetchall())


def test_files_are_read_inside_their_rows(spark):
    """Null items and fields, spacings first and in a row, files without words; no shuffle."""
    spaced = [None, {"type": "spacing", "text": "-"}, {"type": "audio_event", "text": "(x)"}, {"type": "spacing"}, {"type": "spacing", "text": " "},
              {"type": "word", "start": 1.0}, {"text": "b", "start": 2.0, "end": 3.0}]
    files = spark.createDataFrame(
        [("a", json.dumps(spaced)), ("b", json.dumps([{"type": "spacing", "text": " "}])), ("c", None), ("d", "[]"), ("e", json.dumps(spaced[5:]))],
        "media_id string, content string")
    words = recognition.read_words_spaced(files)
    got = sorted((r.media_id, r.ordinal, r.text, r.start, r.end) for r in words.collect())
    assert got == [("a", 0, "- ", 0.0, 0.0), ("a", 1, "", 1.0, 1.0), ("a", 2, "b", 2.0, 3.0), ("e", 0, "", 1.0, 1.0), ("e", 1, "b", 2.0, 3.0)]
    w = {"text": "a", "punctuation": ".", "begin_time": 1000, "end_time": 2000}
    doc = {"transcripts": [None, {"sentences": None}, {"sentences": [
        {"speaker_id": "x", "words": [w, {"text": " "}, None]}, {"words": None}, None, {"speaker_id": "y", "words": [{"punctuation": "!"}]}]}]}
    sentences = recognition.read_words_sentences(spark.createDataFrame([("a", json.dumps(doc)), ("b", "{}"), ("c", None)], "media_id string, content string"))
    got = [(r.media_id, r.ordinal, r.start, r.end, r.text, r.speaker) for r in sentences.collect()]
    assert got == [("a", 0, 1.0, 2.0, "a.", "x"), ("a", 1, None, None, "!", "y")]
    segments = recognition.read_segments(files)
    for frame in (words, sentences, segments):
        assert "Exchange" not in frame._jdf.queryExecution().toString()
        assert "Window" not in frame._jdf.queryExecution().toString()


def test_settling_places_no_texts(spark, monkeypatch):
    """The later landing owns a word, a range may pass the known words, a gap holds the rest."""
    from cueloom.streaming import settle as module

    placed, of = [], module.Ordered.of
    monkeypatch.setattr(module.Ordered, "of", lambda df, *a: placed.append(df.columns) or of(df, *a))
    spec = "media_id long, id string, landed long, start double, end double, speaker string, first_word int, last_word int, source string"
    cues_ = spark.createDataFrame([
        (1, "a", 0, 0.0, 2.0, "x", 0, 1, "t"), (1, "b", 1, 5.0, 6.0, "y", 2, 3, "t"), (1, "c", 2, 7.0, 9.0, None, 4, 9, "t"),
        (2, "a", 0, 0.0, 2.0, "x", 0, 1, "t"), (2, "b", 1, 2.1, 3.0, "x", 1, 2, "t"), (2, "bad", 2, 0.0, 1.0, "x", 3, 2, "t"),
        (3, "a", 0, 0.0, 1.0, "x", 0, 0, "t"), (3, "b", 1, 9.0, 9.5, "x", 2, 2, "t"),
    ], spec)
    words_ = spark.createDataFrame([(m, i, float(i)) for m, n in ((1, 6), (2, 3), (3, 3)) for i in range(n)], "media_id long, ordinal int, start double")
    cuts = spark.createDataFrame([(1, 1, False), (2, 0, True), (2, 1, False)], "media_id long, ordinal int, forced boolean")
    got = sorted((r.media_id, r.id, r.final_id) for r in settle(cues_, cuts, words_).collect())
    # 1: c ends past the known words; 2: the forced cut holds all; 3: a is the last cue before a gap.
    assert got == [(1, "a", "1"), (1, "b", "2")]
    assert placed == [["media_id", "id", "start", "end", "__s", "landed", "last_word"]]


def test_words_read_several_times_are_stored_once(spark):
    from cueloom.queries.tables import word_batches

    words_ = word_batches(spark, "/root/testdata/sf0.001")[1]
    assert "ArrowEvalPython" not in words_._jdf.queryExecution().toString()
