"""Words to accepted cues: retries of rejected batches only, and going on after a crash."""

import pytest

from cueloom.operators import batches as B
from cueloom.session import scratch_dir

SCHEMA = "media_id long, batch long, ordinal int, start double, end double, text string, speaker string"


def words(spark, n=4):
    return spark.createDataFrame(
        [(1, b, b * 3 + i, b * 3.0 + i, b * 3.0 + i + 0.5, f"w{i} ", "a") for b in range(n) for i in range(3)], SCHEMA)


def user_functions():
    """Made here, so that workers get them by value."""

    def reply(asked, last=None, translated="ok", source="s"):
        o = [w["ordinal"] for w in asked["words"]]
        return {"cues": [{"first_word": o[0], "last_word": o[-1] if last is None else last, "source": source, "translated": translated}]}

    def stubborn(asked):
        """Batch 0 is good, 1 errs once, 2 never answers, 3 errs until told."""
        batch, errors = asked["words"][0]["ordinal"] // 3, asked.get("errors")
        if batch == 2:
            raise TimeoutError("gone")
        if batch == 1 and errors is None:
            return reply(asked, last=99)
        if batch == 3 and not (errors and "translation" in errors[0]):
            return reply(asked, translated="")
        return reply(asked)

    def good(asked):
        assert asked["words"][0]["ordinal"] > 2, "a complete batch was asked again"
        return reply(asked)

    def long(asked):
        return reply(asked, source="x" * 90)

    return stubborn, good, long


stubborn, good, long = user_functions()


def test_only_rejected_batches_go_round(spark):
    cues, log = B.run_word_batches(words(spark), stubborn, scratch_dir(spark, "round"))
    assert sorted((r.batch, r.attempt, r.id, r.start, r.end) for r in cues.collect()) == [
        (0, 1, "w0-2", 0.0, 2.5), (1, 2, "w3-5", 3.0, 5.5), (3, 2, "w9-11", 9.0, 11.5)]
    rows = sorted((r.batch, r.attempt, r.status) for r in log.collect())
    assert rows == sorted(
        [(0, 1, "running"), (0, 1, "complete"), (1, 1, "running"), (1, 1, "failed"), (1, 2, "running"), (1, 2, "complete"),
         (3, 1, "running"), (3, 1, "failed"), (3, 2, "running"), (3, 2, "complete")]
        + [(2, n, s) for n in (1, 2, 3) for s in ("running", "failed")])
    assert "TimeoutError: gone" in log.where("batch = 2 and status = 'failed'").first()["errors"]


def test_a_crash_leaves_running_rows_and_is_taken_up(spark, monkeypatch):
    folder, calls = scratch_dir(spark, "round"), []
    whole = B.validate_responses

    def lost(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return whole(*args, **kwargs)

    monkeypatch.setattr(B, "validate_responses", lost)
    with pytest.raises(RuntimeError):
        B.run_word_batches(words(spark), stubborn, folder, attempts=4)
    log = spark.read.parquet(f"{folder}/log")
    assert sorted((r.batch, r.attempt) for r in log.where("status = 'running'").collect()) == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert log.where("attempt = 2 and status <> 'running'").isEmpty()

    cues, log = B.run_word_batches(words(spark), good, folder, attempts=4)
    assert sorted((r.batch, r.attempt) for r in cues.collect()) == [(0, 1), (1, 3), (2, 3), (3, 3)]


def test_soft_limits_bind_until_the_last_attempt(spark):
    wide = words(spark, 1).replace("w0 ", "w" * 90)
    cues, log = B.run_word_batches(wide, long, scratch_dir(spark, "round"), attempts=2, max_seconds=2.0)
    assert [(r.batch, r.attempt) for r in cues.collect()] == [(0, 2)]
    assert log.where("status = 'failed'").count() == 1


def test_no_words(spark):
    cues, log = B.run_word_batches(words(spark, 0), stubborn, scratch_dir(spark, "round"))
    assert cues.count() == 0 and log.count() == 0


def test_replies_are_checked_without_broadcast(spark, tmp_path):
    words(spark).write.parquet(f"{tmp_path}/words")
    spark.createDataFrame([(1, b, 0, b * 3, b * 3 + 2, "s", "ok" if b else " ") for b in range(4)],
                          "media_id long, batch long, pos int, first_word int, last_word int, source string, translated string").write.parquet(f"{tmp_path}/items")
    found, errors, _ = B.validate_responses(spark.read.parquet(f"{tmp_path}/items"), spark.read.parquet(f"{tmp_path}/words"))
    for df in (found, errors):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.batch, r.id) for r in found.collect()) == [(1, "w3-5"), (2, "w6-8"), (3, "w9-11")]
    assert [(r.batch, r.message) for r in errors.collect()] == [(0, "cue 0–2 has an empty translation")]
