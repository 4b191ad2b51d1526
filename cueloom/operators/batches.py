"""User functions over batches, and checking what they return."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import strip, text_weight, word_cue_id
from cueloom.functions.times import ass_time
from cueloom.session import materialize, spread

CUE_REPLY = "struct<cues: array<struct<id: string, source: string, translated: string>>>"
WORD_REPLY = (
    "struct<cues: array<struct<first_word: int, last_word: int, source: string, translated: string>>>"
)


def map_batches(batches: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Run ``fn`` over each row's JSON ``payload``; adds reply (parsed) and error.

    ``fn`` takes and returns a dict and may raise. A column ``errors`` (what was wrong with
    the last reply) joins the payload. Rows stream through in Arrow batches.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields)

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies, errors = [], []
            feedback = part["errors"] if "errors" in part else [None] * len(part)
            for payload, wrong in zip(part["payload"], feedback):
                try:
                    asked = json.loads(payload)
                    if wrong is not None:
                        asked["errors"] = list(wrong)
                    replies.append(json.dumps(fn(asked), ensure_ascii=False))
                    errors.append(None)
                except Exception as exc:  # the caller's code: its failure is a row's outcome
                    replies.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield part.assign(__reply=replies, error=errors)

    raw = batches.mapInPandas(call, f"{columns}, __reply string, error string")
    return raw.withColumn("reply", F.from_json("__reply", schema)).drop("__reply")


def cue_payload(
    batches: DataFrame, cues: DataFrame, source_language: Column, target_language: Column
) -> DataFrame:
    """JSON payload of each batch of :func:`fixed_batches` or :func:`missing_cue_batches`."""
    item = F.struct("id", "source", "translated", "speaker")
    rows = None
    for role in ("preceding", "ids", "following"):
        part = batches.select(
            "media_id", F.col("ids")[0].alias("head"), F.lit(role).alias("role"),
            F.posexplode(role).alias("n", "id"),
        )
        rows = part if rows is None else rows.unionByName(part)
    filled = rows.join(cues.select("media_id", "id", item.alias("item")), ["media_id", "id"])

    def ordered(role):
        hit = F.when(F.col("role") == role, F.struct("n", "item"))
        return F.transform(F.sort_array(F.collect_list(hit)), lambda x: x["item"])

    lists = filled.groupBy("media_id", "head").agg(
        ordered("preceding").alias("preceding_context"),
        ordered("following").alias("following_context"),
        ordered("ids").alias("cues"),
    )
    payload = F.to_json(
        F.struct(
            source_language.alias("source_language"), target_language.alias("target_language"),
            "preceding_context", "following_context", "cues",
        )
    )
    return lists.select("media_id", "head", payload.alias("payload"))


def validate_responses(
    items: DataFrame,
    batch_words: DataFrame,
    max_seconds: float = 8.0,
    max_chars: int = 84,
    accept_overruns: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cues derived from word intervals, the batch's errors, and soft-limit overruns.

    ``items``: media_id, batch, pos, first_word, last_word, source, translated.
    ``batch_words``: media_id, batch, ordinal, start, end, text, speaker.
    A batch is accepted when it has no error (and no overrun unless they are accepted).
    """
    key = ["media_id", "batch"]
    w = batch_words.select(*key, "ordinal", "start", "end", "speaker")
    first = w.select(
        *key, F.col("ordinal").alias("first_word"), F.col("speaker").alias("s1"), F.lit(True).alias("in1")
    )
    last = w.select(
        *key, F.col("ordinal").alias("last_word"), F.col("speaker").alias("s2"), F.lit(True).alias("in2")
    )
    located = items.join(spread(first), [*key, "first_word"], "left").join(spread(last), [*key, "last_word"], "left")
    label = F.concat(
        F.lit("cue "), F.col("first_word").cast("string"), F.lit("–"), F.col("last_word").cast("string")
    )
    fault = (
        F.when(
            F.col("first_word").isNull() | F.col("last_word").isNull(),
            F.lit("a cue is missing integer first_word/last_word"),
        )
        .when(
            F.col("in1").isNull() | F.col("in2").isNull(),
            F.concat(label, F.lit(" references words outside this batch")),
        )
        .when(F.col("last_word") < F.col("first_word"), F.concat(label, F.lit(" ends before it starts")))
        .when(
            ~F.col("s1").eqNullSafe(F.col("s2")),
            F.concat(label, F.lit(" starts and ends with different speakers")),
        )
    )
    # Each of the three results reads the judged claims: they are worked out once.
    judged = materialize(located.withColumns({"label": label, "fault": fault}))
    sound = judged.where("fault is null").withColumn("speaker", F.col("s1"))
    # Both ends of a claim are words of its speaker, so two claims share a word exactly when
    # their ranges meet. A rejected claim claims nothing, hence the ordered fold; a group
    # holds the claims of one reply.
    claim = F.struct(
        F.col("pos").alias("pos"), F.col("first_word").alias("f"), F.col("last_word").alias("l")
    )
    taken = F.aggregate(
        F.sort_array(F.collect_list(claim)),
        F.slice(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("f"), F.lit(0).alias("l"))), 1, 0),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (y["f"] <= x["l"]) & (x["f"] <= y["l"])), acc
        ).otherwise(F.concat(acc, F.array(F.struct(
            x["pos"].cast("long").alias("pos"), x["f"].cast("int").alias("f"), x["l"].cast("int").alias("l")
        )))),
    )
    kept = (
        sound.groupBy(*key, "speaker").agg(taken.alias("kept"))
        .select(*key, F.explode("kept").alias("k"))
        .select(*key, F.col("k.pos").alias("pos"), F.lit(True).alias("__kept"))
    )
    decided = materialize(sound.join(spread(kept), [*key, "pos"], "left"))
    doubled = decided.where("__kept is null").select(
        *key, "pos",
        F.concat("label", F.lit(" claims words already covered by another cue of its speaker")).alias("message"),
    )
    claims = decided.where("__kept")
    words_of = spread(claims.select(
        *key, "pos", "speaker", F.explode(F.sequence("first_word", "last_word")).alias("ordinal")
    )).alias("c").join(
        w.alias("w"),
        (F.col("c.media_id") == F.col("w.media_id"))
        & (F.col("c.batch") == F.col("w.batch"))
        & (F.col("c.ordinal") == F.col("w.ordinal"))
        & F.col("c.speaker").eqNullSafe(F.col("w.speaker")),
    ).select("c.media_id", "c.batch", "c.pos", "c.ordinal", "w.start", "w.end")
    times = words_of.groupBy(*key, "pos").agg(
        F.min_by("start", "ordinal").alias("start"),
        F.greatest(F.min_by("start", "ordinal"), F.max("end")).alias("end"),
    )
    cues = materialize(claims.join(spread(times), [*key, "pos"]).select(
        *key, "pos", "label", word_cue_id(F.col("first_word"), F.col("last_word")).alias("id"),
        "start", "end", strip(F.coalesce("source", F.lit(""))).alias("source"),
        strip(F.coalesce("translated", F.lit(""))).alias("translated"), "speaker",
        "first_word", "last_word",
    ))
    blank = cues.select(
        *key, "pos",
        F.explode(F.filter(
            F.array(
                F.when(F.col("source") == "", F.concat("label", F.lit(" must include a nonempty source string"))),
                F.when(F.col("translated") == "", F.concat("label", F.lit(" has an empty translation"))),
            ),
            lambda x: x.isNotNull(),
        )).alias("message"),
    )
    # Claims of a speaker make all of the speaker's words in the batch required.
    speakers = claims.select(*key, F.coalesce("speaker", F.lit("")).alias("s"), F.col("speaker").isNull().alias("u")).distinct()
    keyed = w.withColumns({"s": F.coalesce("speaker", F.lit("")), "u": F.col("speaker").isNull()})
    missing = (
        keyed.join(spread(speakers), [*key, "s", "u"], "left_semi")
        .join(spread(words_of.select(*key, "ordinal")), [*key, "ordinal"], "left_anti")
        .groupBy(*key, "s", "u")
        .agg(F.sort_array(F.collect_list("ordinal")).alias("o"))
        .select(
            *key, F.lit(None).cast("long").alias("pos"),
            F.concat(
                F.lit("words of speaker "), F.when(F.col("u"), "None").otherwise(F.col("s")),
                F.lit(" are not covered by any cue: "),
                F.array_join(F.slice("o", 1, 10).cast("array<string>"), ", "),
            ).alias("message"),
        )
    )
    silent = (
        keyed.select(*key, "s", "u").distinct()
        .join(spread(speakers), [*key, "s", "u"], "left_anti")
        .join(spread(items.select(*key).distinct()), key, "left_semi")
        .select(
            *key, F.lit(None).cast("long").alias("pos"),
            F.concat(F.lit("no cue covers any words of speaker "), F.col("s")).alias("message"),
        )
    )
    unanswered = (
        w.select(*key).distinct().join(spread(items.select(*key).distinct()), key, "left_anti")
        .select(*key, F.lit(None).cast("long").alias("pos"), F.lit("response carries no cues").alias("message"))
    )
    errors = judged.where("fault is not null").select(
        *key, F.col("pos").cast("long").alias("pos"), F.col("fault").alias("message")
    )
    for more in (doubled, blank, missing, silent, unanswered):
        errors = errors.unionByName(more.select(*key, F.col("pos").cast("long").alias("pos"), "message"))
    seconds = F.col("end") - F.col("start")
    ws, wt = text_weight(F.col("source")), text_weight(F.col("translated"))
    at = F.concat("label", F.lit(" at "), ass_time(F.col("start")))

    def wide(name, weight):
        return F.when(
            (weight > max_chars) & (2 * seconds >= max_seconds),
            F.concat(at, F.lit(f" {name} weighs "), weight.cast("string"), F.lit(f", above the {max_chars} limit")),
        )

    overruns = cues.select(
        *key, "pos",
        F.explode(F.filter(
            F.array(
                F.when(
                    (seconds > max_seconds) & (2 * F.greatest(ws, wt) >= max_chars),
                    F.concat(at, F.format_string(" spans %.2fs", seconds), F.lit(f", above the {max_seconds:g}s limit")),
                ),
                wide("source", ws),
                wide("translation", wt),
            ),
            lambda x: x.isNotNull(),
        )).alias("message"),
    )
    rejected = errors.select(*key)
    if not accept_overruns:
        rejected = rejected.unionByName(overruns.select(*key))
    accepted = cues.drop("label").join(spread(rejected.distinct()), key, "left_anti")
    return accepted, errors, overruns


def run_with_retries(
    batches: DataFrame,
    fn: Callable[[dict], dict],
    schema: str,
    check: Callable[[DataFrame], DataFrame],
    attempts: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, attempt log). Only rejected rows go round again, with their errors.

    ``check`` adds ``reason`` (NULL when the reply is good) to the output of map_batches.
    """
    todo, accepted, log = batches, None, None
    plain = [c for c in batches.columns]
    for attempt in range(1, attempts + 1):
        out = materialize(check(map_batches(todo, fn, schema)))
        fault = F.coalesce("error", "reason")
        entry = out.select(
            *[c for c in plain if c != "payload"], F.lit(attempt).alias("attempt"),
            F.when(fault.isNull(), "complete").otherwise("failed").alias("status"), fault.alias("error"),
        )
        good = out.where(fault.isNull()).select(*plain, "reply")
        accepted = good if accepted is None else accepted.unionByName(good)
        log = entry if log is None else log.unionByName(entry)
        bad = out.where(fault.isNotNull())
        if attempt == attempts or bad.limit(1).count() == 0:
            break
        todo = bad.select(*plain, F.array(fault).alias("errors"))
    return accepted, log


def word_payload(batch_words: DataFrame) -> DataFrame:
    """(media_id, batch, payload): each batch's words in order, as JSON.

    ``batch_words`` as for :func:`validate_responses`; a batch holds at most a few hundred words.
    """
    item = F.struct("ordinal", "text", "speaker", "start", "end")
    return batch_words.groupBy("media_id", "batch").agg(
        F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("words"))).alias("payload")
    )


ATTEMPTS = "media_id {media}, batch {batch}, attempt int, status string, errors array<string>"
WORD_CUES = (
    "media_id {media}, batch {batch}, attempt int, id string, start double, end double, source string, "
    "translated string, speaker string, first_word int, last_word int"
)


def run_word_batches(
    batch_words: DataFrame, fn: Callable[[dict], dict], folder: str, attempts: int = 3, max_seconds: float = 8.0,
    max_chars: int = 84,
) -> tuple[DataFrame, DataFrame]:
    """Words to accepted cues through a user function: (cues, attempt log).

    Each round calls ``fn`` for the batches still open, checks the replies, keeps the cues of
    sound batches and sends the others round again with their errors. The last round accepts
    cues beyond the soft limits. ``folder`` holds the cues and the log as Parquet: ``running``
    is written before a round calls, ``complete`` or ``failed`` when its cues are stored.
    Called again with the same folder, after a crash or not, it goes on where it ended:
    complete batches are not asked again, attempts count on, and what a lost round left is
    not read. ``fn`` gets {"words": [...], "errors": [...]} and returns {"cues": [...]}.
    """
    spark, key = batch_words.sparkSession, ["media_id", "batch"]
    types = {n: batch_words.schema[n].dataType.simpleString() for n in key}
    log_schema = ATTEMPTS.format(media=types["media_id"], batch=types["batch"])
    cue_schema = WORD_CUES.format(media=types["media_id"], batch=types["batch"])

    def table(name: str, schema: str) -> DataFrame:
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    def note(rows: DataFrame, status, errors) -> None:
        rows.select(*key, "attempt", status.alias("status"), errors.cast("array<string>").alias("errors")).write.mode("append").parquet(f"{folder}/log")

    batch_words = materialize(batch_words)
    payloads = materialize(word_payload(batch_words))
    table("cues", cue_schema)
    for _ in range(attempts):
        past = table("log", log_schema).groupBy(*key).agg(
            F.max("attempt").alias("tried"), F.max(F.col("status") == "complete").alias("done"),
            F.max_by("errors", F.struct("attempt", F.col("status") != "running")).alias("errors"),
        )
        open_ = materialize(
            payloads.join(spread(past), key, "left").where(~F.coalesce("done", F.lit(False)) & (F.coalesce("tried", F.lit(0)) < attempts))
            .select(*key, "payload", "errors", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt"))
        )
        if open_.isEmpty():
            break
        note(open_, F.lit("running"), F.lit(None))
        out = materialize(map_batches(open_, fn, WORD_REPLY))
        items = out.select(*key, F.posexplode("reply.cues").alias("pos", "c")).select(*key, "pos", "c.*")
        asked = batch_words.join(spread(open_.select(*key)), key, "left_semi")
        found, errors, overruns = validate_responses(items, asked, max_seconds, max_chars, accept_overruns=True)
        # Limits bind until the last attempt of a batch.
        strict = overruns.join(spread(open_.where(F.col("attempt") < attempts).select(*key)), key, "left_semi")
        wrong = (
            errors.select(*key, "pos", "message").unionByName(strict.select(*key, F.col("pos").cast("long").alias("pos"), "message"))
            .unionByName(out.where("error is not null").select(*key, F.lit(-1).cast("long").alias("pos"), F.col("error").alias("message")))
            .groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("pos", F.lit(1 << 40)).alias("pos"), "message"))), lambda x: x["message"]).alias("wrong"))
        )
        judged = materialize(open_.select(*key, "attempt").join(spread(wrong), key, "left"))
        sound = found.join(spread(judged.where("wrong is null").select(*key, "attempt")), key)
        sound.select(*[c.split()[0] for c in WORD_CUES.split(", ")]).write.mode("append").parquet(f"{folder}/cues")
        note(judged, F.when(F.col("wrong").isNull(), "complete").otherwise("failed"), F.col("wrong"))
    log = table("log", log_schema)
    complete = log.where("status = 'complete'").select(*key, "attempt").distinct()
    return table("cues", cue_schema).join(spread(complete), [*key, "attempt"], "left_semi"), log
