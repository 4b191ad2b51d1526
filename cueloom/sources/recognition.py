"""Speech-recognition outputs into word, cue and interval tables.

Every reader takes one row per file, ``(media_id, content)``, from :func:`whole_files` or
any table, and returns rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions.text import cue_id, norm_speaker, strip
from cueloom.functions.times import parse_time
from cueloom.plans.blocks import Ordered, row_number

INTEGER_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(media_id = path, content) of every file under ``path``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("content")
    )


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(media_id = path, line) of every log file under ``path``."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("line")
    )


def _field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _seconds(value: Column, integer_milliseconds: bool) -> Column:
    """Seconds of a JSON scalar: a stamp, or a number (an integer may mean ms)."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    if integer_milliseconds:
        number = F.when(kind.isin(*INTEGER_TYPES), number / 1000).otherwise(number)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "STRING", parse_time(text)).otherwise(number)


def read_segments(
    files: DataFrame, offset: float = 0.0, ordinal_offset: int = 0
) -> DataFrame:
    """Segment JSON into cues; blank texts go before numbering."""
    doc = F.try_parse_json("content")

    def entries(name):
        return F.try_variant_get(doc, f"$.{name}", "array<variant>")

    first, second = entries("transcription"), entries("segments")
    chosen = F.when(F.size(first) > 0, first).otherwise(second)
    e = F.col("e")

    def source(v):
        return strip(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")))

    # A file is one row: its cues are numbered inside the row.
    rows = files.select("media_id", F.posexplode(F.filter(chosen, lambda v: source(v) != "")).alias("pos", "e"))

    def time(stamp, seconds, default):
        return F.coalesce(
            _seconds(_field(e, f"$.timestamps.{stamp}"), False),
            _seconds(_field(e, f"$.{seconds}"), False),
            _seconds(_field(e, f"$.offsets.{stamp}"), True),
            default,
        )

    begin = time("from", "start", F.lit(0.0))
    timed = rows.select(
        "media_id", "pos", begin.alias("__b"), time("to", "end", begin).alias("__e"),
        source(e).alias("source"), F.to_json("e").alias("metadata"),
    )
    start = F.col("__b") + F.lit(offset)
    return timed.select(
        "media_id", cue_id(F.col("pos") + ordinal_offset).alias("id"), start.alias("start"),
        F.greatest(start, F.col("__e") + F.lit(offset)).alias("end"), "source", "metadata",
    )


def segment_tokens(metadata: Column) -> Column:
    """Tokens of a segment's JSON as (text, raw time scalars), for leading_tokens."""
    tokens = F.try_variant_get(F.try_parse_json(metadata), "$.tokens", "array<variant>")

    def raw(t, path):
        return F.to_json(_field(t, path))

    return F.transform(
        tokens,
        lambda t: F.struct(
            F.try_variant_get(t, "$.text", "string").alias("text"),
            raw(t, "$.offsets.from").alias("offset_from"), raw(t, "$.offsets.to").alias("offset_to"),
            raw(t, "$.timestamps.from").alias("stamp_from"), raw(t, "$.timestamps.to").alias("stamp_to"),
        ),
    )


WORD_ITEMS = (
    "array<struct<type: string, text: string, start: double, end: double, "
    "speaker_id: string, logprob: double>>"
)


def read_words_spaced(files: DataFrame, offset: float = 0.0) -> DataFrame:
    """Word items: audio events go, a spacing joins the word before it.

    A file is one row, so its words are joined and numbered inside the row.
    """
    def kind(x):
        return F.coalesce(x["type"], F.lit("word"))

    items = F.filter(F.from_json("content", WORD_ITEMS), lambda x: kind(x) != "audio_event")
    kept = files.select("media_id", items.alias("items"))
    heads = F.filter(
        F.transform("items", lambda x, i: F.when(kind(x) != "spacing", i + 1)), lambda i: i.isNotNull()
    )
    placed = kept.select(
        "media_id", "items", F.transform("items", lambda x: F.coalesce(x["text"], F.lit(""))).alias("t"), heads.alias("at")
    )

    def word(i, k):
        end = F.coalesce(F.get("at", k + 1), F.size("items") + 1)
        w = F.get("items", i - 1)
        return F.struct(
            F.array_join(F.slice("t", i, end - i), "").alias("text"), w["start"].alias("start"), w["end"].alias("end"),
            w["speaker_id"].alias("speaker_id"), w["logprob"].alias("logprob"),
        )

    rows = placed.select("media_id", F.posexplode(F.transform("at", word)).alias("ordinal", "w"))
    start = F.coalesce("w.start", F.lit(0.0)) + F.lit(offset)
    end = F.coalesce(F.col("w.end") + F.lit(offset), start + F.lit(offset))
    return rows.select(
        "media_id", "ordinal", start.alias("start"), F.greatest(start, end).alias("end"), "w.text",
        norm_speaker(F.col("w.speaker_id")).alias("speaker"), F.col("w.logprob").alias("logprob"),
    )


SENTENCE_DOC = (
    "struct<transcripts: array<struct<sentences: array<struct<speaker_id: string, words: "
    "array<struct<text: string, punctuation: string, begin_time: double, end_time: double>>>>>>>"
)


def read_words_sentences(files: DataFrame, diarize: bool = True) -> DataFrame:
    """Transcripts, sentences, words; milliseconds to seconds; blanks dropped.

    A file is one row, so its words are numbered inside the row.
    """
    def all_of(parts, part):
        """The words of all parts in order; a part without a list has none."""
        return F.flatten(F.filter(F.transform(parts, part), lambda x: x.isNotNull()))

    def word(w, speaker):
        text = F.concat(F.coalesce(w["text"], F.lit("")), F.coalesce(w["punctuation"], F.lit("")))
        return F.struct(w["begin_time"].alias("begin"), w["end_time"].alias("end"), text.alias("text"), speaker.alias("speaker"))

    def words_of(sentence):
        speaker = sentence["speaker_id"] if diarize else F.lit(None).cast("string")
        return F.transform(sentence["words"], lambda w: word(w, speaker))

    docs = files.select("media_id", F.from_json("content", SENTENCE_DOC)["transcripts"].alias("d"))
    words = all_of(F.col("d"), lambda t: all_of(t["sentences"], words_of))
    return (
        docs.select("media_id", F.posexplode(F.filter(words, lambda w: strip(w["text"]) != "")).alias("ordinal", "w"))
        .select("media_id", "ordinal", (F.col("w.begin") / 1000).alias("start"), (F.col("w.end") / 1000).alias("end"), "w.text", "w.speaker")
    )


PHRASE_DOC = (
    "struct<phrases: array<struct<speaker: string, text: string, words: array<struct<"
    "text: string, offsetMilliseconds: double, durationMilliseconds: double>>>>>"
)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [x.casefold() for x in xs])


def read_words_phrases(files: DataFrame, diarize: bool = True) -> DataFrame:
    """Words placed back into their phrase's text, so that the texts join up to it."""
    phrases = (
        files.select("media_id", F.from_json("content", PHRASE_DOC).alias("d"))
        .select("media_id", F.posexplode("d.phrases").alias("p", "ph"))
        .select(
            "media_id", "p", F.col("ph.speaker").alias("speaker"),
            F.coalesce("ph.text", F.lit("")).alias("text"),
            F.filter("ph.words", lambda w: strip(F.coalesce(w["text"], F.lit(""))) != "").alias("words"),
        )
        .where(F.size("words") > 0)
    )
    folded = phrases.withColumn(
        "__f", _fold_all(F.concat(F.array("text"), F.transform("words", lambda w: w["text"])))
    ).withColumn(
        "items", F.arrays_zip(F.col("words").alias("w"), F.slice("__f", F.lit(2), F.size("__f") - 1).alias("f"))
    )
    text, whole = F.col("text"), F.element_at(F.col("__f"), 1)
    word_type = "array<struct<text: string, start: double, end: double>>"

    def grown(out, tail):
        """``out`` with ``tail`` attached to its last word."""
        last = F.element_at(out, -1)
        longer = F.struct(
            F.concat(last["text"], tail).alias("text"), last["start"].alias("start"), last["end"].alias("end")
        )
        return F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))

    def step(acc, item):
        token, cursor, out = item["w"]["text"], acc["cursor"], acc["out"]
        at = F.call_function("locate", item["f"], whole, cursor + 1)
        found, some = at > 0, F.size(out) > 0
        spoken = F.when(found, F.substr(text, at, F.char_length(token))).otherwise(token)
        ascii_pair = token.rlike(r"^\p{ASCII}") & F.element_at(out, -1)["text"].rlike(r"\p{ASCII}$")
        before = (
            F.when(some & found, grown(out, F.substr(text, cursor + 1, at - 1 - cursor)))
            .when(some & ascii_pair, grown(out, F.lit(" ")))
            .otherwise(out)
        )
        start = item["w"]["offsetMilliseconds"] / 1000
        word = F.struct(
            spoken.alias("text"), start.alias("start"),
            (start + item["w"]["durationMilliseconds"] / 1000).alias("end"),
        )
        return F.struct(
            F.when(found, at - 1 + F.char_length(token)).otherwise(cursor).alias("cursor"),
            F.concat(before, F.array(word)).alias("out"),
        )

    def finish(acc):
        tail = F.when(
            acc["cursor"] > 0, F.concat(F.substr(text, acc["cursor"] + 1, F.char_length(text)), F.lit(" "))
        ).otherwise(F.lit(" "))
        return grown(acc["out"], tail)

    start_state = F.struct(F.lit(0).alias("cursor"), F.array().cast(word_type).alias("out"))
    words = folded.select(
        "media_id", "p", "speaker", F.posexplode(F.aggregate("items", start_state, step, finish)).alias("c", "w")
    )
    speaker = F.col("speaker") if diarize else F.lit(None).cast("string")
    placed = Ordered.of(
        words.select("media_id", "p", "c", "w.*", speaker.alias("speaker")), ["media_id"], ["p", "c"]
    ).scan(__n=row_number())
    return placed.rows.select(
        "media_id", (F.col("__n") - 1).cast("int").alias("ordinal"), "start", "end", "text", "speaker"
    )


WORD_PARSERS = {
    "spaced": read_words_spaced,
    "sentences": read_words_sentences,
    "phrases": read_words_phrases,
}


def word_parser(name: str):
    """The reader of a provider's word list."""
    try:
        return WORD_PARSERS[name]
    except KeyError:
        raise ValueError(f"no word parser named {name!r}; known: {sorted(WORD_PARSERS)}") from None


# Fixed patterns of the recognizer's log lines.
VAD_LINE = r"VAD segment \d+: start = (\d+(?:\.\d+)?), end = (\d+(?:\.\d+)?)"
CUE_LINE = (
    r"\[\s*(\d\d:\d\d:\d\d[.,]\d{3})\s*-->\s*(\d\d:\d\d:\d\d[.,]\d{3})\s*\]\s*(.*)"
)
PROGRESS_LINE = r"progress\s*=\s*(\d{1,3})%"
DOWNLOAD_LINE = r"\[download\]\s+(?:~\s*)?(\d+(?:\.\d+)?)%"


def read_vad_log(lines: DataFrame, offset: float = 0.0) -> DataFrame:
    """Speech spans printed by the recognizer, inverted ones dropped."""
    start, end = [
        F.regexp_extract("line", VAD_LINE, i).cast("double") + F.lit(offset) for i in (1, 2)
    ]
    return lines.where(F.col("line").rlike(VAD_LINE)).where(end >= start).select(
        "media_id", F.round(start, 3).alias("start"), F.round(end, 3).alias("end")
    )


def read_cue_log(lines: DataFrame, offset: float = 0.0) -> DataFrame:
    """Cues printed as ``[from --> to] text``; inverted spans are clamped."""
    start, end = [parse_time(F.regexp_extract("line", CUE_LINE, i)) + F.lit(offset) for i in (1, 2)]
    return lines.where(F.col("line").rlike(CUE_LINE)).select(
        *[c for c in lines.columns if c != "line"], start.alias("start"),
        F.greatest(start, end).alias("end"), strip(F.regexp_extract("line", CUE_LINE, 3)).alias("source"),
    )


def read_progress_log(lines: DataFrame) -> DataFrame:
    """Progress fractions, capped at one, of recognizer and download lines."""
    percent = F.coalesce(
        F.nullif(F.regexp_extract("line", PROGRESS_LINE, 1), F.lit("")),
        F.nullif(F.regexp_extract("line", DOWNLOAD_LINE, 1), F.lit("")),
    ).cast("double")
    return (
        lines.withColumn("__p", percent)
        .where("__p is not null")
        .select(
            *[c for c in lines.columns if c != "line"],
            (F.least(F.lit(100.0), "__p") / 100).alias("progress"),
        )
    )
