"""Timeline tables derived from the given tables, each also as DuckDB SQL.

``media_id`` takes three values, so every recording holds about a third of all rows: the
queries run on the skew the engine is built for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.plans.blocks import Ordered, row_number, running_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- intervals from events: 20x compressed time, value in tenths of a second ---


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # Counted from the epoch without a time zone, so the session's zone does not matter.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))
    ms = F.floor(micros / 1000).cast("long") - 1704067200000
    begin = F.floor(ms / 20).cast("long")
    return e.select(
        (F.col("user_id") % 3).alias("media_id"),
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").alias("ordinal"),
        (begin.cast("double") / 1000).alias("start"),
        ((begin + F.floor(F.col("value") * 100)).cast("double") / 1000).alias("end"),
        F.nullif(F.col("event_type"), F.lit("view")).alias("speaker"),
        F.col("event_type"),
        F.concat("event_type", F.lit(" "), (F.col("event_id") % 7).cast("string")).alias("source"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("T "), "props")).alias("translated"),
        F.lit(None).cast("double").alias("timing_confidence"),
        (F.col("event_id") % 11 != 0).alias("stable"),
    )


IV = """iv as (
  select user_id % 3 as media_id, cast(event_id as varchar) as id, event_id as ordinal,
    cast(b as double) / 1000 as start,
    cast(b + cast(floor(value * 100) as bigint) as double) / 1000 as "end",
    nullif(event_type, 'view') as speaker, event_type,
    event_type || ' ' || (event_id % 7) as source,
    case when event_id % 5 <> 0 then 'T ' || props end as translated,
    event_id % 11 <> 0 as stable
  from (select *, (epoch_us(ts) // 1000 - 1704067200000) // 20 as b from events))"""


def vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).where("event_type in ('click', 'purchase')").select(
        "media_id", "start", "end"
    )


def event_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).where("event_type not in ('click', 'purchase')").drop("event_type")


# Speech intervals coalesced at 0.04 s, and the cues with their cross-talk flag.
VAD = """v0 as (select media_id, start, "end" from iv where event_type in ('click', 'purchase')),
v1 as (select *, max("end") over (partition by media_id order by start, "end"
    rows between unbounded preceding and 1 preceding) as reach from v0),
v2 as (select *, sum(case when reach is null or start > reach + 0.04::double then 1 else 0 end)
    over (partition by media_id order by start, "end" rows unbounded preceding) as g from v1),
speech as (select media_id, min(start) as l, max("end") as r from v2 group by media_id, g)"""
CUES = """c0 as (select * from iv where event_type not in ('click', 'purchase')),
ecues as (select c0.*, coalesce(exists (select 1 from c0 b where b.media_id = c0.media_id
      and b.start < c0."end" and c0.start < b."end" and b.speaker <> c0.speaker), false) as crosstalk
  from c0)"""


# --- words and turns from conversations ---


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cue per turn, with its first word's ordinal and start."""
    t = table(spark, sf_dir, "conversations")
    toks = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda x: x != "")
    t = t.select(
        (F.col("conv_id") % 3).alias("media_id"), "conv_id", "turn",
        F.nullif(F.col("role"), F.lit("system")).alias("speaker"), toks.alias("toks"),
    ).where(F.size("toks") > 0)
    sizes = F.aggregate("toks", F.lit(0).cast("long"), lambda a, x: a + 40 + 60 * F.char_length(x))
    t = t.withColumns({
        "n": F.size("toks").cast("long"), "ms": sizes, "gap": (F.col("turn") * 7919) % 1500,
    })
    placed = Ordered.of(t, ["media_id"], ["conv_id", "turn"]).scan(
        k=row_number(), words=running_sum(F.col("n")), reach=running_sum(F.col("ms") + F.col("gap"))
    )
    start = F.col("reach") - F.col("ms")
    jitter = (F.col("conv_id") * 31 + F.col("turn") * 7919) % 2400 - 700
    return placed.rows.select(
        "media_id", "conv_id", "turn",
        F.concat(F.lit("c"), F.col("k").cast("string")).alias("id"),
        (F.col("k") - 1).alias("ordinal"), start.alias("start_ms"),
        (start.cast("double") / 1000).alias("start"),
        (F.greatest(start, F.col("reach") + jitter).cast("double") / 1000).alias("end"),
        F.array_join("toks", " ").alias("source"),
        F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.concat(F.lit("T "), F.array_join("toks", " "))).alias("translated"),
        "speaker", (F.col("words") - F.col("n")).cast("int").alias("first_word"),
        (F.col("words") - 1).cast("int").alias("last_word"), "toks",
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).drop("toks", "start_ms", "conv_id", "turn").withColumn(
        "stable", F.col("ordinal") % 7 != 3
    )


def running_ends(lengths: pa.Array) -> pa.Array:
    """The running sums inside each list."""
    values, at = lengths.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lengths).to_numpy())])
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = sums[1:] - np.repeat(sums[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ends, pa.int64()))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.transform("toks", lambda x: (40 + 60 * F.char_length(x)).cast("long"))
    # Summed inside the turn's row: a window over the exploded words would shuffle them all.
    w = turns(spark, sf_dir).withColumn("ms", ms).withColumn(
        "ends", F.arrow_udf(running_ends, "array<long>")("ms")
    ).select(
        "media_id", "first_word", "start_ms", "speaker",
        F.posexplode(F.arrays_zip("toks", "ms", "ends")).alias("pos", "w"),
    )
    end = F.col("start_ms") + F.col("w.ends")
    return w.select(
        "media_id", (F.col("first_word") + F.col("pos")).cast("int").alias("ordinal"),
        ((end - F.col("w.ms")).cast("double") / 1000).alias("start"), (end.cast("double") / 1000).alias("end"),
        F.concat("w.toks", F.lit(" ")).alias("text"), "speaker",
    )


WORDS = """tt as (select conv_id % 3 as media_id, conv_id, turn, nullif(role, 'system') as speaker,
    list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') as toks
  from conversations),
tk as (select media_id, conv_id, turn, speaker, unnest(toks) as tok, unnest(range(len(toks))) as pos from tt),
tw as (select *, 40 + 60 * length(tok) as dur from tk),
words as (select media_id, conv_id, turn, pos,
    cast(row_number() over (partition by media_id order by conv_id, turn, pos) - 1 as int) as ordinal,
    cast(sum(dur + case when pos = 0 then (turn * 7919) % 1500 else 0 end) over (
      partition by media_id order by conv_id, turn, pos rows unbounded preceding) - dur as bigint) as start_ms,
    dur, tok || ' ' as text, speaker,
    start_ms::double / 1000 as start, (start_ms + dur)::double / 1000 as "end" from tw)"""
TURNS = """tc as (select media_id, conv_id, turn, any_value(speaker) as speaker, min(ordinal) as first_word,
    max(ordinal) as last_word, min(start_ms) as start_ms, max(start_ms + dur) as end_ms,
    rtrim(string_agg(text, '' order by pos)) as source from words group by media_id, conv_id, turn),
cues as (select media_id, 'c' || row_number() over w as id, row_number() over w - 1 as ordinal,
    start_ms::double / 1000 as start,
    greatest(start_ms, end_ms + (conv_id * 31 + turn * 7919) % 2400 - 700)::double / 1000 as "end", source,
    case when (conv_id + turn) % 5 <> 0 then 'T ' || source end as translated, speaker, first_word, last_word,
    (row_number() over w - 1) % 7 <> 3 as stable
  from tc window w as (partition by media_id order by conv_id, turn))"""


# --- a signal from lineitem: three recordings of 100 samples a second ---


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("media_id"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    placed = Ordered.of(li, ["media_id"], ["l_orderkey", "l_linenumber", "l_partkey"]).scan(n=row_number())
    wave = (F.col("l_partkey") * 37 + F.col("l_orderkey") * 101) % 2001 - 1000
    loud = F.when(F.floor(F.col("l_orderkey") / 160) % 3 == 0, 1).otherwise(20)
    return placed.rows.select(
        "media_id", (F.col("n") - 1).alias("i"), F.floor(wave * loud / 20).cast("long").alias("sample"),
        F.lit(100).alias("rate"),
    )


SAMPLES = """samples as (select l_suppkey % 3 as media_id,
    row_number() over (partition by l_suppkey % 3 order by l_orderkey, l_linenumber, l_partkey) - 1 as i,
    cast(floor(((l_partkey * 37 + l_orderkey * 101) % 2001 - 1000)
      * case when (l_orderkey // 160) % 3 = 0 then 1 else 20 end / 20) as bigint) as sample, 100 as rate
  from lineitem),
levels as (select media_id, i // 2 as win, sqrt(sum(sample * sample)::double / count(*)) as rms
  from samples group by media_id, i // 2)"""


def signal_cues(levels: DataFrame) -> DataFrame:
    """A cue every 37 windows of a level table."""
    k = F.floor(F.col("win") / 37)
    return levels.where(F.col("win") % 37 == 0).select(
        "media_id", F.concat(F.lit("s"), k.cast("string")).alias("id"), k.alias("ordinal"),
        (k * 740 / 1000).alias("start"), ((k * 740 + 300 + (k * 7919) % 1200) / 1000).alias("end"),
        F.lit(None).cast("string").alias("speaker"),
    )


SIGNAL_CUES = """scues as (select media_id, 's' || (win // 37) as id, win // 37 as ordinal,
    ((win // 37) * 740)::double / 1000 as start,
    ((win // 37) * 740 + 300 + ((win // 37) * 7919) % 1200)::double / 1000 as "end"
  from levels where win % 37 = 0)"""


def durations(df: DataFrame, fraction: float = 0.75) -> DataFrame:
    return df.groupBy("media_id").agg((F.max("end") * F.lit(fraction)).alias("duration"))
