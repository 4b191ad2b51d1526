"""Queries over scalar functions and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import names as N
from cueloom.functions import replies as RP
from cueloom.functions import text as X
from cueloom.functions import times as M
from cueloom.operators import align as A
from cueloom.queries import views as V
from cueloom.queries.registry import SQL, query, with_
from cueloom.queries.tables import ass_sql
from cueloom.queries.timeline import weight_sql
from cueloom.sources import recognition as G
from cueloom.sources import sinks as S
from cueloom.sources import traces as TR
from cueloom.session import scratch_dir

# Each document gets some wide characters by its number, which the tables lack.
WIDE_SQL = "text || case doc_id % 3 when 0 then '漢字カナ' when 1 then '｛Ａ｝' else '' end"


def wide_text():
    tail = F.when(F.col("doc_id") % 3 == 0, "漢字カナ").when(F.col("doc_id") % 3 == 1, "｛Ａ｝").otherwise("")
    return F.concat("text", tail)


@query("text_weight", f"select doc_id, {weight_sql(WIDE_SQL)}::int as weight from documents")
def text_weight(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.text_weight(wide_text()).alias("weight"))


@query("word_weight", with_(V.WORDS, select=f"select media_id, ordinal, greatest(1, {weight_sql('trim(text)')})::int as weight from words"))
def word_weight(spark, d):
    return V.words(spark, d).select("media_id", "ordinal", X.word_weight(F.col("text")).alias("weight"))


@query("ass_time", f"select event_id, {ass_sql('(value * 37.5::double - 20)')} as ass from events")
def ass_time(spark, d):
    return V.table(spark, d, "events").select("event_id", M.ass_time(F.col("value") * 37.5 - 20).alias("ass"))


STAMP = "(event_id % 3) || ':' || (event_id % 60) || ':' || lpad((event_id % 61)::varchar, 2, '0') || case event_id % 4 when 0 then '.' when 1 then ',' else '.' end || case event_id % 5 when 0 then (event_id % 10)::varchar when 1 then lpad((event_id % 1000)::varchar, 3, '0') when 2 then 'x' else lpad((event_id % 100)::varchar, 2, '0') end"


def stamp():
    k = F.col("event_id")
    text = lambda n, w: F.lpad((k % n).cast("string"), w, "0")
    return F.concat(
        (k % 3).cast("string"), F.lit(":"), (k % 60).cast("string"), F.lit(":"), text(61, 2),
        F.when(k % 4 == 1, ",").otherwise("."),
        F.when(k % 5 == 0, (k % 10).cast("string")).when(k % 5 == 1, text(1000, 3))
        .when(k % 5 == 2, "x").otherwise(text(100, 2)),
    )


@query(
    "parse_ass_time",
    f"""with s as (select event_id, {STAMP} as s from events), p as (select *, regexp_extract(s, '^(\\d+):(\\d+):(\\d+)[.,](\\d+)$', ['h', 'm', 's', 'f']) as g from s)
    select event_id, case when g.f <> '' then (try_cast(g.h as bigint) * 360000 + try_cast(g.m as bigint) * 6000 + try_cast(g.s as bigint) * 100 + case length(g.f)
      when 1 then try_cast(g.f as bigint) * 10 when 3 then round_even(try_cast(g.f as double) / 10, 0)::bigint else try_cast(g.f as bigint) end)::double / 100 end as seconds from p""",
)
def parse_ass_time(spark, d):
    return V.table(spark, d, "events").select("event_id", M.parse_ass_time(stamp()).alias("seconds"))


@query(
    "parse_time",
    f"""with s as (select event_id, case when event_id % 6 = 0 then value::varchar else {STAMP} end as s from events)
    select event_id, case when s like '%x' then null when s like '%:%' then split_part(s, ':', 1)::int * 3600 + split_part(s, ':', 2)::int * 60
      + replace(split_part(s, ':', 3), ',', '.')::double else s::double end as seconds from s""",
)
def parse_time(spark, d):
    s = F.when(F.col("event_id") % 6 == 0, F.col("value").cast("string")).otherwise(stamp())
    return V.table(spark, d, "events").select("event_id", M.parse_time(s).alias("seconds"))


LANG = "case doc_id % 6 when 0 then ' ' || upper(lang) || '_CN ' when 1 then 'Auto' when 2 then '  ' when 3 then lang || '-latn-x' when 4 then null else lang end"


def lang():
    k = F.col("doc_id") % 6
    return (
        F.when(k == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit("_CN "))).when(k == 1, "Auto").when(k == 2, "  ")
        .when(k == 3, F.concat("lang", F.lit("-latn-x"))).when(k == 5, F.col("lang"))
    )


@query(
    "norm_lang",
    f"select doc_id, case when lower(trim(l)) not in ('', 'auto') then split_part(lower(replace(trim(l), '_', '-')), '-', 1) end as lang from (select doc_id, {LANG} as l from documents)",
)
def norm_lang(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.norm_lang(lang()).alias("lang"))


@query(
    "lang_component",
    "select page_id, nullif(trim(regexp_replace(replace(lower(trim(url)), '_', '-'), '[^a-z0-9-]+', '-', 'g'), '-'), '') as component from pages",
)
def lang_component(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.lang_component(F.col("url")).alias("component"))


@query(
    "published_lang",
    f"select doc_id, case when l is not null and lower(trim(l)) not in ('', 'auto') then l else coalesce(lang, l) end as lang from (select doc_id, lang, {LANG} as l from documents)",
)
def published_lang(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.published_lang(lang(), F.col("lang")).alias("lang"))


FILE = """case doc_id % 6 when 0 then 'talk-' || doc_id || '.Source.ASS' when 1 then 'a.b.translated.ass' when 2 then 'talk.' || lang || '-de.ass'
  when 3 then 'talk.ja-zh-cn.ass' when 4 then 'talk.x.ass' else 'notes.txt' end"""


@query(
    "subtitle_layout",
    f"""with f as (select doc_id, doc_id % 6 as k, lang, {FILE} as n from documents)
    select doc_id, case k when 0 then 'source' when 1 then 'translated' when 2 then 'bilingual' when 3 then 'bilingual' end as mode,
      case k when 0 then 'talk-' || doc_id when 1 then 'a.b' when 2 then 'talk' when 3 then 'talk' end as base,
      case k when 2 then lang when 3 then 'ja' end as source_language,
      case k when 2 then 'DE' when 3 then 'zh-cn' end as target_language
    from f where k < 4 and regexp_full_match(lang, '[a-z]{{2,3}}')
    union all select doc_id, null, null, null, null from f where k >= 4""",
)
def subtitle_layout(spark, d):
    k = F.col("doc_id") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("talk-"), F.col("doc_id").cast("string"), F.lit(".Source.ASS")))
        .when(k == 1, "a.b.translated.ass").when(k == 2, F.concat(F.lit("talk."), "lang", F.lit("-de.ass")))
        .when(k == 3, "talk.ja-zh-cn.ass").when(k == 4, "talk.x.ass").otherwise("notes.txt")
    )
    # Hints agree with the German side, or with the first side of the ambiguous name.
    out = V.table(spark, d, "documents").select(
        "doc_id", N.subtitle_layout(name, F.when(k == 3, "ja"), F.when(k == 2, "DE")).alias("l")
    )
    return out.select("doc_id", "l.*")


@query("norm_speaker", with_(V.IV, select="select media_id, id, case when ordinal % 3 = 0 then nullif(trim(speaker), '') when ordinal % 3 = 1 then speaker end as speaker from iv"))
def norm_speaker(spark, d):
    k = F.col("ordinal") % 3
    raw = F.when(k == 0, F.concat(F.lit(" speaker_"), "speaker", F.lit(" "))).when(k == 1, F.col("speaker")).otherwise("  ")
    return V.intervals(spark, d).select("media_id", "id", X.norm_speaker(raw).alias("speaker"))


FOLD_SQL = "replace(lower({0}), 'ß', 'ss')"


@query(
    "dedup_text_keys",
    f"""select conv_id, turn, {FOLD_SQL.format("trim(regexp_replace(text, '\\s+', ' ', 'g'))")} as key_a,
      regexp_replace({FOLD_SQL.format('text')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') as key_b,
      {FOLD_SQL.format("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} as key_c from conversations""",
)
def dedup_text_keys(spark, d):
    return V.table(spark, d, "conversations").select(
        "conv_id", "turn", X.norm_key_a(F.col("text")).alias("key_a"), X.norm_key_b(F.col("text")).alias("key_b"),
        X.norm_key_c(F.col("text")).alias("key_c"),
    )


@query(
    "sanitized_text",
    """select page_id, replace(replace(html, '{', '｛'), '}', '｝') as text, trim(translate(url, ',' || chr(10) || chr(13), '   ')) as name from pages""",
)
def sanitized_text(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.ass_text(F.col("html")).alias("text"), X.ass_name(F.col("url")).alias("name"))


@query(
    "cue_ids",
    """select event_id, (event_id + 1)::varchar as plain, 'preview-' || event_id as preview, 'w' || event_id || '-' || (event_id + 3) as word,
      true as is_preview, true as is_word, false as plain_is_word from events""",
)
def cue_ids(spark, d):
    k = F.col("event_id")
    ids = V.table(spark, d, "events").select(
        "event_id", X.cue_id(k).alias("plain"), X.preview_id(k).alias("preview"), X.word_cue_id(k, k + 3).alias("word")
    )
    return ids.withColumns({
        "is_preview": X.is_preview_id(F.col("preview")), "is_word": X.is_word_cue_id(F.col("word")),
        "plain_is_word": X.is_word_cue_id(F.col("plain")),
    })


@query(
    "diarization_policy",
    """with p as (select event_id, case when event_id % 3 = 0 then null when event_id % 5 = 0 then 'b' else 'a' end as saved, event_id % 2 = 0 as on_,
        event_id % 4 * 10 as minutes, case when event_id % 7 < 3 then 'split' else 'disable' end as over, nullif(value * 30, 0) as secs from events),
      q as (select *, case when saved is not null and saved <> 'a' then 'stored diarization belongs to a different transcription backend'
        when saved is not null and over = 'split' and not on_ and minutes > 0 then 'saved whole-file diarization decision cannot be changed to split'
        when saved is null and secs is null then 'cannot measure complete recording duration for diarization' end as problem from p)
      select event_id, case when problem is null then case when saved is not null then minutes <> 0 and on_ else minutes > 0 and (over = 'split' or secs < minutes * 60) end end as enabled,
        problem from q""",
)
def diarization_policy(spark, d):
    k = F.col("event_id")
    saved = F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "b").otherwise("a")
    verdict = M.effective_diarization(
        saved, k % 2 == 0, F.lit("a"), k % 4 * 10, F.when(k % 7 < 3, "split").otherwise("disable"),
        F.nullif(F.col("value") * 30, F.lit(0.0)),
    )
    return V.table(spark, d, "events").select("event_id", verdict.alias("v")).select("event_id", "v.*")


@query(
    "estimate_seconds",
    """with p as (select event_id, case when event_id % 10 = 0 then null else value * 40 end as s, event_id * 7919 as b from events),
      q as (select *, case when coalesce(s, 0) = 0 then 600.0::double else s end as d from p)
      select event_id, greatest(15.0::double, 2.0::double + b::double / 2000000 + d / (25.0::double * least(4, greatest(1, ceil(d / 480))))) as seconds from q""",
)
def estimate_seconds(spark, d):
    k = F.col("event_id")
    s = F.when(k % 10 == 0, F.lit(None)).otherwise(F.col("value") * 40)
    return V.table(spark, d, "events").select("event_id", M.estimate_seconds(s, k * 7919).alias("seconds"))


@query(
    "start_label",
    """with c as (select event_id, round_even(value * 41.7::double * 100, 0)::bigint as c from events)
      select event_id, case when c >= 360000 then (c // 360000) || ':' || lpad(((c // 6000) % 60)::varchar, 2, '0') || ':' || lpad(((c // 100) % 60)::varchar, 2, '0')
        else lpad(((c // 6000) % 60)::varchar, 2, '0') || ':' || lpad(((c // 100) % 60)::varchar, 2, '0') || '.' || lpad((c % 100)::varchar, 2, '0') end as label from c""",
)
def start_label(spark, d):
    return V.table(spark, d, "events").select("event_id", M.start_label(F.col("value") * 41.7).alias("label"))


@query(
    "source_kind",
    """select page_id, case when page_id % 4 = 1 then false when page_id % 4 = 2 then false else regexp_matches(url, '^https?://[^/?#]') end as is_url from pages""",
)
def source_kind(spark, d):
    k = F.col("page_id") % 4
    value = F.when(k == 1, F.concat(F.lit("/data/"), "url")).when(k == 2, F.lit("https:///no-host")).otherwise(F.col("url"))
    return V.table(spark, d, "pages").select("page_id", X.is_url(value).alias("is_url"))


@query("recording_duration", "select l_orderkey, l_linenumber, case when l_linenumber % 3 > 0 then l_quantity::double * 100 / (l_linenumber % 3 * 8000) end as seconds from lineitem")
def recording_duration(spark, d):
    rate = F.col("l_linenumber") % 3 * 8000
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.duration(F.col("l_quantity").cast("double") * 100, rate).alias("seconds"))


@query(
    "chunk_caps",
    """with p as (select event_id, value as m, event_id % 2 = 0 as dz, case event_id % 5 when 0 then 'other' when 1 then 'split' else 'disable' end as o,
        event_id % 31 - 1 as dm, case when event_id % 11 = 0 then -1 else 2.5 end::double as ov from events)
      select event_id, case when dz and o = 'split' then least(m * 60, dm * 60) else m * 60 end as seconds,
        case when not m > 0 then 'max-minutes must be a finite positive number' when ov < 0 then 'chunk-overlap-seconds must be a finite non-negative number'
          when dm < 0 then 'diarize-max-minutes must be a non-negative integer' when o = 'other' then 'diarize-over-limit must be disable or split' end as problem from p""",
)
def chunk_caps(spark, d):
    k = F.col("event_id")
    over = F.when(k % 5 == 0, "other").when(k % 5 == 1, "split").otherwise("disable")
    overlap = F.when(k % 11 == 0, -1.0).otherwise(2.5)
    return V.table(spark, d, "events").select(
        "event_id", M.chunk_seconds_cap(F.col("value"), k % 2 == 0, over, k % 31 - 1).alias("seconds"),
        M.chunk_params_problem(F.col("value"), overlap, k % 31 - 1, over).alias("problem"),
    )


@query(
    "special_tokens",
    with_(V.WORDS, select="""select media_id, ordinal, ordinal % 4 < 2 as special, case when ordinal % 4 < 2 then 'x' else trim(text) end as first_text,
      case when ordinal % 3 = 0 then null else ordinal::double / 1000 end as first_start from words"""),
)
def special_tokens(spark, d):
    k = F.col("ordinal")
    word = F.trim("text")
    token = F.when(k % 4 == 0, F.concat(F.lit("[_"), word, F.lit("]"))).when(k % 4 == 1, F.concat(F.lit("<|"), word, F.lit("|>"))).otherwise(word)
    none = F.lit(None).cast("string")
    item = lambda text, lo: F.struct(
        text.alias("text"), F.when(k % 3 != 0, lo.cast("string")).alias("offset_from"), (lo + 5).cast("string").alias("offset_to"),
        none.alias("stamp_from"), none.alias("stamp_to"),
    )
    lead = A.leading_tokens(F.array(item(token, k), item(F.lit("x"), k)))
    return V.words(spark, d).select("media_id", "ordinal", X.is_special_token(token).alias("special"), lead.alias("l")).select(
        "media_id", "ordinal", "special", F.col("l.text").alias("first_text"), F.col("l.r1.start").alias("first_start")
    )


@query(
    "extract_json",
    """select event_id, case event_id % 6 when 5 then null else replace(props, ' ', '') end as found from events""",
)
def extract_json(spark, d):
    k = F.col("event_id") % 6
    reply = (
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n``` done")))
        .when(k == 2, F.concat(F.lit("well { "), F.lit("} no "), "props"))
        .when(k == 3, F.concat(F.lit('{"result": '), F.regexp_replace(F.to_json(F.struct(F.col("props").alias("p"))), '^.{5}', "")))
        .when(k == 4, F.concat(F.lit("so "), "props", F.lit(" ok")))
        .otherwise("no object here")
    )
    out = RP.extract_json(reply, last_resort=True)
    return V.table(spark, d, "events").select("event_id", out.alias("found"))


# --- readers ---

LINES = """ln as (select conv_id * 100 + turn as media_id, turn, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as i from conversations)"""


def line_files(spark, d, build, text="text"):
    """One file per turn, its content built from the turn's lines."""
    c = V.table(spark, d, "conversations").withColumn("media_id", F.col("conv_id") * 100 + F.col("turn"))
    return c.select("media_id", build(F.split(text, "\n")).alias("content"))


@query(
    "read_segments",
    with_(LINES, """kept as (select *, row_number() over (partition by media_id order by i) as n from ln where trim(t) <> '')""",
          select="""select media_id, (n + 10)::varchar as id, (i * 2 + case when turn % 3 = 2 then 0.5 else 0 end)::double + 5 as start,
      greatest((i * 2)::double + case when turn % 3 = 2 then 0.5 else 0 end + 5, (i * 2 + 1)::double + case when turn % 3 = 0 and i % 4 = 3 then -3 else 0 end + 5) as "end", trim(t) as source from kept"""),
)
def read_segments(spark, d):
    turn = F.col("turn")
    def build(lines):
        back = lambda i: F.when((turn % 3 == 0) & (i % 4 == 3), -3).otherwise(0)
        seconds = F.to_json(F.struct(F.transform(lines, lambda t, i: F.struct(
            (i * 2).alias("start"), (i * 2 + 1 + back(i)).alias("end"), F.concat(F.lit(" "), t).alias("text"))).alias("segments")))
        ms = F.to_json(F.struct(F.array().cast("array<string>").alias("transcription"), F.transform(lines, lambda t, i: F.struct(
            F.struct((i * 2000).alias("from"), (i * 2000 + 1000).alias("to")).alias("offsets"), t.alias("text"))).alias("segments")))
        clock = lambda s, f: F.concat(F.lit("00:"), F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(f))
        stamps = F.to_json(F.struct(F.transform(lines, lambda t, i: F.struct(
            F.struct(clock(i * 2, ",500").alias("from"), clock(i * 2 + 1, ",000").alias("to")).alias("timestamps"), t.alias("text"))).alias("transcription")))
        return F.when(turn % 3 == 0, seconds).when(turn % 3 == 1, ms).otherwise(stamps)
    return G.read_segments(line_files(spark, d, build), offset=5.0, ordinal_offset=10).drop("metadata")


@query(
    "read_words_spaced",
    """with w as (select conv_id * 100 + turn as media_id, unnest(string_split(text, ' ')) as t, unnest(range(len(string_split(text, ' ')))) as i from conversations)
      select media_id, i::int as ordinal, i::double as start, greatest(i::double, i + case when i % 5 = 4 then -1 else 0.5 end)::double as "end", t || ' ' as text,
        case when i % 3 > 0 then (i % 3)::varchar end as speaker, case when i % 2 = 0 then -0.5::double end as logprob from w""",
)
def read_words_spaced(spark, d):
    return G.read_words_spaced(spaced_words(spark, d))


@query("word_parser", SQL["read_words_spaced"])
def word_parser(spark, d):
    """The reader a provider's name stands for."""
    return G.word_parser("spaced")(spaced_words(spark, d))


def spaced_words(spark, d):
    c = V.table(spark, d, "conversations").withColumn("media_id", F.col("conv_id") * 100 + F.col("turn"))
    def item(kind, text, start=None, end=None, speaker=None, logprob=None):
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("type"), text.alias("text"),
            (none.cast("double") if start is None else start.cast("double")).alias("start"),
            (none.cast("double") if end is None else end.cast("double")).alias("end"),
            (none.cast("string") if speaker is None else speaker).alias("speaker_id"),
            (none.cast("double") if logprob is None else logprob).alias("logprob"),
        )
    def group(t, i):
        speaker = F.when(i % 3 > 0, F.concat(F.lit("speaker_"), (i % 3).cast("string")))
        word = item("word", t, i, i + F.when(i % 5 == 4, -1.0).otherwise(0.5), speaker, F.when(i % 2 == 0, -0.5))
        return F.array(word, item("audio_event", F.lit("(laughter)")), item("spacing", F.lit(" ")))
    lead = F.array(item("spacing", F.lit("  ")))
    items = F.concat(lead, F.flatten(F.transform(F.split("text", " "), group)))
    return c.select("media_id", F.to_json(items).alias("content"))


@query(
    "read_words_sentences",
    with_(LINES, """sp as (select media_id, i, unnest(string_split(t, ' ')) as w, unnest(range(len(string_split(t, ' ')))) as j from ln),
      k as (select * from sp where trim(w) <> '')""",
          select="""select media_id, (row_number() over (partition by media_id order by i, j) - 1)::int as ordinal, (i * 9000 + j * 100)::double / 1000 as start,
      (i * 9000 + j * 100 + 80)::double / 1000 as "end", w || ',' as text, (i % 2)::varchar as speaker from k"""),
)
def read_words_sentences(spark, d):
    def build(lines):
        sentences = F.transform(lines, lambda t, i: F.struct(
            (i % 2).cast("string").alias("speaker_id"),
            F.transform(F.split(t, " "), lambda w, j: F.struct(
                w.alias("text"), F.when(F.trim(w) != "", ",").otherwise("").alias("punctuation"),
                (i * 9000 + j * 100).alias("begin_time"), (i * 9000 + j * 100 + 80).alias("end_time"))).alias("words")))
        return F.to_json(F.struct(F.array(F.struct(sentences.alias("sentences"))).alias("transcripts")))
    return G.read_words_sentences(line_files(spark, d, build))


@query(
    "read_words_phrases",
    with_(LINES.replace('(text,', "(replace(text, 'ß', 's'),"), """sp as (select media_id, i, t, unnest(string_split(regexp_replace(t, '[^ ]$', ''), ' ')) as w,
        unnest(range(len(string_split(regexp_replace(t, '[^ ]$', ''), ' ')))) as j from ln),
      k as (select *, max(j) over (partition by media_id, i) as last from sp where w <> ''),
      o as (select *, row_number() over (partition by media_id order by i, j) - 1 as ordinal, row_number() over (partition by media_id, i order by j desc) as back from k)""",
          select="""select media_id, ordinal::int as ordinal, (i * 9000 + j * 100)::double / 1000 as start, (i * 9000 + j * 100)::double / 1000 + 80::double / 1000 as "end",
      w || case when back > 1 then ' ' else right(t, 1) || ' ' end as text, (i % 2)::varchar as speaker from o"""),
)
def read_words_phrases(spark, d):
    # Tokens come in upper case and without the phrase's last character; casing and tail
    # must come back from the phrase.
    def build(lines):
        phrases = F.transform(lines, lambda t, i: F.struct(
            (i % 2).cast("string").alias("speaker"), t.alias("text"),
            F.transform(F.split(F.regexp_replace(t, "[^ ]$", ""), " "), lambda w, j: F.struct(
                F.upper(w).alias("text"), (i * 9000 + j * 100).alias("offsetMilliseconds"),
                F.lit(80).alias("durationMilliseconds"))).alias("words")))
        return F.to_json(F.struct(phrases.alias("phrases")))
    return G.read_words_phrases(line_files(spark, d, build, F.regexp_replace("text", "ß", "s")))


def log_table(spark, d):
    """One log line per event: speech spans, cues, progress, noise."""
    iv = V.intervals(spark, d)
    k = F.col("ordinal")
    clock = lambda s, sep: F.concat(
        F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((s % 60).cast("string"), 2, "0"), F.lit(sep), F.lit("250"))
    s = F.floor("start")
    line = (
        F.when(k % 4 == 0, F.format_string("VAD segment %d: start = %.3f, end = %.3f", k, F.col("start"), F.when(k % 8 == 4, F.col("start") - 1).otherwise(F.col("end"))))
        .when(k % 4 == 1, F.concat(F.lit("[ "), clock(s, ","), F.lit(" --> "), clock(s + F.when(k % 8 == 5, 0).otherwise(2), "."), F.lit(" ]  "), "source", F.lit(" ")))
        .when(k % 4 == 2, F.concat(F.lit("whisper: progress = "), (k % 120).cast("string"), F.lit("%")))
        .otherwise(F.concat(F.lit("[download]  ~ "), (k % 100).cast("string"), F.lit(".5% of")))
    )
    return iv.select("media_id", "ordinal", line.alias("line"))


@query(
    "read_vad_log",
    with_(V.IV, select="""select media_id, round(start + 100, 3) as start,
      round("end" + 100, 3) as "end" from iv where ordinal % 8 = 0"""),
)
def read_vad_log(spark, d):
    return G.read_vad_log(log_table(spark, d), offset=100.0)


@query(
    "read_cue_log",
    with_(V.IV, select="""select media_id, ordinal, floor(start) + 0.25::double as start, floor(start) + case when ordinal % 8 = 5 then 0 else 2 end + 0.25::double as "end", source
      from iv where ordinal % 4 = 1"""),
)
def read_cue_log(spark, d):
    return G.read_cue_log(log_table(spark, d))


@query(
    "read_progress_log",
    with_(V.IV, select="""select media_id, ordinal, case when ordinal % 4 = 2 then least(100, ordinal % 120)::double / 100 else (ordinal % 100 + 0.5)::double / 100 end as progress
      from iv where ordinal % 4 >= 2"""),
)
def read_progress_log(spark, d):
    return G.read_progress_log(log_table(spark, d))


def trace_lines(spark, d, dialect):
    e = V.table(spark, d, "events")
    k = F.col("event_id")
    ident = F.concat(F.lit("i"), k.cast("string"))
    js = lambda *c: F.to_json(F.struct(*c))
    lit = lambda v, n: F.lit(v).alias(n)
    if dialect == "items":
        item = lambda kind, *c: F.struct(lit(kind, "type"), ident.alias("id"), *c).alias("item")
        line = (
            F.when(k % 4 == 0, js(lit("item.completed", "type"), item("agent_message", F.col("props").alias("text"))))
            .when(k % 4 == 1, js(lit("item.started", "type"), item("command_execution", F.col("event_type").alias("command"))))
            .when(k % 4 == 2, js(lit("item.completed", "type"), item("tool_call", lit("srv", "server"), F.col("event_type").alias("tool"), F.col("props").alias("result"))))
            .otherwise("not json")
        )
    elif dialect == "blocks":
        block = lambda *c: F.struct(F.array(F.struct(*c)).alias("content")).alias("message")
        line = (
            F.when(k % 3 == 0, js(lit("assistant", "type"), block(lit("text", "type"), F.col("event_type").alias("text"))))
            .when(k % 3 == 1, js(lit("assistant", "type"), block(lit("tool_use", "type"), ident.alias("id"), F.col("event_type").alias("name"), F.struct(k.alias("k")).alias("input"))))
            .otherwise(js(lit("user", "type"), block(lit("tool_result", "type"), ident.alias("tool_use_id"), F.col("props").alias("content"))))
        )
    else:
        line = (
            F.when(k % 3 == 0, js(lit("tool_use", "type"), ident.alias("tool_id"), F.col("event_type").alias("tool_name")))
            .when(k % 3 == 1, js(lit("tool_result", "type"), ident.alias("tool_id"), lit("error", "status"), F.struct(F.col("event_type").alias("message")).alias("error")))
            .otherwise(js(lit("error", "type"), F.when(k % 2 == 0, "warning").otherwise("fatal").alias("severity"), F.col("event_type").alias("message")))
        )
    return e.select("event_id", line.alias("line"))


@query(
    "traces_items",
    """select event_id, 0 as n, case event_id % 4 when 0 then 'agent_message' when 1 then 'tool_start' else 'tool_result' end as kind,
      case event_id % 4 when 0 then props when 1 then 'Run ' || event_type else 'Call srv.' || event_type end as message, 'i' || event_id as event_id_,
      case event_id % 4 when 2 then props end as detail from events where event_id % 4 <> 3""",
)
def traces_items(spark, d):
    out = TR.normalize_traces(trace_lines(spark, d, "items").withColumnRenamed("event_id", "row"), "items")
    return out.select(F.col("row").alias("event_id"), "n", "kind", "message", F.col("event_id").alias("event_id_"), "detail")


@query(
    "traces_blocks",
    """select event_id as row, 0 as n, case event_id % 3 when 0 then 'agent_message' when 1 then 'tool_start' else 'tool_result' end as kind,
      case event_id % 3 when 0 then event_type when 1 then 'Call ' || event_type else 'Tool result' end as message,
      case when event_id % 3 > 0 then 'i' || event_id end as event_id, case event_id % 3 when 1 then 'k: ' || event_id when 2 then props end as detail from events""",
)
def traces_blocks(spark, d):
    return TR.normalize_traces(trace_lines(spark, d, "blocks").withColumnRenamed("event_id", "row"), "blocks")


@query(
    "traces_stream",
    """select event_id as row, 0 as n, case event_id % 3 when 0 then 'tool_start' when 1 then 'tool_result' when 2 then case when event_id % 2 = 0 then 'warning' else 'error' end end as kind,
      case event_id % 3 when 0 then 'Call ' || event_type when 1 then 'Tool error' else event_type end as message,
      case when event_id % 3 < 2 then 'i' || event_id end as event_id, case event_id % 3 when 1 then event_type end as detail from events""",
)
def traces_stream(spark, d):
    return TR.normalize_traces(trace_lines(spark, d, "stream").withColumnRenamed("event_id", "row"), "stream")


@query("append_audit", "select event_id, props as payload, cast(event_id // 2 as double) as base from events union all select event_id, props, cast(event_id // 2 as double) from events where event_id % 2 = 0")
def append_audit(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.col("props").alias("payload"), F.floor(F.col("event_id") / 2).cast("double").alias("base"))
    path = scratch_dir(spark, "audit")
    S.append_audit(e, path)
    S.append_audit(e.where("event_id % 2 = 0"), path)
    return spark.read.schema(e.schema).parquet(path)


@query(
    "written_ass_files",
    with_(V.IV, select="select media_id, 'source' as artifact, count(*) as dialogues from iv group by media_id"),
)
def written_ass_files(spark, d):
    path = scratch_dir(spark, "ass")
    S.write_ass(S.render_ass(S.cue_events(V.intervals(spark, d), "source")), path)
    back = spark.read.schema("value string, artifact string, media_id long").text(path)
    return back.where("value like 'Dialogue:%'").groupBy("media_id", "artifact").agg(F.count(F.lit(1)).alias("dialogues"))
