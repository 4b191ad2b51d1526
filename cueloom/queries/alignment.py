"""Queries that move cue boundaries to speech, and plan and merge chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import align as A
from cueloom.operators import chunks as K
from cueloom.operators import intervals as I
from cueloom.queries import views as V
from cueloom.queries.registry import query, with_
from cueloom.session import materialize, scratch_dir
from cueloom.sources import pcm

STARTS = """lagged as (select *, lag("end") over (partition by media_id order by ordinal) as pe from ecues),
  st as (select c.*, (select max(r) from speech s where s.media_id = c.media_id and s.l <= c.start + 0.04::double
        and s.r >= c.start - 0.04::double) - start > 0.8::double as enough,
      (select min(l) from speech s where s.media_id = c.media_id and s.r >= c.start - 0.04::double
        and s.l <= least(c."end", c.start + 2) and (pe is null or s.l >= pe + 0.04::double)) as cand
    from lagged c),
  moved as (select *, case when coalesce(enough, false) then start when cand is not null then greatest(start, cand) end as ns from st),
  started as (select *, case when crosstalk then start else least(greatest(start, coalesce(ns, start)), "end") end as start2,
      case when crosstalk then null when ns is null then 0.35::double when ns > start + 0.02::double then 0.9::double else 0.75::double end as conf,
      not crosstalk and ns is null as low from moved)"""


@query(
    "align_starts",
    with_(V.IV, V.VAD, V.CUES, STARTS, select="""select media_id, id, start2 as start, conf as timing_confidence,
      low as low_confidence, 'whisper-vad' as align_backend from started"""),
)
def align_starts(spark, d):
    out = A.align_starts(V.event_cues(spark, d), V.vad(spark, d))
    return out.select("media_id", "id", "start", "timing_confidence", "low_confidence", "align_backend")


@query(
    "refine_ends",
    with_(V.IV, V.VAD, V.CUES, STARTS, """nx as (select *, lead(start2) over (partition by media_id order by ordinal) as nxt from started),
      cd as (select n.media_id, n.id, min_by(r, (abs(r - "end"), -r)) as r from nx n join speech s on s.media_id = n.media_id
        and abs(r - "end") <= 1 + 1e-9::double and l <= "end" + 0.04::double and r >= start2 and (nxt is null or r <= nxt)
        group by n.media_id, n.id)""",
          select="""select n.media_id, n.id, start2 as start, case when crosstalk then "end"
        else greatest(start2, coalesce(r, "end")) end as "end" from nx n left join cd using (media_id, id)"""),
)
def refine_ends(spark, d):
    return A.align_to_speech(V.event_cues(spark, d), V.vad(spark, d)).select("media_id", "id", "start", "end")


@query(
    "trim_long_silence",
    with_(V.IV, V.VAD, V.CUES, """long as (select media_id, id, ordinal, start, "end" + ordinal % 4 * 10 as "end", speaker from c0),
      lx as (select a.*, coalesce(exists (select 1 from long b where b.media_id = a.media_id and b.start < a."end"
        and a.start < b."end" and a.speaker <> b.speaker), false) as crosstalk from long a),
      sg as (select *, lag(r) over (partition by media_id order by l) as pr from speech),
      ht as (select c.media_id, c.id, max(l) as sil from lx c join sg on sg.media_id = c.media_id and l < c."end" and r > c.start
        and l - greatest(c.start, coalesce(pr, -1e18::double)) > 6 group by c.media_id, c.id)""",
          select="""select c.media_id, c.id, case when not crosstalk and sil is not null then greatest(start, sil - 3)
        else start end as start from lx c left join ht using (media_id, id)"""),
)
def trim_long_silence(spark, d):
    cues = V.event_cues(spark, d).withColumn("end", F.col("end") + F.col("ordinal") % 4 * 10)
    return A.trim_long_silence(cues, V.vad(spark, d)).select("media_id", "id", "start")


def token_cues(spark, d):
    """Cues whose two leading tokens are placed from the cue's number alone."""
    ms = (F.col("ordinal") * 7919) % 3000000
    cues = V.event_cues(spark, d)
    stamp = lambda x: x.cast("string")
    token = lambda text, lo, hi: F.struct(
        F.lit(text).alias("text") if isinstance(text, str) else text.alias("text"),
        lo.alias("offset_from"), hi.alias("offset_to"),
        F.lit(None).cast("string").alias("stamp_from"), F.lit(None).cast("string").alias("stamp_to"),
    )
    word = F.when(F.col("ordinal") % 2 == 0, "a").otherwise("word")
    tokens = F.array(
        token("[_BEG_]", F.lit("0"), F.lit("0")),
        token(word, stamp(ms), stamp(ms + 400)),
        token("next", stamp(ms + 400), stamp(ms + 1900)),
    )
    return A._with_previous_end(cues).withColumns({
        "end": F.col("end") + 40000, "speaker": F.lit(None).cast("string"), "lead": A.leading_tokens(tokens),
    })


@query(
    "long_silence_starts",
    with_(V.IV, V.VAD, """tl as (select *, lead(l) over w as nl, sum(r - l + 0.1::double) over (w rows unbounded preceding)
          + (row_number() over w - 1) * 0.1::double as ss from speech window w as (partition by media_id order by l)),
      tm as (select *, ss + 0.1::double as se, ss - (r - l + 0.1::double) as ps from tl where nl is not null),
      c as (select media_id, id, start, "end" + 40000 as "end", lag("end") over (partition by media_id order by ordinal) as pe,
        ((ordinal * 7919) % 3000000)::double / 1000 as ts, ((ordinal * 7919) % 3000000 + 400)::double / 1000 as te,
        ((ordinal * 7919) % 3000000 + 1900)::double / 1000 as t2,
        case when ordinal % 2 = 0 then 0.0::double else 0.32::double end as thr
        from iv where event_type not in ('click', 'purchase')),
      cr as (select c.media_id, c.id, max(nl) as nl from c join tm on tm.media_id = c.media_id and ts <= ss + 1e-9::double
        and te + 1e-9::double >= se and nl - r + 1e-9::double >= thr and (pe is null or nl >= pe + 0.04::double) and nl <= c."end"
        group by c.media_id, c.id)""",
          select="select media_id, id, nl as silence_start_at from cr"),
)
def long_silence_starts(spark, d):
    timeline = A.compressed_timeline(I.coalesce_intervals(V.vad(spark, d), A.TOL))
    return A.long_silence_starts(token_cues(spark, d), timeline)


def scored_words(cues, windows):
    """Scored words for every attempt, good and bad by the cue's number."""
    k = F.col("k")
    parts = windows.join(cues.select("media_id", "id", F.col("ordinal").alias("k")), ["media_id", "id"])
    length = F.col("window_end") - F.col("window_start")
    n = F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = parts.withColumn("pos", n)
    edge = F.when((k % 5 == 0) & (F.col("attempt") == 1), 0.0).otherwise(0.25)
    start = length * (edge + F.col("pos") * 0.1)
    return rows.select(
        "media_id", "id", "attempt",
        F.when(k % 7 == 0, F.floor(F.col("pos") / 2)).otherwise(0).alias("segment"), "pos",
        F.concat(F.lit("w"), F.col("pos").cast("string")).alias("word"), start.alias("start"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(start + length * 0.05).alias("end"),
        F.when((k % 13 == 0) & (F.col("pos") == 0), 0.0).otherwise(0.5 + F.col("pos") / 10).alias("score"),
        F.lit("part").alias("segment_text"),
    )


ATTEMPTS = """av as (select media_id, max("end") * 0.9::double as duration from ecues group by media_id),
  wn as (select e.media_id, id, ordinal as k, attempt, greatest(0::double, start - case attempt when 1 then 0.2::double else 2.0::double end) as ws,
      least(duration, "end" + case attempt when 1 then 0.5::double else 2.0::double end) as we, duration
    from ecues e join av using (media_id) cross join (values (1), (2)) t(attempt) where not crosstalk),
  sw as (select *, (we - ws) * (case when k % 5 = 0 and attempt = 1 then 0.0::double else 0.25::double end + pos * 0.1::double) as s
    from wn cross join (values (0), (1), (2), (3)) p(pos)),
  sc as (select *, case when k % 11 = 0 then null else s + (we - ws) * 0.05::double end as e,
      case when k % 13 = 0 and pos = 0 then 0.0::double else 0.5::double + pos::double / 10 end as score from sw),
  jd as (select media_id, id, k, attempt, ws, we, case when we <= ws then 'failed' when k % 13 = 0 then 'zero-first-token-score'
      when k % 11 = 0 or bool_or(e < s or s + ws < 0 or e + ws > duration + 1e-6::double) then 'failed'
      when (ws > 0.05::double and min(s + ws) <= ws + 0.05::double) or (we < duration - 0.05::double and max(e + ws) >= we - 0.05::double)
        then 'boundary-clipped' else 'success' end as outcome
    from sc group by media_id, id, k, attempt, ws, we, duration)"""


@query(
    "judge_attempts",
    with_(V.IV, V.CUES, ATTEMPTS, select="select media_id, id, attempt, ws as window_start, we as window_end, outcome from jd"),
)
def judge_attempts(spark, d):
    cues = V.event_cues(spark, d)
    windows = A.attempt_windows(cues, V.durations(cues, 0.9))
    return A.judge_attempts(windows, scored_words(cues, windows))


@query(
    "select_alignment",
    with_(V.IV, V.CUES, ATTEMPTS, """ch as (select media_id, id, min(attempt) as attempt from jd where outcome = 'success' group by media_id, id),
      hs as (select media_id, id, array_to_string(list(outcome order by attempt), ',') as attempts from jd left join
        (select media_id, id, attempt as last from ch) using (media_id, id) where last is null or attempt <= last group by media_id, id),
      al as (select media_id, id, case when k % 7 = 0 then pos // 2 else 0 end as segment, min(s + ws) as s, max(e + ws) as e, avg(score) as score
        from sc join ch using (media_id, id, attempt) group by media_id, id, segment)""",
          select="""select c.media_id, c.id, segment::bigint as segment, case when al.s is not null then al.s when crosstalk then start else start + 0.01::double end as start,
        case when al.s is not null then al.e else "end" end as "end", round(case when al.s is not null then score when crosstalk then null else 0.75::double end, 9) as timing_confidence,
        case when count(al.s) over (partition by c.media_id, c.id) > 1 then 'part' else source end as source,
        case when al.s is not null then 'whisperx' when not crosstalk then 'vad-fallback' end as align_backend, attempts
      from ecues c left join al using (media_id, id) left join hs using (media_id, id)"""),
)
def select_alignment(spark, d):
    cues = V.event_cues(spark, d)
    windows = A.attempt_windows(cues, V.durations(cues, 0.9))
    fallback = cues.withColumns({"start": F.col("start") + 0.01, "timing_confidence": F.lit(0.75)})
    out = A.select_alignment(cues, windows, scored_words(cues, windows), fallback)
    return out.select(
        "media_id", "id", F.col("segment").cast("long").alias("segment"), "start", "end",
        F.round("timing_confidence", 9).alias("timing_confidence"),
        "source", "align_backend", F.array_join("attempts", ",").alias("attempts"),
    )


@query(
    "rejected_word_audit",
    with_(V.IV, V.CUES, ATTEMPTS, select="""select sc.media_id, sc.id, sc.attempt, case when sc.k % 7 = 0 then pos // 2 else 0 end::bigint as segment, pos,
      'w' || pos as word, case when s + sc.ws >= 0 and s + sc.ws <= duration + 1e-6::double then s + sc.ws end as start,
      case when e + sc.ws >= 0 and e + sc.ws <= duration + 1e-6::double then e + sc.ws end as "end", score
      from sc join jd on jd.media_id = sc.media_id and jd.id = sc.id and jd.attempt = sc.attempt where outcome = 'zero-first-token-score'"""),
)
def rejected_word_audit(spark, d):
    cues = V.event_cues(spark, d)
    windows = A.attempt_windows(cues, V.durations(cues, 0.9))
    out = A.rejected_word_audit(windows, scored_words(cues, windows))
    return out.withColumn("segment", F.col("segment").cast("long"))


@query(
    "mean_word_score",
    with_(V.IV, V.CUES, ATTEMPTS, select="""select media_id, id, attempt, case when k % 7 = 0 then pos // 2 else 0 end::bigint as segment,
      round(avg(score), 9) as score from sc group by media_id, id, attempt, 4"""),
)
def mean_word_score(spark, d):
    cues = V.event_cues(spark, d)
    windows = A.attempt_windows(cues, V.durations(cues, 0.9))
    out = A.mean_score(scored_words(cues, windows), by=("media_id", "id", "attempt", "segment"))
    return out.select("media_id", "id", "attempt", F.col("segment").cast("long").alias("segment"), F.round("score", 9).alias("score"))


# --- chunks ---

MEDIA = """md as (select l_orderkey as media_id, sum(l_quantity)::bigint * 1000 as frames, 100 as rate, 2 as bytes_per_frame,
      (30 + l_orderkey % 90)::double as max_seconds, ((l_orderkey % 80)::double / 2) as overlap_seconds,
      (20000 + l_orderkey % 7000)::bigint as max_bytes from lineitem group by l_orderkey),
  cp0 as (select *, (max_bytes - 45) // bytes_per_frame as by_size from md),
  cp1 as (select *, (ceil(least(max_seconds * rate, (by_size + 1)::double)) - 1)::bigint as c1 from cp0),
  cp2 as (select *, case when c1::double / rate >= max_seconds then c1 - 1 else c1 end as cap,
      overlap_seconds * rate as raw, round_even(overlap_seconds * rate, 0)::bigint as ov from cp1)"""


def media_table(spark, d):
    li = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(
        (F.sum("l_quantity").cast("long") * 1000).alias("frames")
    )
    return li.withColumns({
        "rate": F.lit(100), "bytes_per_frame": F.lit(2),
        "max_seconds": (30 + F.col("media_id") % 90).cast("double"),
        "overlap_seconds": (F.col("media_id") % 80) / 2,
        "max_bytes": 20000 + F.col("media_id") % 7000,
    })


@query(
    "plan_chunks",
    with_(MEDIA, """pc as (select *, case when frames <= cap then 1 else ceil((frames - cap)::double / (cap - ov))::bigint + 1 end as n
        from cp2 where frames > 0 and cap > 0 and raw < cap and ov < cap),
      px as (select *, unnest(range(n)) as chunk from pc)""",
          select="""select media_id, chunk, chunk * (cap - ov) as start_frame, least(frames, chunk * (cap - ov) + cap) as end_frame, rate from px"""),
)
def plan_chunks(spark, d):
    return K.plan_chunks(media_table(spark, d))


@query(
    "rejected_plans",
    with_(MEDIA, select="""select media_id, case when frames <= 0 or cap <= 0 then 'needs nonempty audio and a limit of at least one frame'
      else 'overlap must be smaller than the chunk length' end as problem from cp2
      where frames <= 0 or cap <= 0 or raw >= cap or ov >= cap"""),
)
def rejected_plans(spark, d):
    return K.rejected_plans(media_table(spark, d))


def chunked_words(spark, d):
    """Each recording cut to overlapping chunks, words copied to every chunk they touch.

    Later renderings drift by some hundredths of a second, labels differ per chunk, and a
    word in nine is missed, so that matching, mapping and ownership all have work to do.
    """
    words = V.words(spark, d)
    plan = K.plan_chunks(
        V.durations(words, 1.0).select(
            "media_id", (F.col("duration") * 100).cast("long").alias("frames"), F.lit(100).alias("rate"),
            F.lit(2).alias("bytes_per_frame"), F.lit(60.0).alias("max_seconds"),
            F.lit(25.0).alias("overlap_seconds"), F.lit(10000000).cast("long").alias("max_bytes"),
        )
    )
    # 5999 frames per chunk, 2500 of overlap: chunk k starts at k * 34.99 s.
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - 59.99) / 34.99))
    last = F.floor(F.col("start") / 34.99)
    # Chunks are numbered without gaps, so the last one of each recording bounds the words.
    ends = plan.groupBy("media_id").agg(F.max("chunk").alias("end_chunk"))
    placed = words.withColumn("chunk", F.explode(F.sequence(first, last))).join(
        F.broadcast(ends), "media_id"
    ).where("chunk <= end_chunk")
    placed = placed.where((F.col("ordinal") + F.col("chunk") * 5) % 9 != 0)
    drift = F.col("chunk") % 3 * 0.05
    local = F.concat(
        F.lit("s"),
        ((F.ascii(F.substr("speaker", F.lit(1), F.lit(1))) + F.col("chunk")) % 26).cast("string"),
    )
    base = F.col("chunk") * 34.99
    rows = placed.select(
        "media_id", "chunk", F.col("ordinal").cast("long").alias("pos"),
        (F.round((F.col("start") - base + drift) * 1000) / 1000).alias("start"),
        (F.round((F.col("end") - base + drift) * 1000) / 1000).alias("end"), "text",
        F.when(F.col("speaker").isNotNull(), local).alias("speaker"),
    )
    return plan, rows


# The chunks of ``chunked_words``, its words in absolute time, and their matches.
CHUNKED = """du as (select media_id, max("end") as d, floor(max("end") * 100)::bigint as frames from words group by media_id),
  ck as (select media_id, frames, unnest(range(case when frames <= 5999 then 1 else (frames - 5999 + 3498) // 3499 + 1 end)) as chunk from du),
  ct as (select *, lag(c_end) over w as prev_end, lead(c_start) over w as next_start from (select media_id, chunk, (chunk * 3499) / 100.0::double as c_start,
      least(frames, chunk * 3499 + 5999) / 100.0::double as c_end from ck) window w as (partition by media_id order by chunk)),
  cx as (select *, unnest(range(greatest(0, ceil((start - 59.99::double) / 34.99::double)::bigint), floor(start / 34.99::double)::bigint + 1)) as chunk from words),
  cr as (select media_id, chunk, ordinal::bigint as pos, text, c_start, c_end, prev_end, next_start,
      round((start - chunk * 34.99::double + chunk % 3 * 0.05::double) * 1000) / 1000 + c_start as start,
      round(("end" - chunk * 34.99::double + chunk % 3 * 0.05::double) * 1000) / 1000 + c_start as "end",
      case when speaker is not null then 's' || ((ascii(speaker[1]) + chunk) % 26) end as speaker
    from cx join ct using (media_id, chunk) where (ordinal + chunk * 5) % 9 <> 0),
  cy as (select *, regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[^\\p{L}\\p{N}]', '', 'g') as key from cr),
  mr as (select media_id, chunk as k, key, start, "end", count(*) as n, min(pos) as pos from cy
    where key <> '' and c_start < prev_end and "end" >= c_start and start <= prev_end group by all),
  ml as (select media_id, chunk + 1 as k, key, start, "end", count(*) as n, min(pos) as pos from cy
    where key <> '' and next_start < c_end and "end" >= next_start and start <= c_end group by all),
  mp as (select r.media_id, r.k as chunk, r.pos, l.pos as prev_pos, r.n as rn, l.n as ln, abs(l.start - r.start) + abs(l."end" - r."end") as d
    from ml l join mr r on l.media_id = r.media_id and l.k = r.k and l.key = r.key and r.start - 0.6::double <= l.start
      and l.start <= r.start + 0.6::double and abs(l."end" - r."end") <= 0.6::double),
  mk as (select *, row_number() over fr as r1, lead(d) over fr as r2, row_number() over fl as l1, lead(d) over fl as l2 from mp
    window fr as (partition by media_id, chunk, pos order by d, prev_pos), fl as (partition by media_id, chunk, prev_pos order by d, pos)),
  ma as (select media_id, chunk, pos, prev_pos from mk where r1 = 1 and l1 = 1 and rn = 1 and ln = 1
    and not coalesce(abs(r2 - d) <= greatest(1e-6::double, 1e-9::double * greatest(r2, d)), false)
    and not coalesce(abs(l2 - d) <= greatest(1e-6::double, 1e-9::double * greatest(l2, d)), false))"""
# Labels linked to one of the chunk before, and the number each chain gets.
SPEAKERS = """vo as (select m.media_id, m.chunk, a.speaker, b.speaker as prev, count(*) as votes from ma m
      join cr a on a.media_id = m.media_id and a.chunk = m.chunk and a.pos = m.pos join cr b on b.media_id = m.media_id and b.chunk = m.chunk - 1 and b.pos = m.prev_pos
    where a.speaker is not null and b.speaker is not null group by all),
  ac as (select * from (select *, count(*) over (partition by media_id, chunk, speaker) as choices, count(*) over (partition by media_id, chunk, prev) as voters from vo)
    where choices = 1 and voters = 1 and votes >= 2),
  lb as (select media_id, chunk, speaker, min(pos) as first_pos from cr where speaker is not null group by all),
  lr as (select lb.media_id, lb.chunk, lb.speaker, lb.chunk as rc, lb.speaker as rs, first_pos as rp from lb left join ac using (media_id, chunk, speaker) where ac.prev is null union all
    select a.media_id, a.chunk, a.speaker, r.rc, r.rs, r.rp from lr r join ac a on a.media_id = r.media_id and a.chunk = r.chunk + 1 and a.prev = r.speaker),
  gs as (select media_id, chunk, speaker, (dense_rank() over (partition by media_id order by rc, rp, rs) - 1)::varchar as global_speaker from lr)"""
MERGED = """wr as (select cr.*, cr.chunk as rc, cr.pos as rp from cr left join ma using (media_id, chunk, pos) where ma.prev_pos is null union all
    select c.*, r.rc, r.rp from wr r join ma on ma.media_id = r.media_id and ma.chunk = r.chunk + 1 and ma.prev_pos = r.pos
      join cr c on c.media_id = ma.media_id and c.chunk = ma.chunk and c.pos = ma.pos),
  wo as (select wr.*, global_speaker, prev_end is null and next_start is null as single,
      coalesce((prev_end + c_start) / 2 <= (wr.start + wr."end") / 2, true) and coalesce((wr.start + wr."end") / 2 < (c_end + next_start) / 2, true) as owned
    from wr left join gs using (media_id, chunk, speaker)),
  wk as (select media_id, min_by({c: chunk, p: pos, s: start, e: "end", t: text, g: case when single then speaker else global_speaker end},
      {u: not owned, c: chunk, p: pos}) as w from wo group by media_id, rc, rp having max(owned) or count(*) > 1)"""


@query("match_overlap_words", with_(V.WORDS, CHUNKED, select="select * from ma"))
def match_overlap_words(spark, d):
    plan, rows = chunked_words(spark, d)
    return K.match_overlap_words(K._absolute(rows, K._chunk_times(plan)))


@query("map_chunk_speakers", with_(V.WORDS, CHUNKED, SPEAKERS, recursive=True, select="select * from gs"))
def map_chunk_speakers(spark, d):
    plan, rows = chunked_words(spark, d)
    absolute = materialize(K._keyed(K._absolute(rows, K._chunk_times(plan))))
    return K.map_speakers(absolute, materialize(K._matches(absolute, ["speaker"])))


@query(
    "merge_chunks",
    with_(V.WORDS, CHUNKED, SPEAKERS, MERGED, recursive=True, select="""select media_id, row_number() over (partition by media_id order by w.s, w.e, w.c, w.p) - 1 as ordinal,
      w.s as start, w.e as "end", w.t as text, w.g as speaker from wk"""),
)
def merge_chunks(spark, d):
    plan, rows = chunked_words(spark, d)
    return K.merge_chunks(plan, rows)


@query(
    "detected_language",
    """select source as media_id, min_by(lang, doc_id) as language from documents where doc_id % 3 <> 0 and lang <> ''
       group by source""",
)
def detected_language(spark, d):
    docs = V.table(spark, d, "documents")
    return K.detected_language(docs.select(
        F.col("source").alias("media_id"), F.col("doc_id").alias("chunk"),
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("language"),
    ))


@query(
    "resume_by_fingerprint",
    with_(V.SAMPLES, """fp as (select media_id, count(*) as frames, sha256(unhex(string_agg(printf('%02x%02x',
        ((sample + 65536) % 256)::int, ((sample + 65536) // 256 % 256)::int), '' order by i))) as sha256 from samples group by media_id)""",
          select="""select media_id::varchar as media_id, sha256, frames, case media_id when 0 then 'reuse' when 1 then 'different audio' else 'new' end as decision,
      case media_id when 0 then 4 when 1 then 0 else 9 end as chunks_to_do from fp"""),
)
def resume_by_fingerprint(spark, d):
    """Recordings as files: one written again in other parts, one changed in its last sample, one new."""
    samples = V.samples(spark, d)
    inputs = pcm.fingerprints(pcm.write_pcm(samples, scratch_dir(spark, "pcm"), 100)).withColumn("request", F.lit("r"))
    last = samples.groupBy("media_id").agg(F.max("i").alias("last"))
    edited = F.when((F.col("i") == F.col("last")) & (F.col("media_id") == 1), F.col("sample") + 1).otherwise(F.col("sample"))
    before = samples.join(last, "media_id").where("media_id < 2").withColumn("sample", edited).where("i <= last")
    manifest = pcm.fingerprints(pcm.write_pcm(before.coalesce(1), scratch_dir(spark, "pcm"), 100)).withColumn("request", F.lit("r"))
    plan = inputs.select("media_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("chunk"))
    resumed = K.resume_plan(inputs, manifest, plan, plan.where("chunk % 2 = 0"))
    return resumed.join(inputs.select("media_id", "sha256", "frames"), "media_id")


@query(
    "resume_plan",
    """with i as (select doc_id as media_id, 'r' || (doc_id % 5) as request, sha256(text) as sha256, n_chars * 100 as frames from documents),
      m as (select doc_id as media_id, 'r' || case when doc_id % 10 = 3 then 9 else doc_id % 5 end as request,
        sha256(case when doc_id % 7 = 2 then text || '!' else text end) as sha256, n_chars * 100 as frames from documents where doc_id % 4 <> 0),
      p as (select doc_id as media_id, (n_chars * 100 + 59999) // 60000 as n,
        (n_chars * 100 + 59999) // 60000 - ((n_chars * 100 + 59999) // 60000 + 1) // 2 as todo from documents)
    select i.media_id, case when m.request is null then 'new' when i.request <> m.request then 'different request settings'
        when i.sha256 <> m.sha256 then 'different audio' else 'reuse' end as decision,
      case when m.request is null then p.n when i.request <> m.request or i.sha256 <> m.sha256 then 0 else todo end as chunks_to_do
    from i left join m using (media_id) join p using (media_id)""",
)
def resume_plan(spark, d):
    docs = V.table(spark, d, "documents").withColumn("media_id", F.col("doc_id"))
    shape = {"frames": F.col("n_chars") * 100, "rate": F.lit(100), "width": F.lit(2)}
    inputs = docs.withColumns(shape).select(
        "media_id", F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("request"),
        F.sha2("text", 256).alias("sha256"), "frames", "rate", "width",
    )
    edited = F.when(F.col("doc_id") % 7 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    number = F.when(F.col("doc_id") % 10 == 3, 9).otherwise(F.col("doc_id") % 5)
    manifest = docs.where("doc_id % 4 <> 0").withColumns(shape).select(
        "media_id", F.concat(F.lit("r"), number.cast("string")).alias("request"),
        F.sha2(edited, 256).alias("sha256"), "frames", "rate", "width",
    )
    n = F.floor((F.col("n_chars") * 100 + 59999) / 60000)
    plan = docs.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return K.resume_plan(inputs, manifest, plan, plan.where("chunk % 2 = 0"))
