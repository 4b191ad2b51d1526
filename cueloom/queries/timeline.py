"""Queries over intervals, words and cues: aggregates, windows, segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions.text import wide_ranges
from cueloom.operators import cues as C
from cueloom.operators import intervals as I
from cueloom.operators import reconcile as R
from cueloom.operators import words as W
from cueloom.queries import views as V
from cueloom.queries.registry import query, with_
from cueloom.session import materialize, scratch_dir
from cueloom.sources import pcm
from cueloom.sources.signals import rms_levels, slice_signal

WIDE = wide_ranges()


def weight_sql(s: str) -> str:
    return f"(length({s}) + length(regexp_replace({s}, '[^{WIDE}]', '', 'g')))"


@query(
    "coalesce_intervals",
    with_(V.IV, """p as (select *, max("end") over (partition by media_id order by start, "end"
        rows between unbounded preceding and 1 preceding) as reach from iv),
      q as (select *, sum(case when reach is null or start > reach + 0.01::double then 1 else 0 end) over (
        partition by media_id order by start, "end" rows unbounded preceding) as g from p)""",
          select='select media_id, min(start) as start, max("end") as "end" from q group by media_id, g'),
)
def coalesce_intervals(spark, d):
    return I.coalesce_intervals(V.intervals(spark, d))


@query(
    "speech_coverage",
    with_(V.IV, V.VAD, select="""select media_id, count(*) as islands, round(sum(r - l), 3) as seconds
      from speech group by media_id"""),
)
def speech_coverage(spark, d):
    return (
        I.coalesce_intervals(V.vad(spark, d), I.ALIGN_TOLERANCE)
        .groupBy("media_id")
        .agg(F.count(F.lit(1)).alias("islands"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))
    )


@query(
    "crosstalk",
    with_(V.IV, select="""select distinct a.media_id, a.id from iv a join iv b on a.media_id = b.media_id
      and a.start < b."end" and b.start < a."end" and a.speaker <> b.speaker"""),
)
def crosstalk(spark, d):
    return I.crosstalk(V.intervals(spark, d))


@query(
    "index_quantile",
    with_(V.SAMPLES, """o as (select *, row_number() over (partition by media_id order by rms) as rn,
        count(*) over (partition by media_id) as n from levels)""",
          select="select media_id, rms as quantile from o where rn = least(n, cast(floor(n * 0.2::double) as bigint) + 1)"),
)
def index_quantile(spark, d):
    return I.index_quantile(rms_levels(V.samples(spark, d)), "rms", 0.2)


@query(
    "activity_intervals",
    with_(V.SAMPLES, """o as (select *, row_number() over (partition by media_id order by rms) as rn,
        count(*) over (partition by media_id) as n from levels),
      lim as (select media_id, greatest(max(case when rn = least(n, cast(floor(n * 0.15::double) as bigint) + 1) then rms end) * 3.0::double,
        max(rms) * 0.035::double, 8.0::double) as thr, max(rms) as peak from o group by media_id),
      act as (select media_id, win, win - row_number() over (partition by media_id order by win) as g
        from levels join lim using (media_id) where rms >= thr and peak > 0),
      runs as (select media_id, min(win) * 0.02::double as s, (max(win) + 1) * 0.02::double as e from act
        group by media_id, g having count(*) >= 3),
      m as (select *, max(e) over (partition by media_id order by s rows between unbounded preceding and 1 preceding) as reach from runs),
      k as (select *, sum(case when reach is null or s > reach + 0.04::double then 1 else 0 end)
        over (partition by media_id order by s rows unbounded preceding) as g from m)""",
          select='select media_id, min(s) as start, max(e) as "end" from k group by media_id, g'),
)
def activity_intervals(spark, d):
    return I.activity_intervals(rms_levels(V.samples(spark, d)))


@query("rms_levels", with_(V.SAMPLES, select="select media_id, win, rms from levels"))
def levels(spark, d):
    return rms_levels(V.samples(spark, d))


@query("pcm_file_levels", with_(V.SAMPLES, select="select media_id::varchar as media_id, win, rms from levels"))
def pcm_file_levels(spark, d):
    """The samples written to PCM files, and read back in ranges that cut windows apart."""
    parts = pcm.write_pcm(V.samples(spark, d), scratch_dir(spark, "pcm"), 100)
    return pcm.pcm_levels(parts, range_bytes=2 * 777)


@query(
    "slice_signal",
    with_(V.SAMPLES, select="""select media_id, i, sample, rate from samples
      where i >= round_even(0.125::double * rate, 0) and i < round_even(61.375::double * rate, 0)"""),
)
def sliced(spark, d):
    return slice_signal(V.samples(spark, d), 0.125, 61.375)


RATES = f"""rs as (select media_id, speaker, ("end" - start) / greatest(1, {weight_sql('trim(text)')}) as rate
    from words where "end" - start >= 0.05::double),
  ov as (select m.media_id, case when count(rate) >= 3 then median(rate) else 0.06::double end as overall
    from (select distinct media_id from words) m left join rs using (media_id) group by m.media_id),
  rates as (select media_id, speaker, case when count(*) >= 3 then median(rate) else any_value(overall) end as rate
    from rs join ov using (media_id) group by media_id, speaker)"""


@query(
    "speech_rates",
    with_(V.WORDS, RATES, select="select media_id, speaker, round(rate, 9) as rate from rates"),
)
def speech_rates(spark, d):
    return W.speech_rates(V.words(spark, d)).withColumn("rate", F.round("rate", 9))


@query(
    "speaker_counts",
    with_(V.WORDS, select="""select media_id, count(distinct coalesce(speaker, '')) as speakers
      from words group by media_id"""),
)
def speaker_counts(spark, d):
    return W.speaker_counts(V.words(spark, d))


SILENCES = """sl0 as (select media_id, ordinal, lead(start) over w - max("end") over w2 as gap from words
    window w as (partition by media_id order by ordinal),
      w2 as (partition by media_id order by ordinal rows unbounded preceding)),
  sil as (select media_id, ordinal, gap from sl0 where gap >= 0.8::double)"""


@query(
    "qualified_silences",
    with_(V.WORDS, SILENCES, select="select media_id, ordinal, round(gap, 6) as gap from sil"),
)
def qualified_silences(spark, d):
    return W.qualified_silences(V.words(spark, d)).withColumn("gap", F.round("gap", 6))


@query(
    "dispatchable_words",
    with_(V.WORDS, SILENCES, select="""select m.media_id, coalesce(max(ordinal) + 1, 0)::bigint as dispatchable
      from (select distinct media_id from words) m left join sil using (media_id) group by m.media_id"""),
)
def dispatchable_words(spark, d):
    return W.dispatchable(V.words(spark, d))


# The fold over words of one speaker, cut by pause, sentence end or length.
SEGMENT = f"""tr as (select *, coalesce(speaker, '') as s, row_number() over t as k,
      {weight_sql('text')} as full_w, {weight_sql('rtrim(text)')} as bare_w,
      start - lag("end") over t as gap,
      right(regexp_replace(rtrim(lag(text) over t), '["''”’»›』」）)\\]]+$', ''), 1) as pc
    from words window t as (partition by media_id, coalesce(speaker, '') order by ordinal)),
  seg as (select media_id, s, k, ordinal as first, start as s0, full_w as acc, false as done from tr where k = 1
    union all
    select n.media_id, n.s, n.k, case when cut then n.ordinal else first end,
      case when cut then n.start else s0 end, case when cut then n.full_w else acc + n.full_w end, false
    from (select tr.*, seg.first, seg.s0, seg.acc, (tr.gap >= 0.8::double or (tr.pc <> '' and contains('.?!。？！…', tr.pc))
        or (tr."end" - seg.s0 > 8 and 2 * (seg.acc + tr.bare_w) >= 84)
        or (seg.acc + tr.bare_w > 84 and 2 * (tr."end" - seg.s0) >= 8)) as cut
      from seg join tr on tr.media_id = seg.media_id and tr.s = seg.s and tr.k = seg.k + 1) n),
  pcues as (select seg.media_id, seg.s, seg.first, min_by(tr.start, tr.ordinal) as start,
      greatest(min_by(tr.start, tr.ordinal), max(tr."end")) as "end", max(tr.ordinal) as last,
      trim(string_agg(tr.text, '' order by tr.ordinal)) as source, any_value(tr.speaker) as speaker
    from seg join tr on tr.media_id = seg.media_id and tr.s = seg.s and tr.k = seg.k
    group by seg.media_id, seg.s, seg.first)"""


@query(
    "segment_words",
    with_(V.WORDS, SEGMENT, recursive=True, select="""select media_id, 'preview-' || row_number() over (
        partition by media_id order by start, "end", s) as id, start, "end", speaker, source,
        first as first_word, last as last_word from pcues where source <> ''"""),
)
def segment_words(spark, d):
    return W.segment_words(V.words(spark, d))


BATCHES = """tot as (select media_id, count(*) as n from words group by media_id),
  bt as (select media_id, 0::bigint as pos, n, 0::bigint as batch from tot
    union all
    select media_id, stop, n, batch + 1 from (
      select bt.*, case when n - pos <= 80 then n else coalesce(
        (select min_by(ordinal, (-gap, ordinal)) from sil where sil.media_id = bt.media_id and ordinal between pos + 19 and pos + 39),
        (select min(ordinal) from sil where sil.media_id = bt.media_id and ordinal between pos + 40 and pos + 78),
        pos + 79) + 1 end as stop from bt) where stop < n),
  fin as (select media_id, batch, pos, coalesce(lead(pos) over (partition by media_id order by pos), n) as stop, n from bt)"""


@query(
    "batch_words",
    with_(V.WORDS, SILENCES, BATCHES, recursive=True,
          select="""select media_id, batch, pos as first_ordinal, stop - 1 as last_ordinal,
        (n - pos > 80 and not exists (select 1 from sil where sil.media_id = fin.media_id
          and ordinal between pos + 19 and pos + 78)) as forced_end from fin"""),
)
def batch_words(spark, d):
    return W.batch_words(V.words(spark, d), 40)


@query(
    "uncovered_words",
    with_(V.WORDS, V.TURNS, select="""select media_id, ordinal from words w where not exists (
      select 1 from cues c where c.media_id = w.media_id and c.stable and w.ordinal between c.first_word and c.last_word)"""),
)
def uncovered_words(spark, d):
    return W.uncovered(V.words(spark, d), V.cues(spark, d).where("stable")).select("media_id", "ordinal")


@query(
    "coverage_report",
    with_(V.WORDS, V.TURNS, """miss as (select media_id, ordinal from words w where not exists (
      select 1 from cues c where c.media_id = w.media_id and c.stable and w.ordinal between c.first_word and c.last_word))""",
          select="""select w.media_id, count(*) as words, (select count(*) from miss where miss.media_id = w.media_id) as missing,
      (select array_to_string(list(ordinal order by ordinal)[1:20], ',') from miss where miss.media_id = w.media_id) as first_missing
      from words w group by w.media_id"""),
)
def coverage_report(spark, d):
    return W.coverage_report(V.words(spark, d), V.cues(spark, d).where("stable")).withColumn(
        "first_missing", F.array_join(F.col("first_missing").cast("array<string>"), ",")
    )


MISSING_BATCHES = """un as (select *, ordinal - row_number() over (partition by media_id order by ordinal) as run
        from words w where not exists (select 1 from cues c where c.media_id = w.media_id and c.stable
          and w.ordinal between c.first_word and c.last_word)),
      us as (select media_id, run, ordinal, lead(start) over (partition by media_id, run order by ordinal)
        - max("end") over (partition by media_id, run order by ordinal rows unbounded preceding) as gap from un),
      sil as (select * from us where gap >= 0.8::double),
      tot as (select media_id, run, min(ordinal) as base, max(ordinal) + 1 as n from un group by media_id, run),
      bt as (select media_id, run, base::bigint as pos, n from tot
        union all select media_id, run, stop, n from (
          select bt.*, case when n - pos <= 60 then n else coalesce(
            (select min_by(ordinal, (-gap, ordinal)) from sil where sil.media_id = bt.media_id and sil.run = bt.run and ordinal between pos + 14 and pos + 29),
            (select min(ordinal) from sil where sil.media_id = bt.media_id and sil.run = bt.run and ordinal between pos + 30 and pos + 58),
            pos + 59) + 1 end as stop from bt) where stop < n),
      fin as (select *, coalesce(lead(pos) over (partition by media_id, run order by pos), n) as stop from bt)"""
MISSING_ROWS = """select media_id, pos as first_ordinal, stop - 1 as last_ordinal, (n - pos > 60 and not exists (
        select 1 from sil where sil.media_id = fin.media_id and sil.run = fin.run and ordinal between pos + 14 and pos + 58)) as forced_end
      from fin"""


@query(
    "missing_word_batches",
    with_(V.WORDS, V.TURNS, MISSING_BATCHES, recursive=True, select=MISSING_ROWS),
)
def missing_word_batches(spark, d):
    return W.missing_word_batches(V.words(spark, d), V.cues(spark, d).where("stable"), 30)


def squeezed(words):
    """The last words of each sixth ordinal block shrink to 10 ms, as a cut-in would do."""
    hit = F.col("ordinal") % 50 >= 44
    return words.withColumn("end", F.when(hit, F.col("start") + 0.01).otherwise(F.col("end"))).withColumn(
        "speaker", F.when(F.col("ordinal") % 50 == 49, "other").otherwise(F.col("speaker"))
    )


# Cut-ins in order within each stretch of squeezed words of a speaker. ``tail`` is what a
# walk back from the present word would pass over; ``moved`` what the last cut-in spread.
REPAIRED = f"""words as (select * replace (case when ordinal % 50 >= 44 then start + 0.01::double else "end" end as "end",
      case when ordinal % 50 = 49 then 'other' else speaker end as speaker) from heard),
  {RATES},
  lim as (select media_id, max("end") * 0.99::double as lim from words group by media_id),
  ct as (select *, "end" - start < 0.05::double as sq, greatest(1, {weight_sql('trim(text)')}) as w, lead(ordinal) over m is not null
      and speaker is distinct from lead(speaker) over m and speaker is not null as cut from words window m as (partition by media_id order by ordinal)),
  tr as (select *, lead(start) over t as own, sq and not coalesce(lag(sq) over t, false) as opens from ct where speaker is not null
    window t as (partition by media_id, speaker order by ordinal)),
  ru as (select *, sum(opens::int) over (partition by media_id, speaker order by ordinal) as run from tr),
  qs as (select r.media_id, r.speaker, r.run, r.ordinal, r.start, r."end", r.w, r.cut, r.own, l.lim, coalesce(s.rate, o.overall) as rate,
      row_number() over (partition by r.media_id, r.speaker, r.run order by r.ordinal) as k
    from ru r join lim l on l.media_id = r.media_id left join rates s on s.media_id = r.media_id and s.speaker = r.speaker
      join ov o on o.media_id = r.media_id where r.sq),
  wk as (select media_id, speaker, run, 0::bigint as k, []::struct(o int, s double, e double, w bigint)[] as tail,
      []::struct(o int, s double, e double, w bigint)[] as moved from (select distinct media_id, speaker, run from qs) union all
    select media_id, speaker, run, k, case when hit then spread[coalesce(list_max(list_filter(range(1, len(spread) + 1),
        lambda i: spread[i].e - spread[i].s >= 0.05::double)), 0) + 1:] else passed end, case when hit then spread end
    from (select *, list_transform(range(1, len(passed) + 1), lambda i: {{
        o: passed[i].o, w: passed[i].w,
        s: passed[1].s + (until - passed[1].s) * coalesce(list_sum(list_transform(passed[1:i - 1], lambda x: x.w)), 0)::double / weight::double,
        e: passed[1].s + (until - passed[1].s) * list_sum(list_transform(passed[1:i], lambda x: x.w))::double / weight::double}})
          ::struct(o int, w bigint, s double, e double)[] as spread
      from (select *, cut and until > greatest(passed[1].s, "end") as hit
        from (select *, least(passed[1].s + weight * rate, passed[1].s + 5, coalesce(own, 'infinity'::double), lim) as until
          from (select *, list_sum(list_transform(passed, lambda x: x.w)) as weight
            from (select q.media_id, q.speaker, q.run, q.k, q.cut, q.own, q.lim, q.rate, q."end",
                list_append(f.tail, {{o: q.ordinal::int, s: q.start, e: q."end", w: q.w::bigint}}) as passed
              from wk f join qs q on q.media_id = f.media_id and q.speaker = f.speaker and q.run = f.run and q.k = f.k + 1)))))),
  mv as (select media_id, m.o as ordinal, arg_max(m.s, k) as s, arg_max(m.e, k) as e from (select media_id, k, unnest(moved) as m from wk) group by all)"""


@query(
    "repair_squeezed_words",
    with_(V.WORDS.replace("\nwords as (", "\nheard as ("), REPAIRED, recursive=True, select="""select media_id, ordinal, round(coalesce(s, start), 6) as start,
      round(coalesce(e, "end"), 6) as "end", text, speaker from words left join mv using (media_id, ordinal)"""),
)
def repair_squeezed(spark, d):
    words = squeezed(V.words(spark, d))
    repaired = W.repair_squeezed(words, V.durations(words, 0.99))
    return repaired.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query(
    "cue_timing_from_words",
    with_(V.WORDS, V.TURNS, select="""select c.media_id, c.id, min_by(w.start, w.ordinal) as start,
      greatest(min_by(w.start, w.ordinal), max(w."end")) as "end" from cues c join words w on w.media_id = c.media_id
      and w.ordinal between c.first_word and c.last_word and w.speaker is not distinct from c.speaker
      group by c.media_id, c.id"""),
)
def cue_timing(spark, d):
    return W.derive_cue_timing(V.words(spark, d), V.cues(spark, d))


@query(
    "context_tail",
    with_(V.WORDS, """x as (select *, max(ordinal) over (partition by media_id) as last from words)""",
          select="""select media_id, right(trim(string_agg(text, '' order by ordinal)), 500) as tail
      from x where ordinal > last - 60 group by media_id"""),
)
def context_tail(spark, d):
    return W.context_tail(V.words(spark, d))


# --- windows over cues ---

EXTEND = """dur as (select media_id, max("end") * 0.75::double as d from ecues group by media_id),
  ex as (select e.*, least(d, start) as s1, least(d, greatest(least(d, start), "end")) as b,
      least(d, greatest(0::double, lead(start) over (partition by e.media_id order by start, "end", id))) as nx, d,
      lead(start) over (partition by e.media_id order by start, "end", id) as raw_next
    from ecues e join dur using (media_id))"""


@query(
    "extend_ends",
    with_(V.IV, V.CUES, EXTEND, select="""select media_id, id, case when crosstalk then start else s1 end as start,
      case when crosstalk then "end" else greatest(s1, case when raw_next is null then least(d, b + 0.5::double)
        when nx - b <= 0.7::double then nx when nx - b < 1 then (b + nx) * 0.5::double
        else least(d, b + 0.5::double) end) end as "end" from ex"""),
)
def extend_ends(spark, d):
    cues = V.event_cues(spark, d)
    return C.extend_ends(cues, V.durations(cues)).select("media_id", "id", "start", "end")


@query(
    "clamp_timeline",
    with_(V.IV, V.CUES, EXTEND, select="""select media_id, id, case when crosstalk then start else least(d, greatest(0::double, start)) end as start,
      case when crosstalk then "end" else least(d, greatest(least(d, greatest(0::double, start)), "end")) end as "end" from ex"""),
)
def clamp_timeline(spark, d):
    cues = V.event_cues(spark, d)
    return C.clamp_timeline(cues, V.durations(cues)).select("media_id", "id", "start", "end")


@query(
    "renumber_cues",
    with_(V.IV, select="""select media_id, cast(row_number() over (partition by media_id
      order by start, "end", coalesce(speaker, ''), id) as varchar) as id, id as parent_id, start from iv"""),
)
def renumber(spark, d):
    return C.renumber(V.intervals(spark, d)).select("media_id", "id", "parent_id", "start")


@query(
    "time_order",
    with_(V.IV, select="""select media_id, id, row_number() over (partition by media_id
      order by start, "end", coalesce(speaker, ''), ordinal) as rank from iv"""),
)
def time_order(spark, d):
    return C.time_order(V.intervals(spark, d)).select("media_id", "id", "rank")


@query(
    "list_by_ordinal",
    with_(V.IV, select="select media_id, id, ordinal from iv where stable and ordinal % 3 = 0 order by media_id, ordinal"),
)
def list_by_ordinal(spark, d):
    iv = V.intervals(spark, d)
    return C.list_by_ordinal(iv, True, iv.where("ordinal % 3 = 0")).select("media_id", "id", "ordinal")


BATCH_CTX = """bx as (select media_id, id, ordinal, row_number() over (partition by media_id order by ordinal) as p,
      translated is null {extra} as miss from iv),
  br as (select *, p - row_number() over (partition by media_id, miss order by p) as run from bx),
  bm as (select *, p - min(p) over (partition by media_id, run) as off from br where miss),
  bb as (select media_id, min(p) as lo, max(p) as hi, array_to_string(list(id order by p), ',') as ids from bm
    group by media_id, run, off // {size})"""


@query(
    "missing_cue_batches",
    with_(V.IV, BATCH_CTX.format(extra="and ordinal % 35 <> 0", size=3),
          select="""select media_id, lo - 1 as first_pos, ids,
      coalesce((select array_to_string(list(id order by p), ',') from bx where bx.media_id = bb.media_id and p between lo - 4 and lo - 1), '') as preceding,
      coalesce((select array_to_string(list(id order by p), ',') from bx where bx.media_id = bb.media_id and p between hi + 1 and hi + 3), '') as following
      from bb"""),
)
def missing_cue_batches(spark, d):
    iv = V.intervals(spark, d)
    out = C.missing_cue_batches(iv, 3, 4, 3, iv.where("ordinal % 35 = 0"))
    return out.select("media_id", "first_pos", *[F.array_join(c, ",").alias(c) for c in ("ids", "preceding", "following")])


@query(
    "fixed_batches",
    with_(V.IV, """bx as (select media_id, id, row_number() over (partition by media_id order by ordinal) - 1 as p,
        count(*) over (partition by media_id) as n from iv),
      bb as (select media_id, p // 25 as batch, min(p) as lo, max(p) as hi, array_to_string(list(id order by p), ',') as ids
        from bx group by media_id, p // 25)""",
          select="""select media_id, batch, ids,
      array_to_string(list_concat(case when lo < 4 then ['x', 'y'][1:least(2, 4 - lo)] else [] end,
        coalesce((select list(id order by p) from bx where bx.media_id = bb.media_id and p between lo - 4 and lo - 1), [])), ',') as preceding,
      array_to_string(list_concat(coalesce((select list(id order by p) from bx where bx.media_id = bb.media_id and p between hi + 1 and hi + 3), []),
        ['z'])[1:3], ',') as following from bb"""),
)
def fixed_batches(spark, d):
    iv = V.intervals(spark, d)
    medias = iv.select("media_id").distinct()
    before = medias.withColumn("ids", F.array(F.lit("x"), F.lit("y")))
    after = medias.withColumn("ids", F.array(F.lit("z")))
    out = C.fixed_batches(iv, 25, 4, 3, before, after)
    return out.select("media_id", "batch", *[F.array_join(c, ",").alias(c) for c in ("ids", "preceding", "following")])


ONSET = """o as (select *, row_number() over (partition by media_id order by rms) as rn,
      count(*) over (partition by media_id) as n from levels),
  gl as (select media_id, max(case when rn = least(n, cast(floor(n * 0.2::double) as bigint) + 1) then rms end) as g, max(n) as n
    from o group by media_id having max(rms) > 0),
  sp as (select c.media_id, id, start, g, greatest(0, cast(floor(start / 0.02::double) as bigint)) as i0,
      least(n, cast(ceil("end" / 0.02::double) as bigint)) as i1 from scues c join gl using (media_id)),
  lb as (select sp.media_id, sp.id, list_sort(list(rms)) as b from sp join levels l on l.media_id = sp.media_id
    and l.win between sp.i0 - 20 and sp.i0 - 1 group by sp.media_id, sp.id),
  nf as (select sp.*, greatest(g, least(coalesce(b[least(len(b), cast(floor(len(b) * 0.2::double) as bigint) + 1)], g),
      g * 1.5::double + 3)) as noise from sp left join lb using (media_id, id) where i1 > i0),
  pk as (select nf.media_id, nf.id, max(rms) as peak from nf join levels l on l.media_id = nf.media_id
    and l.win >= i0 and l.win < i1 group by nf.media_id, nf.id),
  th as (select nf.*, greatest(noise * 1.3::double, peak * 0.0005::double, 4) as wk,
      greatest(noise * 2, peak * 0.003::double, 8) as st from nf join pk using (media_id, id)),
  fl as (select th.media_id, th.id, win, rms > wk as w, rms > st as s from th join levels l on l.media_id = th.media_id
    and l.win >= i0 and l.win < i1),
  tg as (select *, s and sum(w::int) over (partition by media_id, id order by win rows between current row and 2 following) >= 2 as strong,
      w and sum(w::int) over (partition by media_id, id order by win rows between 3 preceding and current row) = 4 as run from fl),
  hit as (select media_id, id, min(win) as win from tg where strong or run group by media_id, id),
  ons as (select th.*, greatest(start, (hit.win - case when tg.strong then 0 else 3 end) * 0.02::double) as onset
    from th join hit using (media_id, id) join tg on tg.media_id = hit.media_id and tg.id = hit.id and tg.win = hit.win)"""


@query(
    "refine_onsets",
    with_(V.SAMPLES, V.SIGNAL_CUES, ONSET, select="""select c.media_id, c.id,
      case when greatest(c.start, onset - 0.06::double) > c.start + 0.005::double
        then greatest(c.start, onset - 0.06::double) else c.start end as start,
      case when greatest(c.start, onset - 0.06::double) > c.start + 0.005::double then noise end as noise_floor
      from scues c left join ons using (media_id, id)"""),
)
def refine_onsets(spark, d):
    lv = materialize(rms_levels(V.samples(spark, d)))
    return C.refine_onsets(V.signal_cues(lv), lv).select(
        "media_id", "id", "start", F.col("volume_start.noise_floor").alias("noise_floor")
    )


@query(
    "nearest_context",
    with_(V.WORDS, V.TURNS, "pt as (select media_id, ordinal as point, start, last_word from cues where ordinal % 4 = 1)",
          select="""select media_id, point,
      coalesce((select array_to_string(list(id order by c.start, c."end", c.id)[-3:], ',') from cues c
        where c.media_id = pt.media_id and c.start < pt.start), '') as preceding,
      coalesce((select array_to_string(list(text order by w.ordinal), '') from words w
        where w.media_id = pt.media_id and w.ordinal between last_word + 1 and last_word + 5), '') as following from pt"""),
)
def nearest_context(spark, d):
    cues = V.cues(spark, d)
    points = cues.where("ordinal % 4 = 1").select(
        "media_id", F.col("ordinal").alias("point"), "start", F.col("last_word").alias("last_ordinal")
    )
    out = C.nearest_context(points, cues, V.words(spark, d), 3, 5)
    return out.select("media_id", "point", F.array_join("preceding", ",").alias("preceding"),
                      F.array_join("following", "").alias("following"))


@query(
    "quarantine_cues",
    with_(V.IV, """bad as (select media_id, id, start - case when ordinal % 97 = 0 then 1e7::double else 0 end as start,
      "end" - case when ordinal % 31 = 0 then 20 else 0 end as "end" from iv)""",
          select="""select media_id, id, case when start < 0 then 'negative start' else 'end before start' end as reason
      from bad where not (start >= 0 and "end" >= start)"""),
)
def quarantine(spark, d):
    iv = V.intervals(spark, d).withColumns({
        "start": F.col("start") - F.when(F.col("ordinal") % 97 == 0, 1e7).otherwise(0),
        "end": F.col("end") - F.when(F.col("ordinal") % 31 == 0, 20).otherwise(0),
    })
    return C.rejected_cues(iv).select("media_id", "id", "reason")


@query(
    "top1_rules",
    with_(V.IV, select="""select media_id, event_type, (select id from iv b where b.media_id = a.media_id and b.event_type = a.event_type
        order by abs("end" - 1000), "end" desc, ordinal limit 1) as nearest,
      (select id from iv b where b.media_id = a.media_id and b.event_type = a.event_type order by floor("end" - start) desc, ordinal limit 1) as longest
    from (select distinct media_id, event_type from iv) a"""),
)
def top1_rules(spark, d):
    """Nearest of equals the later, longest of equals the first."""
    iv, key = V.intervals(spark, d), ["media_id", "event_type"]
    near = R.top1(iv, key, F.abs(F.col("end") - 1000), F.col("end").desc(), F.col("ordinal"))
    wide = R.top1(iv, key, F.floor(F.col("end") - F.col("start")).desc(), F.col("ordinal"))
    return near.select(*key, F.col("id").alias("nearest")).join(wide.select(*key, F.col("id").alias("longest")), key)
