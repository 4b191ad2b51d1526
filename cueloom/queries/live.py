"""Queries over replayed streams of the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cueloom.operators import words as W
from cueloom.queries import views as V
from cueloom.queries.registry import SQL, query, with_
from cueloom.queries.timeline import MISSING_BATCHES, MISSING_ROWS
from cueloom.session import materialize, scratch_dir
from cueloom.streaming import operators as L
from cueloom.operators.reconcile import promote_authoritative
from cueloom.plans.blocks import Ordered, lag, lead, running_max
from cueloom.streaming import tables as T
from cueloom.streaming import timed
from cueloom.streaming.run import replay, replay_through
from cueloom.streaming.settle import settle
from cueloom.streaming.settlement import EVENTS, settle_stream

PARTS = 3


def live(rows, operator, parts: int = PARTS):
    """The output of ``operator`` for ``rows`` (with seq) arriving in ``parts`` steps."""
    return replay_through(*steps(rows, parts), operator)


def steps(rows, parts: int = PARTS):
    top = rows.agg(F.max("seq")).first()[0]
    return rows, F.floor(F.col("seq") / F.lit(top + 1) * parts), parts


WINDOWS = """dr as (select media_id, max("end") as d from iv group by media_id),
  nw as (select *, unnest(range(cast(floor(d / 15) + case when d > floor(d / 15) * 15 then 1 else 0 end as bigint))) as n from dr)"""
WINDOW_ROWS = 'select media_id, n, greatest(0::double, n * 15.0::double - 5) as start, least(d, (n + 1) * 15.0::double) as "end" from nw'


@query("chunk_windows", with_(V.IV, WINDOWS, select=WINDOW_ROWS))
def chunk_windows(spark, d):
    return L.chunk_windows(V.durations(V.intervals(spark, d), 1.0))


@query("stream_chunk_windows", with_(V.IV, WINDOWS, select=WINDOW_ROWS))
def stream_chunk_windows(spark, d):
    iv = V.intervals(spark, d)
    decoded = Ordered.of(iv, ["media_id"], ["ordinal"]).scan(
        reach=running_max(F.col("end")), after=lead(F.col("ordinal"))
    )
    rows = decoded.rows.select(
        "media_id", F.col("ordinal").alias("seq"), F.col("reach").alias("end"), F.col("after").isNull().alias("closed")
    )
    return live(rows, L.stream_chunks)


# In these a row's outcome depends on the outcomes before it: they go row by row.
FEED = """cf as (select media_id, "end", row_number() over (partition by media_id order by ordinal) as k from iv),
  fd as (select media_id, 0 as k, 0.0::double as done, false as hit, 0.0::double as start from (select distinct media_id from cf) union all
    select c.media_id, c.k, case when c."end" >= f.done + 1 then c."end" else f.done end, c."end" >= f.done + 1, greatest(0.0::double, f.done - 1)
    from fd f join cf c on c.media_id = f.media_id and c.k = f.k + 1)"""


@query("stream_continuous_feed", with_(V.IV, FEED, recursive=True, select='select media_id, start, done as "end" from fd where hit'))
def stream_continuous_feed(spark, d):
    iv = V.intervals(spark, d)
    return live(iv.select("media_id", F.col("ordinal").alias("seq"), "end"), L.continuous_feed)


@query(
    "stream_trim_ingested",
    with_(V.IV, """f as (select media_id, ordinal as seq, floor(start) as off, (1 + ordinal % 30) * 100 as frames from iv),
      g as (select *, greatest(coalesce(max(off + frames / 100.0::double) over w, off), first_value(off) over (partition by media_id order by seq)) as fed
        from f window w as (partition by media_id order by seq rows between unbounded preceding and 1 preceding)),
      h as (select *, least(frames, greatest(0, round_even((fed - off) * 100, 0)::bigint)) as skip from g)""",
          select="select media_id, seq, skip as skip_frames, frames - skip as fresh_frames, fed as fed_from from h where skip < frames"),
)
def stream_trim_ingested(spark, d):
    k = F.col("ordinal")
    rows = V.intervals(spark, d).select(
        "media_id", k.alias("seq"), F.floor("start").cast("double").alias("offset"),
        ((1 + k % 30) * 100).alias("frames"), F.lit(100).alias("rate"),
    )
    return live(rows, L.trim_ingested)


GENERATION = "(ordinal // 100 - case when ordinal % 17 = 0 then 1 else 0 end)"


def asr_events(spark, d):
    iv = V.intervals(spark, d)
    k = F.col("ordinal")
    kind = (
        F.when(k % 50 == 49, "closed").when(k % 9 == 8, "nomatch").when(k % 3 == 0, "partial").otherwise("final")
    )
    return iv.select(
        "media_id", k.alias("seq"), (F.floor(k / 100) - F.when(k % 17 == 0, 1).otherwise(0)).alias("generation"),
        kind.alias("kind"), "start", "end", F.col("source").alias("text"),
    )


ASR = f"""ae as (select media_id, ordinal as seq, {GENERATION} as generation,
    case when ordinal % 50 = 49 then 'closed' when ordinal % 9 = 8 then 'nomatch' when ordinal % 3 = 0 then 'partial' else 'final' end as kind,
    start, "end", source as text from iv)"""


@query(
    "stream_fence_generation",
    with_(V.IV, ASR, "m as (select *, max(generation) over (partition by media_id order by seq rows unbounded preceding) as g from ae)",
          select="select media_id, seq, generation, kind, text from m where generation = g"),
)
def stream_fence_generation(spark, d):
    return live(asr_events(spark, d), L.fence_generation).select("media_id", "seq", "generation", "kind", "text")


@query(
    "stream_fold_partials",
    with_(V.IV, ASR, """fi as (select *, row_number() over (partition by media_id, text order by seq) as k from ae where kind = 'final'),
      gr as (select media_id, text, seq, k, start as last, true as keep from fi where k = 1 union all
        select f.media_id, f.text, f.seq, f.k, case when f.start - 2.5::double > g.last then f.start else g.last end, f.start - 2.5::double > g.last
        from gr g join fi f on f.media_id = g.media_id and f.text = g.text and f.k = g.k + 1)""", recursive=True,
          select="""select fi.media_id, fi.seq, fi.start, fi."end", fi.text, row_number() over (partition by fi.media_id order by fi.start, fi."end", fi.seq)::varchar as id
      from gr join fi on fi.media_id = gr.media_id and fi.seq = gr.seq where keep"""),
)
def stream_fold_partials(spark, d):
    finals = live(asr_events(spark, d), L.fold_partials)
    return L.number_finals(finals).select("media_id", "seq", "start", "end", "text", "id")


@query("stream_fold_partials_retained", SQL["stream_fold_partials"])
def stream_fold_partials_retained(spark, d):
    """The same finals while texts not heard for a minute leave the state."""
    timed_events = asr_events(spark, d).withColumn("at", on_the_clock(F.col("start")))
    finals = live(timed_events, lambda s: L.fold_partials(s.withWatermark("at", "10 seconds"), "at"))
    return L.number_finals(finals).select("media_id", "seq", "start", "end", "text", "id")


@query(
    "stream_current_partial",
    with_(V.IV, ASR, """sp as (select media_id, seq, kind, case when kind = 'partial' then text end as text,
        lag(kind) over (partition by media_id order by seq) as before from ae where kind in ('partial', 'final'))""",
          select="""select media_id, seq, 'partial' as kind, text from sp where kind = 'partial' or before = 'partial'
      union all select media_id, seq, 'ended', text from ae where kind = 'closed'"""),
)
def stream_current_partial(spark, d):
    return live(asr_events(spark, d), L.current_partial).select("media_id", "seq", "kind", "text")


@query(
    "stream_emit_deltas",
    with_(V.IV, "c as (select media_id, source as id, ordinal as seq, ordinal // 40 as version from iv)",
          select="""select media_id, id, seq, version from (select *, lag(version) over (partition by media_id, id order by seq) as was from c)
      where was is null or was <> version"""),
)
def stream_emit_deltas(spark, d):
    rows = V.intervals(spark, d).select(
        "media_id", F.col("source").alias("id"), F.col("ordinal").alias("seq"), F.floor(F.col("ordinal") / 40).alias("version")
    )
    return live(rows, lambda s: L.emit_deltas(s, changed=True))


def refed_words(spark, d):
    """Words as heard live: each hundred ends with its last five heard again, slightly off."""
    w = V.words(spark, d).withColumn("seq", F.col("ordinal").cast("long") * 2)
    again = w.where("ordinal % 100 >= 95").withColumns({
        "seq": F.col("seq") + 10, "start": F.col("start") + 0.05, "end": F.col("end") + 0.05,
    })
    # Odd numbers: heard again right after the hundred is complete.
    return w.unionByName(again.withColumn("seq", F.col("seq") - 1))


REFED = """rw as (select *, ordinal::bigint * 2 as seq from words union all by name
    select * replace (start + 0.05::double as start, "end" + 0.05::double as "end"), ordinal::bigint * 2 + 9 as seq from words where ordinal % 100 >= 95),
  rn as (select media_id, start, "end", text, speaker, lower(trim(text)) as key, row_number() over (partition by media_id order by seq) as k from rw),
  dd as (select media_id, 0 as k, 0::bigint as n, []::struct(s double, t varchar)[] as held, false as kept from (select distinct media_id from rn) union all
    select media_id, k, case when keep then n + 1 else n end, case when keep then list_append(held, {s: start, t: key})[-80:] else held end, keep
    from (select r.*, d.n, d.held, not (len(list_filter(d.held, lambda y: y.t = r.key and abs(y.s - r.start) <= 0.6::double)) > 0
        or coalesce(r.start < d.held[-1].s, false)) as keep from dd d join rn r on r.media_id = d.media_id and r.k = d.k + 1))"""


@query(
    "stream_dedup_words",
    with_(V.WORDS, REFED, recursive=True, select="""select dd.media_id, n - 1 as ordinal, start, "end", text, speaker
      from dd join rn on rn.media_id = dd.media_id and rn.k = dd.k where kept"""),
)
def stream_dedup_words(spark, d):
    return live(refed_words(spark, d).drop("ordinal"), L.dedup_words_stream)


# A batch ends at the first silence that makes it full-size; if that is too far, at the
# largest silence in the window before, and without one after twice the target.
DISPATCH = """sr as (select media_id, ordinal, start - max("end") over (partition by media_id order by ordinal
      rows between unbounded preceding and 1 preceding) as gap from words),
  sb as (select media_id, ordinal as r, gap from sr where gap >= 0.8::double),
  cut as (select media_id, 0 as first, 0 as r, -1 as was from (select distinct media_id from words) union all
    select media_id, case when next - first <= 80 then next else coalesce(best, first + 80) end, next, first
    from (select c.media_id, c.first, (select min(b.r) from sb b where b.media_id = c.media_id and b.r >= greatest(c.r, c.first + 40)) as next,
        (select arg_min(b.r, struct_pack(g := -b.gap, r := b.r)) from sb b where b.media_id = c.media_id and b.r between c.first + 20 and c.first + 40) as best
      from cut c) where next is not null)"""
DISPATCHED = "select media_id, was::bigint as first_ordinal, first::bigint - 1 as last_ordinal from cut where first - was >= 40 and was >= 0"


def word_arrivals(spark, d):
    k = F.col("ordinal").cast("long")
    return V.words(spark, d).select("media_id", k.alias("ordinal"), k.alias("seq"), "start", "end")


@query("stream_dispatch", with_(V.WORDS, DISPATCH, select=DISPATCHED, recursive=True))
def stream_dispatch(spark, d):
    return live(word_arrivals(spark, d), lambda s: L.dispatch_stream(s, 40))


@query("stream_dispatch_ledger", with_(V.WORDS, DISPATCH, select=DISPATCHED, recursive=True))
def stream_dispatch_ledger(spark, d):
    """Every micro-batch is handed over twice, the second time under a new number as well."""
    table = T.CellTable(
        spark, scratch_dir(spark, "ledger"), "media_id long, first_ordinal long, last_ordinal long", ["media_id"])
    batches = live(word_arrivals(spark, d), lambda s: L.dispatch_stream(s, 40))
    keys = ["media_id", "first_ordinal", "last_ordinal"]

    def land(batch, number):
        for again in (number, number, number + 1000):
            table.append_once(batch, again, keys)

    rows = batches.withColumn("seq", F.col("first_ordinal"))
    state = scratch_dir(spark, "state")
    return replay(*steps(rows), lambda s: (T.drain_into(s.drop("seq"), land, state), table.read())[1])


# What dispatch may look at: words before the last silence after everything so far.
USABLE = """au as (select media_id, ordinal, start - max("end") over (partition by media_id order by ordinal
      rows between unbounded preceding and 1 preceding) as pause from words),
  ub as (select media_id, max(ordinal) as usable from au where pause >= 0.8::double group by media_id),
  uw as (select w.* from words w join ub on ub.media_id = w.media_id and w.ordinal < ub.usable)"""


@query(
    "dispatch_once",
    with_(V.WORDS, V.TURNS, MISSING_BATCHES, f"dn as ({MISSING_ROWS})", USABLE,
          re.sub(r"\b(un|us|sil|tot|bt|fin)\b", r"\1_", MISSING_BATCHES).replace("from words w", "from uw w"),
          "db as (" + re.sub(r"\b(sil|bt|fin)\b", r"\1_", MISSING_ROWS) + ")", recursive=True,
          select="""select * from db where last_ordinal - first_ordinal + 1 >= 30
      and not exists (select 1 from dn where dn.media_id = db.media_id and dn.first_ordinal = db.first_ordinal
        and dn.last_ordinal = db.last_ordinal and dn.first_ordinal % 2 = 0)"""),
)
def dispatch_once(spark, d):
    words, cues = V.words(spark, d), V.cues(spark, d).where("stable")
    done = W.missing_word_batches(words, cues, 30).where("first_ordinal % 2 = 0").select(
        "media_id", "first_ordinal", "last_ordinal"
    )
    return W.dispatch_once(words, cues, 30, done)


FORCED = """hf as (select media_id, ordinal, "end", row_number() over (partition by media_id order by ordinal) as k from iv),
  hr as (select media_id, 0 as k, 0::bigint as seq, 0.0::double as floor, false as hit from (select distinct media_id from hf) union all
    select f.media_id, f.k, f.ordinal, case when f.ordinal % 6 = 0 then greatest(r.floor, f."end") when f."end" - r.floor >= 25 then f."end" else r.floor end,
      f.ordinal % 6 <> 0 and f."end" - r.floor >= 25 from hr r join hf f on f.media_id = r.media_id and f.k = r.k + 1)"""


@query("stream_forced_flush", with_(V.IV, FORCED, recursive=True, select="select media_id, seq, floor as commit_at from hr where hit"))
def stream_forced_flush(spark, d):
    k = F.col("ordinal")
    rows = V.intervals(spark, d).select(
        "media_id", k.alias("seq"), F.when(k % 6 == 0, "durable").otherwise("sent").alias("kind"), "end"
    )
    return live(rows, L.forced_flush)


def on_the_clock(start):
    """A row's arrival: the wall clock of its start."""
    return F.timestamp_millis(F.lit(1704067200000) + F.round(start * 1000).cast("long"))


FLUSH = """ff as (select media_id, row_number() over (partition by media_id order by ordinal) as k, ordinal % 6 = 0 as durable, start, "end",
      1704067200000 + round(start * 1000)::bigint as ms from iv),
  fl as (select media_id, k, start as floor, start as sent, 0::bigint as due, null::double as timer, null::bigint as timed, null::double as filled, null::bigint as hit
      from (select media_id, 0 as k, start from ff where k = 1) union all
    select media_id, k, case when durable then greatest(floor1, "end") when hits then reach else floor1 end, case when durable then sent else reach end,
      case when durable then case when sent > greatest(floor1, "end") then ms + 25000 else 0 end
           when hits then 0 when reach > floor1 and due1 = 0 then ms + 25000 else due1 end,
      case when fires then sent end, case when fires then due end, case when hits and not durable then reach end, case when hits and not durable then ms end
    from (select *, greatest(sent, "end") as reach, greatest(sent, "end") - floor1 >= 25 as hits
      from (select f.media_id, f.k, f.durable, f."end", f.ms, r.sent, r.due, r.due > 0 and r.due <= f.ms as fires,
          case when r.due > 0 and r.due <= f.ms then r.sent else r.floor end as floor1,
          case when r.due > 0 and r.due <= f.ms then 0 else r.due end as due1
        from fl r join ff f on f.media_id = r.media_id and f.k = r.k + 1))),
  fe as (select * from fl qualify k = max(k) over (partition by media_id))"""


@query(
    "stream_flush_by_timer",
    with_(V.IV, FLUSH, recursive=True, select="""select media_id, timer as commit_at, 'timer' as cause, timed as at_ms from fl where timed is not null
      union all select media_id, filled, 'sent', hit from fl where hit is not null
      union all select media_id, sent, 'timer', due from fe where due > 0 and due < (select max(ms) from ff)"""),
)
def stream_flush_by_timer(spark, d):
    k = F.col("ordinal")
    rows = V.intervals(spark, d).select(
        "media_id", k.alias("seq"), F.when(k % 6 == 0, "durable").otherwise("sent").alias("kind"), "start", "end",
        on_the_clock(F.col("start")).alias("at"),
    )
    return live(rows, lambda s: timed.flush_by_timer(s.withWatermark("at", "0 seconds"), "at"))


@query("stream_windowed_chunks", with_(V.IV, WINDOWS, select=WINDOW_ROWS))
def stream_windowed_chunks(spark, d):
    """Recordings that began some seconds apart; one tick of the clock comes last."""
    iv = V.intervals(spark, d)
    reach = Ordered.of(iv, ["media_id"], ["ordinal"]).scan(reach=running_max(F.col("end")))
    rows = reach.scan(begin=lag(F.col("reach"))).rows
    began = F.timestamp_millis(F.lit(1704067200000) + F.col("media_id") * 7000)
    decoded = rows.where("begin is null or reach > begin").select(
        "media_id", F.col("ordinal").alias("seq"), F.coalesce("begin", F.lit(0.0)).alias("begin"), F.col("reach").alias("end"), began.alias("began")
    )
    tick = decoded.agg((F.max("seq") + 1).alias("seq"), (F.max("end") + 4000).alias("end")).select(
        F.lit(None).cast("long").alias("media_id"), "seq", F.col("end").alias("begin"), "end", F.timestamp_millis(F.lit(1704067200000)).alias("began")
    )
    return live(decoded.unionByName(tick), lambda s: timed.windowed_chunks(s, delay=3600))


@query(
    "retained_buffer",
    with_(V.IV, """m as (select media_id, max("end") filter (ordinal % 2 = 0) as du, max("end") as fe from iv group by media_id)""",
          select='select media_id, id, "end" from iv join m using (media_id) where "end" > greatest(du - 5, fe - 60)'),
)
def retained_buffer(spark, d):
    iv = V.intervals(spark, d)
    marks = iv.groupBy("media_id").agg(
        F.max(F.when(F.col("ordinal") % 2 == 0, F.col("end"))).alias("durable_end"), F.max("end").alias("fed_end")
    )
    return L.retained(iv.select("media_id", "id", "end"), marks)


@query(
    "resume_offset",
    with_(V.WORDS, select='select media_id, greatest(0::double, max_by("end", ordinal) - 5) as resume_at from words group by media_id'),
)
def resume_offset(spark, d):
    return L.resume_offset(V.words(spark, d))


@query(
    "stream_late_spans",
    with_(V.IV, V.VAD, select='select media_id, l as start, r as "end" from speech'),
)
def stream_late_spans(spark, d):
    spans = V.intervals(spark, d).where("event_type in ('click', 'purchase')").select(
        "media_id", "start", "end", (F.col("ordinal") * 7919 % 1000).alias("seq")
    )
    table = T.CellTable(spark, scratch_dir(spark, "spans"), T.PIECES, ["media_id", "cell"])
    state = scratch_dir(spark, "state")

    def merged(stream):
        T.drain_into(stream, T.remerge_touched(table, 0.04), state)
        return T.merged_spans(table, 0.04)

    return replay(*steps(spans), merged)


SETTLE = """landed as (select *, 'w' || first_word || '-' || last_word as wid, ordinal as land from cues where ordinal % 40 <> 33),
  ow as (select w.media_id, w.ordinal as word, max_by(l.wid, land) as id, max_by(l.speaker, land) as speaker, max_by(l.start, land) as start,
      max_by(l."end", land) as "end", max_by(l.first_word, land) as fw, max_by(case when l.speaker is null then 1 else 0 end, land) as unn
    from words w join landed l on l.media_id = w.media_id and w.ordinal between l.first_word and l.last_word group by w.media_id, w.ordinal),
  ow2 as (select *, case when unn = 1 then null else speaker end as sp from ow),
  ju as (select media_id, last_word as ordinal, land % 31 = 30 as forced from landed where land % 5 = 4),
  pj as (select j.media_id, l.fw from ju j join ow2 l on l.media_id = j.media_id and l.word = j.ordinal
    left join ow2 r on r.media_id = j.media_id and r.word = j.ordinal + 1
    where r.id is null or (l.id <> r.id and (forced or (l.sp is not distinct from r.sp and r.start - l."end" < 0.8::double)))),
  tt2 as (select media_id, max(ordinal) + 1 as total from words group by media_id),
  gp as (select w.media_id, min(w.ordinal) as gap from words w left join ow2 on ow2.media_id = w.media_id and ow2.word = w.ordinal where ow2.id is null group by w.media_id),
  cu as (select tt2.media_id, total, coalesce(gap, total) as cursor from tt2 left join gp using (media_id)),
  ba as (select * from pj union all select cu.media_id, fw from cu join ow2 on ow2.media_id = cu.media_id and ow2.word = cursor - 1
    where cursor > 0 and (cursor < total or cu.media_id = 1)),
  mu as (select media_id, min(fw) as mf from ba group by media_id),
  fr as (select w.media_id, min(w.start) as fs from words w join mu on mu.media_id = w.media_id and w.ordinal >= mf group by w.media_id),
  rk as (select l.*, row_number() over (partition by l.media_id order by l.start, l."end", coalesce(speaker, ''), land) as rank, coalesce(mf, total) as mf,
      coalesce(fs, 'infinity'::double) as fs from landed l join cu using (media_id) left join mu using (media_id) left join fr using (media_id) where cursor > 0),
  st as (select media_id, min(rank) as stop from rk where last_word + 1 > mf or start >= fs group by media_id)"""


@query(
    "settle_final_ids",
    with_(V.WORDS, V.TURNS, SETTLE, select="""select media_id, wid as id, rank::varchar as final_id from rk left join st using (media_id) where stop is null or rank < stop"""),
)
def settle_final_ids(spark, d):
    cues = V.cues(spark, d).where("ordinal % 40 <> 33").withColumn("landed", F.col("ordinal"))
    named = cues.withColumn("id", F.concat(F.lit("w"), F.col("first_word").cast("string"), F.lit("-"), F.col("last_word").cast("string")))
    cuts = cues.where("landed % 5 = 4").select(
        "media_id", F.col("last_word").alias("ordinal"), (F.col("landed") % 31 == 30).alias("forced")
    )
    words = V.words(spark, d)
    closed = words.where("media_id <> 1").select("media_id").distinct()
    return settle(named, cuts, words, closed)


def settlement_rows(spark, d):
    """What a live recording brings: words, cuts announced, cues landing three later, a few
    cues much later, repairs that replace the cue before a forced cut, and the end."""
    unit, k = 100_000, F.col("ordinal")
    types = dict(x.split() for x in EVENTS.split(", "))

    def event(df, kind, seq, **columns):
        blank = {c: F.lit(None).cast(t) for c, t in types.items() if c not in ("media_id", "seq", "kind")}
        chosen = {**blank, **columns, "kind": F.lit(kind), "seq": seq.cast("long")}
        return df.select("media_id", *[chosen[c].cast(t).alias(c) for c, t in types.items() if c != "media_id"])

    cues = V.cues(spark, d)
    wid = F.concat(F.lit("w"), F.col("first_word").cast("string"), F.lit("-"), F.col("last_word").cast("string"))
    whole = {c: F.col(c) for c in ("start", "end", "speaker", "first_word", "last_word")}
    spoken = V.words(spark, d).select("media_id", F.col("ordinal").alias("word"), F.col("start").alias("at")).join(
        cues.select("media_id", "ordinal", F.explode(F.sequence("first_word", "last_word")).alias("word"), "first_word"), ["media_id", "word"])
    cuts = cues.where(k % 5 == 4)
    open_cut = (F.col("media_id") == 1) & (k % 100 == 99)
    repaired = cuts.where((k % 25 == 24) & ~open_cut)
    parts = [
        event(spoken, "word", k * unit + F.col("word") - F.col("first_word"), first_word=F.col("word"), start=F.col("at")),
        event(cuts, "junction", k * unit + unit - 4, first_word=F.col("last_word"), forced=k % 25 == 24),
        event(cues, "cue", (k + F.when(k % 40 == 33, 60).otherwise(3)) * unit + unit - 3, id=wid, **whole),
        event(repaired, "removed", (k + 9) * unit + unit - 3 + 1, id=wid),
        event(repaired, "cue", (k + 9) * unit + unit - 1, id=F.concat(F.lit("r"), wid), **whole),
        event(cuts.where(~open_cut), "resolved", (k + 70) * unit, first_word=F.col("last_word")),
        event(cues.where("media_id <> 1").groupBy("media_id").agg(F.max("ordinal").alias("ordinal")), "closed", (k + 80) * unit),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


LIVE_SETTLE = SETTLE.replace(
    """landed as (select *, 'w' || first_word || '-' || last_word as wid, ordinal as land from cues where ordinal % 40 <> 33)""",
    """landed as (select *, case when ordinal % 25 = 24 and not (media_id = 1 and ordinal % 100 = 99) then 'r' else '' end
      || 'w' || first_word || '-' || last_word as wid, ordinal as land from cues)""",
).replace(
    """ju as (select media_id, last_word as ordinal, land % 31 = 30 as forced from landed where land % 5 = 4)""",
    """ju as (select media_id, last_word as ordinal, true as forced from landed where media_id = 1 and land % 100 = 99)""",
)


@query(
    "stream_settle",
    with_(V.WORDS, V.TURNS, LIVE_SETTLE, select="""select media_id, 'settled' as kind, wid as id, rank::varchar as final_id from rk left join st using (media_id) where stop is null or rank < stop"""),
)
def stream_settle(spark, d):
    return live(materialize(settlement_rows(spark, d)), settle_stream).select("media_id", "kind", "id", "final_id")


@query(
    "live_promoted",
    with_(V.WORDS, V.TURNS, """pt as (select *, floor(ordinal / (select max(ordinal) + 1 from cues) * 3) as part from cues)""",
          select="""select media_id, id, row_number() over (partition by media_id order by ordinal) - 1 as ordinal, start, source, false as provisional
      from cues where media_id <> 1 and ordinal % 3 <> 1
      union all select media_id, id, ordinal, start, source, true from cues where media_id = 1"""),
)
def live_promoted(spark, d):
    """Two recordings get their final pass while the stream still adds live cues to all three."""
    columns = ["media_id", "id", "ordinal", "start", "end", "source", "translated", "speaker", "stable"]
    cues = V.cues(spark, d).select(*columns).withColumn("ordinal", F.col("ordinal").cast("long"))
    rows = cues.withColumns({"seq": F.col("ordinal"), "provisional": F.lit(True)})
    table = T.CellTable(spark, scratch_dir(spark, "live"), rows.drop("seq").schema, ["media_id"])
    final = cues.where("media_id <> 1 and ordinal % 3 <> 1").withColumn("seq", F.col("ordinal"))
    state, turns = scratch_dir(spark, "state"), []

    def consume(stream):
        T.drain_into(stream.drop("seq"), lambda b, n: table.append_once(b, n, ["media_id", "id"]), state)
        turns.append(1)
        if len(turns) == 2:
            T.settle_recordings(table, final, 0, promote_authoritative)
        return table.read()

    return replay(*steps(rows), consume).where("stable or provisional").select(
        "media_id", "id", "ordinal", "start", "source", "provisional")
