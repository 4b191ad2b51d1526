"""Queries that reconcile, check and render cue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import batches as B
from cueloom.operators import qa as Q
from cueloom.operators import reconcile as R
from cueloom.operators import words as W
from cueloom.queries import views as V
from cueloom.queries.registry import query, with_
from cueloom.session import materialize, scratch_dir
from cueloom.queries.timeline import BATCHES, SILENCES
from cueloom.sources import sinks as S
from cueloom.sources import subtitles as T

# --- reconciliation ---


def overlap_sides(spark, d):
    iv = V.intervals(spark, d)
    existing = iv.where("ordinal % 4 = 0")
    incoming = iv.where("ordinal % 4 <> 0").withColumn("seq", F.col("ordinal"))
    return existing, incoming


@query(
    "merge_overlap",
    with_(V.IV, """ex as (select * from iv where ordinal % 4 = 0),
      inc as (select i.*, row_number() over (partition by media_id, source order by ordinal) as k from iv i
        where ordinal % 4 <> 0 and not exists (select 1 from ex where ex.media_id = i.media_id
        and lower(ex.source) = lower(i.source) and ex.start between i.start - 2.5::double and i.start + 2.5::double)),
      greedy as (select media_id, source, ordinal, k, start as last, true as keep from inc where k = 1
        union all
        select i.media_id, i.source, i.ordinal, i.k, case when i.start - 2.5::double > g.last then i.start else g.last end,
          i.start - 2.5::double > g.last from greedy g join inc i on i.media_id = g.media_id and i.source = g.source and i.k = g.k + 1),
      nb as (select media_id, count(*) as n from ex group by media_id)""",
          recursive=True,
          select="""select media_id, id, start, "end", source, speaker, false as incoming from ex
      union all select i.media_id, cast(n + row_number() over (partition by i.media_id order by i.ordinal) as varchar), i.start, i."end",
        i.source, i.speaker, true from greedy g join iv i on i.media_id = g.media_id and i.ordinal = g.ordinal
        join nb on nb.media_id = g.media_id where keep"""),
)
def merge_overlap(spark, d):
    # Event times rise with the event number, so arrival order is time order here.
    return R.merge_overlap(*overlap_sides(spark, d))


@query(
    "union_timelines",
    with_(V.IV, select="select media_id, id, start from iv where ordinal % 4 = 0 union all select media_id, 'n' || id, start from iv where ordinal % 4 <> 0"),
)
def union_timelines(spark, d):
    old, new = overlap_sides(spark, d)
    new = new.withColumn("id", F.concat(F.lit("n"), "id"))
    return R.union_timelines(old, new).select("media_id", "id", "start")


@query(
    "timeline_view",
    with_(V.WORDS, V.TURNS, """pv as (select media_id, 'preview-' || id as id, start, first_word + 3 as first_word, last_word + 3 as last_word from cues)""",
          select="""select media_id, id, start from cues where stable union all
      select media_id, id, start from pv p where not exists (select 1 from cues c where c.media_id = p.media_id and c.stable
        and c.first_word <= p.last_word and p.first_word <= c.last_word)"""),
)
def timeline_view(spark, d):
    cues = V.cues(spark, d)
    preview = cues.withColumns({
        "id": F.concat(F.lit("preview-"), "id"), "first_word": F.col("first_word") + 3, "last_word": F.col("last_word") + 3,
    })
    return R.timeline_view(cues.where("stable"), preview).select("media_id", "id", "start")


UPSERT = """base as (select * from iv where ordinal % 3 <> 0),
  delta as (select *, 'new ' || source as nsource, case when ordinal % 2 = 0 then null else 'N' end as ntrans,
    row_number() over (partition by media_id order by ordinal) as k from iv where ordinal % 4 <> 1),
  top as (select media_id, max(ordinal) as top from base group by media_id)"""


def upsert_sides(spark, d):
    iv = V.intervals(spark, d)
    delta = iv.where("ordinal % 4 <> 1").withColumns({
        "seq": F.col("ordinal"), "source": F.concat(F.lit("new "), "source"),
        "translated": F.when(F.col("ordinal") % 2 != 0, "N"), "stable": F.lit(True),
    })
    return iv.where("ordinal % 3 <> 0"), delta


@query(
    "upsert_cues",
    with_(V.IV, UPSERT, select="""select coalesce(d.media_id, b.media_id) as media_id, coalesce(d.id, b.id) as id,
      case when d.id is null then b.ordinal else coalesce(b.ordinal, coalesce(top, -1) + k) end as ordinal,
      coalesce(d.start, b.start) as start, coalesce(d."end", b."end") as "end",
      case when d.id is not null then nsource else b.source end as source,
      coalesce(ntrans, b.translated) as translated, case when d.id is not null then d.speaker else b.speaker end as speaker,
      case when d.id is not null then true else b.stable end as stable
      from base b full join delta d on b.media_id = d.media_id and b.id = d.id left join top on top.media_id = d.media_id"""),
)
def upsert_cues(spark, d):
    return R.upsert_cues(*upsert_sides(spark, d))


@query(
    "replace_transcript",
    with_(V.IV, UPSERT, select="""select d.media_id, d.id, k - 1 as ordinal, d.start, d."end",
      case when b.translated is not null then b.source else nsource end as source,
      case when b.translated is not null then b.translated else ntrans end as translated, d.speaker, true as stable
      from delta d left join base b on b.media_id = d.media_id and b.id = d.id
      union all select media_id, id, ordinal + 1000000, start, "end", source, translated, speaker, false from base b
      where not exists (select 1 from delta d where d.media_id = b.media_id and d.id = b.id)"""),
)
def replace_transcript(spark, d):
    return R.replace_transcript(*upsert_sides(spark, d))


@query(
    "promote_authoritative",
    with_(V.IV, UPSERT, select="""select d.media_id, d.id, k - 1 as ordinal, nsource as source, ntrans as translated, true as stable from delta d
      union all select media_id, id, ordinal + 1000000, source, null, false from base b
      where not exists (select 1 from delta d where d.media_id = b.media_id and d.id = b.id)"""),
)
def promote_authoritative(spark, d):
    out = R.promote_authoritative(*upsert_sides(spark, d))
    return out.select("media_id", "id", "ordinal", "source", "translated", "stable")


@query(
    "delete_rename_retire",
    with_(V.IV, select="""select media_id, case when ordinal % 5 = 1 then 'r' || id else id end as id,
      stable and ordinal % 7 <> 2 as stable from iv where ordinal % 6 <> 0"""),
)
def delete_rename_retire(spark, d):
    iv = V.intervals(spark, d)
    kept = R.delete_cues(iv, iv.where("ordinal % 6 = 0"))
    retired = R.retire_cues(kept, iv.where("ordinal % 7 = 2"))
    renames = iv.where("ordinal % 5 = 1").select("media_id", "id", F.concat(F.lit("r"), "id").alias("new_id"))
    return R.rename_cues(retired, renames).select("media_id", "id", "stable")


@query("reset_checkpoints", "select event_type as name, count(*) as n from events where event_type in ('click', 'view') group by event_type")
def reset_checkpoints(spark, d):
    names = V.table(spark, d, "events").select(F.col("event_type").alias("name"))
    return R.reset_keys(names, ["click", "view"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


RESULTS = """res as (select media_id, case when ordinal % 40 = 0 then 'u' || id else id end as id, ordinal,
    case when ordinal % 3 = 0 then '  ' when ordinal % 8 = 0 then source else ' fixed ' || source end as source,
    case when ordinal % 5 = 1 then ' ' else 'X' || ordinal end as translated from iv where ordinal % 9 <> 4)"""


def results(iv):
    k = F.col("ordinal")
    return iv.where("ordinal % 9 <> 4").select(
        "media_id", F.when(k % 40 == 0, F.concat(F.lit("u"), "id")).otherwise(F.col("id")).alias("id"), "ordinal",
        F.when(k % 3 == 0, "  ").when(k % 8 == 0, F.col("source")).otherwise(F.concat(F.lit(" fixed "), "source")).alias("source"),
        F.when(k % 5 == 1, " ").otherwise(F.concat(F.lit("X"), k.cast("string"))).alias("translated"),
    )


@query(
    "apply_results",
    with_(V.IV, RESULTS, select="""select i.media_id, i.id, coalesce(nullif(trim(r.source), ''), i.source) as source,
      coalesce(nullif(trim(r.translated), ''), i.translated) as translated from iv i left join res r on r.media_id = i.media_id
      and r.id = i.id where i.stable"""),
)
def apply_results(spark, d):
    iv = V.intervals(spark, d)
    live = R.live_batch(iv, iv)
    return R.apply_results(live, results(iv)).select("media_id", "id", "source", "translated")


@query(
    "dropped_results",
    with_(V.IV, RESULTS, select="""select media_id, count(*) as dropped from res r where not exists (select 1 from iv i
      where i.media_id = r.media_id and i.id = r.id and i.stable) group by media_id"""),
)
def dropped_results(spark, d):
    iv = V.intervals(spark, d)
    return R.dropped_results(iv, results(iv))


@query(
    "check_results",
    with_(V.IV, RESULTS, """j as (select coalesce(i.media_id, r.media_id) as media_id, coalesce(i.ordinal, r.ordinal) // 30 as batch,
        i.id as bid, r.id as rid, i.translated as old, r.translated as new from iv i full join res r
        on i.media_id = r.media_id and i.id = r.id and i.ordinal // 30 = r.ordinal // 30),
      k as (select media_id, batch, count(*) filter (bid is null) as unknown, count(*) filter (rid is null) as missing,
        count(*) filter (bid is not null and rid is not null and old is null and trim(new) = '') as empty from j group by media_id, batch)""",
          select="""select *, case when unknown > 0 then 'unknown cue IDs' when missing > 0 then 'omitted cue IDs'
        when empty > 0 then 'empty translations' end as reason from k"""),
)
def check_results(spark, d):
    iv = V.intervals(spark, d)
    batch = F.floor(F.col("ordinal") / 30).alias("batch")
    return R.check_results(iv.select("*", batch), results(iv).select("*", batch))


@query(
    "id_diff",
    with_(V.IV, RESULTS, select="""select coalesce(i.media_id, r.media_id) as media_id, coalesce(i.id, r.id) as id,
      case when i.id is null then 'unknown' else 'missing' end as side from iv i full join res r
      on i.media_id = r.media_id and i.id = r.id where i.id is null or r.id is null"""),
)
def id_diff(spark, d):
    iv = V.intervals(spark, d)
    return R.id_diff(iv, results(iv), ["media_id"])


@query(
    "batch_summary",
    with_(V.IV, RESULTS, select="""select r.media_id, count(*) as processed,
      count(*) filter (i.id is not null and trim(r.source) <> '' and trim(r.source) <> trim(i.source)) as corrected,
      count(*) filter (i.id is not null and trim(r.translated) <> '' and trim(r.translated) <> trim(coalesce(i.translated, ''))) as updated
      from res r left join iv i on i.media_id = r.media_id and i.id = r.id group by r.media_id"""),
)
def batch_summary(spark, d):
    iv = V.intervals(spark, d)
    return R.batch_summary(iv, results(iv))


BOUNDS = """bd as materialized (select media_id, ordinal, bool_or(forced) as forced from (
    select media_id, pos - 1 as ordinal, false as forced from fin where pos > 0
    union all select media_id, stop - 1, (n - pos > 80 and not exists (select 1 from sil where sil.media_id = fin.media_id
      and ordinal between pos + 19 and pos + 78)) from fin where stop < n) group by media_id, ordinal)"""


HALVES = """half as materialized (
    select media_id, id || 'a' as id, start, "end", speaker, first_word, (first_word + last_word) // 2 as last_word from cues
    union all select media_id, id || 'b', start, "end", speaker, (first_word + last_word) // 2 + 1, last_word from cues
      where last_word > first_word),
  jn as materialized (select j.media_id, j.ordinal, j.forced, l.id as left_id, r.id as right_id, l.first_word as low, r.last_word as high
    from bd j join half l on l.media_id = j.media_id and j.ordinal between l.first_word and l.last_word
    join half r on r.media_id = j.media_id and j.ordinal + 1 between r.first_word and r.last_word
    where l.id <> r.id and (forced or (l.speaker is not distinct from r.speaker and r.start - l."end" < 0.8::double)))"""


def junctions(spark, d):
    """Suspicious junctions between cues that each cover half a turn, and those cues."""
    words, cues = V.words(spark, d), V.cues(spark, d)
    middle = F.floor((F.col("first_word") + F.col("last_word")) / 2).cast("int")
    left = cues.withColumns({"id": F.concat("id", F.lit("a")), "last_word": middle})
    right = cues.where("last_word > first_word").withColumns(
        {"id": F.concat("id", F.lit("b")), "first_word": middle + 1}
    )
    halves = left.unionByName(right)
    return R.suspicious_junctions(R.batch_boundaries(W.batch_words(words, 40), words), halves), halves


@query(
    "suspicious_junctions",
    with_(V.WORDS, V.TURNS, SILENCES, BATCHES, BOUNDS, HALVES, recursive=True, select="select * from jn"),
)
def suspicious_junctions(spark, d):
    return junctions(spark, d)[0]


@query(
    "replaced_cues",
    with_(V.WORDS, V.TURNS, SILENCES, BATCHES, BOUNDS, HALVES, recursive=True,
          select="""select distinct jn.media_id, jn.ordinal, c.id from jn join half c on c.media_id = jn.media_id
      and c.first_word >= low and c.last_word <= high and c.first_word <= high"""),
)
def replaced_cues(spark, d):
    return R.replaced_cues(*junctions(spark, d))


@query(
    "latest_by_key",
    with_(V.IV, select="""select media_id, event_type, max(ordinal) as ordinal, max_by(id, ordinal) as id from iv group by media_id, event_type"""),
)
def latest_by_key(spark, d):
    iv = V.intervals(spark, d).select("media_id", "event_type", "ordinal", "id")
    return R.latest_by(iv, ["media_id", "event_type"], "ordinal")


@query(
    "resume_point",
    with_(V.IV, "d as (select media_id, max(\"end\") * 1.25::double as duration from iv group by media_id)",
          select="""select media_id, greatest(0, max("end") - 5) as resume_at,
      greatest(0.01::double, least(1.0::double, (any_value(duration) - max("end")) / any_value(duration))) as remaining
      from iv join d using (media_id) group by media_id"""),
)
def resume_point(spark, d):
    iv = V.intervals(spark, d)
    return R.resume_point(iv, V.durations(iv, 1.25))


@query(
    "fold_traces",
    """with t as (select user_id as operation_id, event_id as seq, ts, case event_type when 'click' then 'running' when 'view' then 'retrying'
        when 'purchase' then 'completed' when 'error' then 'failed' else 'cancelled' end as state,
        case when event_id % 3 = 0 then ['c' || event_id] else [] end as cue_ids, case when event_id % 4 = 0 then 'm' || event_id else '' end as model,
        case when event_id % 5 = 0 then event_id % 3 end as attempt, case when event_id % 7 = 0 then event_id % 4 + 1 end as most from events)
      select operation_id, max_by(state, seq) as state, array_to_string(max_by(cue_ids, seq) filter (len(cue_ids) > 0), ',') as cue_ids,
        max_by(model, seq) filter (model <> '') as model, max_by(attempt, seq) filter (attempt is not null) as attempt, max_by(most, seq) filter (most is not null) as max_attempts,
        greatest(0, coalesce(round_even(epoch_us(max_by(ts, seq) filter (state in ('completed', 'failed', 'cancelled')))::double / 1e6
          - epoch_us(min_by(ts, seq))::double / 1e6, 0)::bigint, 0)) as elapsed, max_by(state, seq) in ('running', 'retrying') as active
      from t group by operation_id""",
)
def fold_traces(spark, d):
    e = V.table(spark, d, "events")
    state = F.element_at(
        F.create_map(*[F.lit(x) for x in (
            "click", "running", "view", "retrying", "purchase", "completed", "error", "failed", "signup", "cancelled")]),
        F.col("event_type"),
    )
    k = F.col("event_id")
    events = e.select(
        F.col("user_id").alias("operation_id"), k.alias("seq"), F.col("ts").cast("timestamp").alias("created_at"),
        state.alias("state"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("c"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("cue_ids"),
        F.when(k % 4 == 0, F.concat(F.lit("m"), k.cast("string"))).otherwise("").alias("model"),
        F.when(k % 5 == 0, k % 3).alias("attempt"), F.when(k % 7 == 0, k % 4 + 1).alias("max_attempts"),
    )
    out = R.fold_traces(events)
    return out.select("operation_id", "state", F.array_join("cue_ids", ",").alias("cue_ids"), "model", "attempt", "max_attempts",
                      F.coalesce("elapsed", F.lit(0)).alias("elapsed"), "active")


# --- subtitle checks and rendering ---

EVENTS_V = """ev as (select 'f' || (ordinal % 2) as artifact, media_id, row_number() over (partition by media_id, ordinal % 2 order by ordinal) as pos,
    start + 30 - case when ordinal % 17 = 0 then 30 else 0 end as start, "end" + 30 - case when ordinal % 23 = 0 then 9 else 0 end as "end",
    coalesce(speaker, '') as name, source from iv)"""
ASS_TIME = """(case when {0} < 0 then 0 else round_even({0} * 100, 0)::bigint end)"""


def ass_sql(x: str) -> str:
    c = ASS_TIME.format(x)
    return f"(({c} // 360000) || ':' || lpad((({c} // 6000) % 60)::varchar, 2, '0') || ':' || lpad((({c} // 100) % 60)::varchar, 2, '0') || '.' || lpad(({c} % 100)::varchar, 2, '0'))"


def file_events(spark, d):
    from cueloom.plans.blocks import Ordered, row_number

    iv = V.intervals(spark, d).withColumn("artifact", F.concat(F.lit("f"), (F.col("ordinal") % 2).cast("string")))
    placed = Ordered.of(iv, ["artifact", "media_id"], ["ordinal"]).scan(pos=row_number())
    return placed.rows.select(
        "artifact", "media_id", "pos",
        (F.col("start") + 30 - F.when(F.col("ordinal") % 17 == 0, 30).otherwise(0)).alias("start"),
        (F.col("end") + 30 - F.when(F.col("ordinal") % 23 == 0, 9).otherwise(0)).alias("end"),
        F.coalesce("speaker", F.lit("")).alias("name"), F.array("source").alias("text_lines"),
    )


PROBLEMS = f"""pm as (select *, 'event at ' || {ass_sql('start')} || case when name = '' then '' else ' (' || name || ')' end as label,
    max(start) over w as ms, max("end") over w as me, max(case when name = '' then "end" end) over w as mu,
    max("end") over (partition by artifact, media_id, name order by pos rows between unbounded preceding and 1 preceding) as mn
    from ev window w as (partition by artifact, media_id order by pos rows between unbounded preceding and 1 preceding)),
  problems as (select artifact, media_id, pos, 'end_before_start' as kind, label || ' ends before it starts' as message from pm where "end" < start
    union all select artifact, media_id, pos, 'out_of_order', label || ' starts before the event above it' from pm where start < ms
    union all select artifact, media_id, pos, 'overlap', label || ' overlaps an earlier cue of the same or an unnamed speaker' from pm
      where name <> '' and start < greatest(mn, mu)
    union all select artifact, media_id, pos, 'overlap', label || ' has no speaker and overlaps an earlier cue' from pm where name = '' and start < me)"""


@query("event_problems", with_(V.IV, EVENTS_V, PROBLEMS, select="select artifact, media_id, pos, kind, message from problems"))
def event_problems(spark, d):
    return Q.event_problems(file_events(spark, d)).drop("rank")


DRIFT = """art as (select 'a0' as artifact, media_id, row_number() over (partition by media_id order by ordinal) as pos, start, "end", coalesce(speaker, '') as name from iv),
  arts as (select * from art union all select 'a1', media_id, pos, start + case when pos % 1000 = 7 then 1 else 0 end, "end", name from art
    union all select 'a2', media_id, pos, start, "end", name from art where pos > 3 union all select 'a3', media_id, pos, start, "end", name from art)"""


@query(
    "artifact_mismatch",
    with_(V.IV, DRIFT, """c as (select media_id, artifact, count(*) as n from arts group by media_id, artifact)""",
          select="""select o.media_id, o.artifact, 'artifact_mismatch' as kind, o.artifact || ' has ' || o.n || ' cues but a0 has ' || b.n as message
        from c o join c b on b.media_id = o.media_id and b.artifact = 'a0' where o.n <> b.n
      union all select o.media_id, o.artifact, 'artifact_mismatch', o.artifact || ' cue ' || min(o.pos) || ' does not share the timing and speaker of a0'
        from arts o join art b on b.media_id = o.media_id and b.pos = o.pos where o.artifact <> 'a0' and o.artifact <> 'a2'
        and (o.start <> b.start or o."end" <> b."end" or o.name <> b.name) group by o.media_id, o.artifact"""),
)
def artifact_mismatch(spark, d):
    from cueloom.plans.blocks import Ordered, row_number

    iv = V.intervals(spark, d)
    base = Ordered.of(iv, ["media_id"], ["ordinal"]).scan(pos=row_number()).rows.select(
        "media_id", "pos", "start", "end", F.coalesce("speaker", F.lit("")).alias("name")
    )
    drift = base.withColumn("start", F.col("start") + F.when(F.col("pos") % 1000 == 7, 1).otherwise(0))
    events = base.withColumn("artifact", F.lit("a0"))
    for name, part in (("a1", drift), ("a2", base.where("pos > 3")), ("a3", base)):
        events = events.unionByName(part.withColumn("artifact", F.lit(name)))
    return Q.artifact_mismatch(events, base.select("media_id", F.lit("a0").alias("artifact")).distinct())


@query(
    "publish_blockers",
    with_(V.IV, EVENTS_V, PROBLEMS, """tol as (select distinct media_id, kind from problems where artifact = 'f0' and kind <> 'overlap')""",
          select="""select p.media_id, p.artifact, p.message from problems p where p.artifact = 'f1'
        and not exists (select 1 from tol where tol.media_id = p.media_id and tol.kind = p.kind)
      union all select distinct media_id, 'bad', 'is not valid UTF-8' from iv
      union all select distinct media_id, 'empty', 'contains no subtitle cues' from iv"""),
)
def publish_blockers(spark, d):
    events = file_events(spark, d)
    problems = Q.event_problems(events)
    tolerated = Q.tolerated_kinds(problems.where("artifact = 'f0' and kind <> 'overlap'"))
    medias = V.intervals(spark, d).select("media_id").distinct()
    files = medias.select(
        F.explode(F.array(
            F.struct(F.lit("f1").alias("artifact"), F.unhex(F.lit("41")).alias("content")),
            F.struct(F.lit("bad").alias("artifact"), F.unhex(F.lit("FF41")).alias("content")),
            F.struct(F.lit("empty").alias("artifact"), F.unhex(F.lit("41")).alias("content")),
        )).alias("f"), "media_id",
    ).select("f.artifact", "media_id", "f.content")
    return Q.publish_blockers(files, events.where("artifact = 'f1'"), problems.where("artifact = 'f1'"), tolerated)


@query(
    "fill_styles",
    with_(V.IV, """e as (select 'f' || media_id as artifact, ordinal as pos, coalesce(speaker, '') as name,
        case when ordinal % 13 = 5 then 'S' || ordinal else 'Default' end as style from iv),
      f as (select artifact, name, min_by(style, pos) as s from e where name <> '' and style <> 'Default' group by artifact, name)""",
          select="select artifact, pos, name, case when style = 'Default' then coalesce(s, style) else style end as style from e left join f using (artifact, name)"),
)
def fill_styles(spark, d):
    k = F.col("ordinal")
    return Q.fill_styles(V.intervals(spark, d).select(
        F.concat(F.lit("f"), F.col("media_id").cast("string")).alias("artifact"), k.alias("pos"),
        F.coalesce("speaker", F.lit("")).alias("name"),
        F.when(k % 13 == 5, F.concat(F.lit("S"), k.cast("string"))).otherwise("Default").alias("style"),
    ))


def header_sql(width: int, height: int, size: str, border: str, margins: str) -> str:
    """The lines above the events. Fixed values of the script format."""
    return f"""select [
        '[Script Info]', '; Generated by cueloom', 'ScriptType: v4.00+', 'PlayResX: {width}', 'PlayResY: {height}', 'WrapStyle: 0',
        'ScaledBorderAndShadow: yes', 'YCbCr Matrix: None', '', '[V4+ Styles]',
        'Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding',
        'Style: Default,sans-serif,{size},&H00FFFFFF,&H000000FF,&H00000000,&H7F000000,0,0,0,0,100,100,0,0,1,{border},2,{margins},1', '', '[Events]',
        'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text'] as h"""


def render_sql(view: str) -> str:
    fix = lambda x: f"replace(replace({x}, '{{', '｛'), '}}', '｝')"
    return f"""ren as (select media_id, row_number() over (partition by media_id order by ordinal) as pos, start, "end",
      coalesce(speaker, '') as name, {fix('source')} as src, {fix("trim(coalesce(translated, ''))")} as tr from {view}),
    fan as (select *, mode, case when mode = 'source' or tr = '' then src when mode = 'translated' then tr else tr || '\\N' || src end as text
      from ren cross join (values ('source'), ('translated'), ('bilingual')) m(mode)),
    body as (select mode as artifact, media_id, pos + 14 as line_no, 'Dialogue: 0,' || {ass_sql('start')} || ',' || {ass_sql('"end"')}
      || ',Default,' || name || ',0,0,0,,' || text as line from fan)"""


@query(
    "render_ass",
    with_(V.IV, render_sql("iv"), select="""select artifact, media_id, line_no, line from body
      union all select m.mode, media_id, i.k - 1, h[i.k] from (select distinct media_id from iv) cross join
        (values ('source'), ('translated'), ('bilingual')) m(mode) cross join (select unnest(range(1, 16)) as k) i cross join (""" + header_sql(1280, 720, "43", "2,1", "40,40,27") + ")"),
)
def render_ass(spark, d):
    iv = V.intervals(spark, d)
    res = iv.select("media_id", F.lit(1280).alias("width"), F.lit(720).alias("height")).distinct()
    return S.render_ass(S.cue_events(iv), res)


@query(
    "output_modes",
    with_(V.WORDS, V.TURNS, select="""select media_id, id, mode, case when mode = 'source' or translated is null then source
      when mode = 'translated' then translated else translated || chr(10) || source end as text
      from cues cross join (values ('source'), ('translated'), ('bilingual')) m(mode)"""),
)
def output_modes(spark, d):
    return S.fan_out_modes(V.cues(spark, d)).select("media_id", "id", "mode", F.array_join("text_lines", "\n").alias("text"))


@query(
    "ass_round_trip",
    with_(V.IV, render_sql("iv"), select=f"""select mode as artifact, media_id, pos,
      {ASS_TIME.format('start')}::double / 100 as start, {ASS_TIME.format('"end"')}::double / 100 as "end", name,
      replace(text, '\\N', chr(10)) as text from fan"""),
)
def ass_round_trip(spark, d):
    lines = S.render_ass(S.cue_events(V.intervals(spark, d)))
    events, _ = T.read_ass(lines)
    return events.select("artifact", "media_id", "pos", "start", "end", "name", F.array_join("text_lines", "\n").alias("text"))


def damaged_lines(spark, d):
    """Rendered source files with short lines, bad times and blank texts put in."""
    lines = S.render_ass(S.cue_events(V.intervals(spark, d), "source"))
    k = F.col("line_no") - 14
    broken = (
        F.when((k > 0) & (k % 50 == 3), "Dialogue: 0,oops")
        .when((k > 0) & (k % 50 == 9), F.regexp_replace("line", r"Dialogue: 0,[^,]*,", "DIALOGUE: 0,x,"))
        .when((k > 0) & (k % 50 == 21), F.regexp_replace("line", r",0,0,0,,.*$", ",0,0,0,, \\\\N "))
        .when((k > 0) & (k % 50 == 33), F.concat(F.lit("Comment: "), "line"))
        .otherwise(F.col("line"))
    )
    return lines.withColumn("line", broken)


@query(
    "ass_parse_problems",
    with_(V.IV, """k as (select media_id, row_number() over (partition by media_id order by ordinal) as k from iv),
      n as (select media_id, k, row_number() over (partition by media_id order by k) as n from k where k % 50 <> 33)""",
          select="""select 'source' as artifact, media_id, n, case k % 50 when 21 then 'empty_text' else 'unparsable' end as kind,
      'event ' || n || case k % 50 when 3 then ' has fewer than 10 Dialogue fields' when 9 then ' has an invalid timestamp' else ' has no subtitle text' end as message
      from n where k % 50 in (3, 9, 21)"""),
)
def ass_parse_problems(spark, d):
    return T.read_ass(damaged_lines(spark, d))[1]


@query(
    "ass_preview_cues",
    with_(V.IV, render_sql("iv"), select=f"""select mode as artifact, media_id, pos::varchar as id, case when text <> src and mode = 'bilingual' then src else text end as source,
      case when text <> src and mode = 'bilingual' then tr end as translated, nullif(name, '') as speaker,
      {ASS_TIME.format('start')}::double / 100 as start from fan"""),
)
def ass_preview_cues(spark, d):
    events, _ = T.read_ass(S.render_ass(S.cue_events(V.intervals(spark, d))))
    return T.ass_to_cues(events).select("artifact", "media_id", "id", "source", "translated", "speaker", "start")


@query(
    "canonicalize_ass",
    with_(V.IV, render_sql("iv"), """x as (select *, row_number() over (partition by media_id order by """ + ASS_TIME.format("start") + ", " + ASS_TIME.format('"end"') + """, name, pos) + 14 as line_no
        from fan where mode = 'source')""",
          select=f"""select 'source' as artifact, media_id, line_no, 'Dialogue: 0,' || {ass_sql('start')} || ',' || {ass_sql('"end"')}
      || ',Default,' || name || ',0,0,0,,' || text as line from x
      union all select 'source', media_id, i.k - 1, h[i.k] from (select distinct media_id from iv) cross join
        (select unnest(range(1, 16)) as k) i cross join ({header_sql(1920, 1080, "64", "3,1.5", "60,60,40")})"""),
)
def canonicalize_ass(spark, d):
    # The cues were rendered in reverse order of time; equal times keep their order, which
    # decides between events equal in name as well.
    iv = V.intervals(spark, d)
    back = F.struct(*[(-F.rint(F.col(c) * 100)).alias(c) for c in ("start", "end")], "ordinal")
    lines = S.render_ass(S.cue_events(iv.withColumn("ordinal", back), "source"))
    return S.canonicalize_ass(lines)


@query(
    "canonical_play_res",
    with_(V.IV, select="select distinct 'source' as artifact, media_id, 1280 as width, 720 as height from iv"),
)
def canonical_play_res(spark, d):
    iv = V.intervals(spark, d)
    res = iv.select("media_id", F.lit(1280).alias("width"), F.lit(720).alias("height")).distinct()
    ordered = S.cue_events(iv.withColumn("ordinal", (F.col("start") * 1000).cast("long") * 100000 + F.col("ordinal")), "source")
    lines = S.canonical_lines(S.render_ass(ordered, res), res)
    last = lines.groupBy("artifact", "media_id").agg((F.max("line_no") + 1).alias("line_no"))
    return S.canonical_play_res(lines.unionByName(last.withColumn("line", F.lit(""))))


# --- user functions over batches ---


def upper_reply(payload: dict) -> dict:
    """A stand-in for an agent: translates by upper-casing, drops one id in 29 at first."""
    cues = [c for c in payload["cues"] if payload.get("errors") or int(c["id"]) % 29 != 0]
    return {"cues": [{"id": c["id"], "source": c["source"], "translated": c["source"].upper()} for c in cues]}


@query(
    "map_batches",
    with_(V.IV, select="select media_id, id, source, upper(source) as translated from iv where ordinal % 29 <> 0"),
)
def map_batches(spark, d):
    from cueloom.operators.cues import fixed_batches

    iv = V.intervals(spark, d)
    payload = B.cue_payload(fixed_batches(iv, 20, 3, 2), iv, F.lit("en"), F.lit("de"))
    replies = B.map_batches(payload, upper_reply, B.CUE_REPLY)
    return replies.select("media_id", F.explode("reply.cues").alias("c")).select("media_id", "c.*")


@query(
    "batch_attempt_log",
    with_(V.IV, """b as (select media_id, id, ordinal, (row_number() over (partition by media_id order by ordinal) - 1) // 20 as batch from iv),
      g as (select media_id, batch, min_by(id, ordinal) as head, count(*) filter (id::bigint % 29 = 0) as gone from b group by media_id, batch)""",
          select="""select media_id, head, 1 as attempt, case when gone > 0 then 'failed' else 'complete' end as status,
        case when gone > 0 then 'omitted cue IDs' end as error from g
      union all select media_id, head, 2, 'complete', null from g where gone > 0"""),
)
def batch_attempt_log(spark, d):
    from cueloom.operators.cues import fixed_batches

    iv = V.intervals(spark, d)
    payload = B.cue_payload(fixed_batches(iv, 20, 3, 2), iv, F.lit("en"), F.lit("de"))

    def check(out):
        asked = F.size(F.from_json("payload", "struct<cues: array<struct<id: string>>>")["cues"])
        return out.withColumn("reason", F.when(F.size("reply.cues") < asked, "omitted cue IDs"))

    _, log = B.run_with_retries(payload, upper_reply, B.CUE_REPLY, check, attempts=3)
    return log


def word_batches(spark, d):
    """Batches of 40 words, and replies that claim words well and badly by their number."""
    # Read once for the heads and several times by the checks: timed and stored once.
    words = materialize(V.words(spark, d).withColumn("batch", F.floor(F.col("ordinal") / 40)))
    heads = words.groupBy("media_id", "batch").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / 8)))
    items = heads.withColumn("pos", piece).withColumns({
        "first_word": (F.col("lo") + F.col("pos") * 8).cast("int"),
        "last_word": F.least(F.col("hi"), F.col("lo") + F.col("pos") * 8 + 7).cast("int"),
    })
    k = F.col("batch")
    items = items.withColumns({
        "last_word": F.when((k % 5 == 1) & (F.col("pos") == 1), F.col("last_word") + 3)
        .when((k % 5 == 2) & (F.col("pos") == 0), F.col("hi") + 50)
        .otherwise(F.col("last_word")).cast("int"),
        "source": F.concat(F.lit("text "), F.col("first_word").cast("string")),
        "translated": F.when((k % 5 == 3) & (F.col("pos") == 2), " ").otherwise("words"),
    }).select("media_id", "batch", "pos", "first_word", "last_word", "source", "translated")
    return items, words.select("media_id", "batch", "ordinal", "start", "end", "text", "speaker")


# Claims of one reply in order: one that meets an earlier kept claim of its speaker is dropped.
CLAIMS = """bw as (select *, ordinal // 40 as batch from words),
  bh as (select media_id, batch, min(ordinal) as lo, max(ordinal) as hi from bw group by media_id, batch),
  bi as (select *, unnest(range((hi - lo) // 8 + 1)) as pos from bh),
  ci as (select media_id, batch, pos, (lo + pos * 8)::int as first_word,
      (case when batch % 5 = 1 and pos = 1 then least(hi, lo + pos * 8 + 7) + 3 when batch % 5 = 2 and pos = 0 then hi + 50
        else least(hi, lo + pos * 8 + 7) end)::int as last_word, case when batch % 5 = 3 and pos = 2 then '' else 'words' end as translated from bi),
  cl as (select c.*, 'cue ' || c.first_word || '–' || c.last_word as label, a.speaker as speaker,
      case when a.ordinal is null or z.ordinal is null then ' references words outside this batch'
           when c.last_word < c.first_word then ' ends before it starts'
           when a.speaker is distinct from z.speaker then ' starts and ends with different speakers' end as fault
    from ci c left join bw a on a.media_id = c.media_id and a.batch = c.batch and a.ordinal = c.first_word
      left join bw z on z.media_id = c.media_id and z.batch = c.batch and z.ordinal = c.last_word),
  so as (select *, row_number() over (partition by media_id, batch, speaker order by pos) as k from cl where fault is null),
  fo as (select media_id, batch, speaker, k, pos, true as ok, [{f: first_word, l: last_word}] as kept from so where k = 1 union all
    select s.media_id, s.batch, s.speaker, s.k, s.pos, len(list_filter(f.kept, lambda y: y.f <= s.last_word and s.first_word <= y.l)) = 0,
      case when len(list_filter(f.kept, lambda y: y.f <= s.last_word and s.first_word <= y.l)) = 0
        then list_append(f.kept, {f: s.first_word, l: s.last_word}) else f.kept end
    from fo f join so s on s.media_id = f.media_id and s.batch = f.batch and s.speaker is not distinct from f.speaker and s.k = f.k + 1),
  ok as (select so.*, fo.ok from so join fo on fo.media_id = so.media_id and fo.batch = so.batch and fo.speaker is not distinct from so.speaker and fo.k = so.k),
  cw as (select o.media_id, o.batch, o.pos, w.ordinal, w.start, w."end" from ok o join bw w on w.media_id = o.media_id and w.batch = o.batch
    and w.ordinal between o.first_word and o.last_word and w.speaker is not distinct from o.speaker where o.ok),
  sp as (select distinct media_id, batch, coalesce(speaker, '') as s, speaker is null as u from ok where ok),
  un as (select w.media_id, w.batch, coalesce(w.speaker, '') as s, w.speaker is null as u, list(w.ordinal order by w.ordinal) as o
    from bw w left join cw on cw.media_id = w.media_id and cw.batch = w.batch and cw.ordinal = w.ordinal where cw.ordinal is null group by all),
  er as (select media_id, batch, pos, label || fault as message from cl where fault is not null
    union all select media_id, batch, pos, label || ' claims words already covered by another cue of its speaker' from ok where not ok
    union all select media_id, batch, pos, label || ' has an empty translation' from ok where ok and translated = ''
    union all select media_id, batch, null, 'words of speaker ' || case when u then 'None' else s end || ' are not covered by any cue: '
        || array_to_string(o[1:10], ', ') from un semi join sp using (media_id, batch, s, u)
    union all select media_id, batch, null, 'no cue covers any words of speaker ' || s from
      (select distinct media_id, batch, coalesce(speaker, '') as s, speaker is null as u from bw) anti join sp using (media_id, batch, s, u))"""


@query(
    "validated_word_cues",
    with_(V.WORDS, CLAIMS, recursive=True, select="""select o.media_id, o.batch, o.pos, 'w' || first_word || '-' || last_word as id, min_by(start, ordinal) as start,
        greatest(min_by(start, ordinal), max("end")) as "end", 'text ' || first_word as source, translated, speaker, first_word, last_word
      from ok o join cw using (media_id, batch, pos) anti join er using (media_id, batch) where o.ok
      group by o.media_id, o.batch, o.pos, first_word, last_word, translated, speaker"""),
)
def validated_word_cues(spark, d):
    return B.validate_responses(*word_batches(spark, d))[0]


@query("word_response_errors", with_(V.WORDS, CLAIMS, recursive=True, select="select * from er"))
def word_response_errors(spark, d):
    return B.validate_responses(*word_batches(spark, d))[1]


def segmenting_reply(asked):
    """Cues of up to eight words of one speaker; some batches err until their errors are shown."""
    words, errors = asked["words"], asked.get("errors")
    batch = words[0]["ordinal"] // 40
    if batch % 5 == 4 and errors is None:
        raise ConnectionError("no answer")
    cues, run = [], []
    for w in [*words, None]:
        if run and (w is None or w.get("speaker") != run[-1].get("speaker") or len(run) == 8):
            cues.append({"first_word": run[0]["ordinal"], "last_word": run[-1]["ordinal"],
                         "source": f"text {run[0]['ordinal']}", "translated": "words"})
            run = []
        if w is not None:
            run.append(w)
    if batch % 5 == 2 and errors is None:
        cues[0]["last_word"] += 50
    if batch % 5 == 3 and errors is None:
        cues[-1]["translated"] = " "
    if batch % 10 == 3 and errors is not None and "translation" in errors[0]:
        cues[0]["source"] = ""
    return {"cues": cues}


RUNS = """wb as (select *, ordinal // 40 as batch, coalesce(speaker, '-') as sp from words),
  wc as (select *, case when sp is distinct from lag(sp) over (partition by media_id, batch order by ordinal) then 1 else 0 end as opens from wb),
  wd as (select *, sum(opens) over (partition by media_id, batch order by ordinal) as run from wc),
  we as (select *, (row_number() over (partition by media_id, batch, run order by ordinal) - 1) // 8 as part from wd)"""


def round_trip(spark, d):
    words = word_batches(spark, d)[1]
    return B.run_word_batches(words, segmenting_reply, scratch_dir(spark, "round-trip"))


@query(
    "word_round_trip",
    with_(V.WORDS, RUNS, select="""select media_id, batch, case batch % 5 when 2 then 2 when 4 then 2 when 3 then case when batch % 10 = 3 then 3 else 2 end else 1 end as attempt,
        'w' || min(ordinal) || '-' || max(ordinal) as id, min_by(start, ordinal) as start, greatest(min_by(start, ordinal), max("end")) as "end",
        'text ' || min(ordinal) as source, 'words' as translated, any_value(speaker) as speaker, min(ordinal) as first_word, max(ordinal) as last_word
      from we group by media_id, batch, run, part"""),
)
def word_round_trip(spark, d):
    return round_trip(spark, d)[0]


@query(
    "word_attempt_log",
    with_(V.WORDS, """n as (select distinct media_id, ordinal // 40 as batch from words),
      l as (select *, case batch % 5 when 2 then 2 when 4 then 2 when 3 then case when batch % 10 = 3 then 3 else 2 end else 1 end as last from n),
      a as (select *, unnest(range(1, last + 1)) as attempt from l)""",
          select="""select media_id, batch, attempt, 'running' as status from a
      union all select media_id, batch, attempt, case when attempt = last then 'complete' else 'failed' end from a"""),
)
def word_attempt_log(spark, d):
    return round_trip(spark, d)[1].select("media_id", "batch", "attempt", "status")


@query(
    "published_ass_files",
    with_(V.IV, "iv50 as (select * replace (ordinal % 50 as media_id) from iv)", render_sql("iv50"),
          "hd as (" + header_sql(1920, 1080, "64", "3,1.5", "60,60,40") + ")",
          """al as (select artifact, media_id, line_no, line from body union all select artifact, media_id, i.k - 1, h[i.k]
        from (select distinct artifact, media_id from body) cross join (select unnest(range(1, 16)) as k) i cross join hd),
      fi as (select artifact, media_id, count(*) as lines, string_agg(line, chr(10) order by line_no) || chr(10) as content from al group by artifact, media_id)""",
          select="""select 'talk' || media_id || case artifact when 'bilingual' then '.pt-br-de.ass' else '.' || artifact || '.ass' end as name,
      lines, octet_length(encode(content))::bigint as bytes, sha256(content) as sha256 from fi"""),
)
def published_ass_files(spark, d):
    """Fifty recordings in three modes: read back from the files, in the order of their lines."""
    iv = V.intervals(spark, d).withColumn("media_id", F.col("ordinal") % 50)
    path = scratch_dir(spark, "published")
    base = F.concat(F.lit("talk"), F.col("media_id").cast("string"))
    S.publish_ass(S.render_ass(S.cue_events(iv)), path, base, F.lit("pt_BR"), F.lit("de"))
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        (F.size(F.split(F.decode("content", "utf-8"), "\n")) - 1).cast("long").alias("lines"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
    )
