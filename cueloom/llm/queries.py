"""One query per operator of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import (
    op1_resample, op2_differencing, op3_warc, op4_forest, op5_surrogates, op6_containment, op7_paragraphs,
    op8_mixture, op9_projected, op10_licenses, op11_alignment, op12_variants, op13_topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = op1_resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", F.col("__importance").alias("importance"), F.col("__draw").alias("draw"))


@query()
def op4_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4_forest.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_id", "links")


@query()
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = op5_surrogates.with_surrogates(table(spark, sf_dir, "documents"))
    return replaced.select("doc_id", "text", F.col("__replaced").alias("replaced"))


@query(
    """
    with items as (
      select item_id, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+') w from benchmark),
    ig as (select distinct item_id, array_to_string(w[i:i+4], ' ') g from items, unnest(range(1, len(w) - 3)) t(i)),
    docs as (
      select doc_id, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+') w from documents),
    dg as (select distinct doc_id, array_to_string(w[i:i+4], ' ') g from docs, unnest(range(1, len(w) - 3)) t(i)),
    n as (select item_id, count(*) n from ig group by 1)
    select doc_id, item_id, count(*) / min(n)::double containment
    from dg join ig using (g) join n using (item_id)
    group by doc_id, item_id having count(*) >= 0.8 * min(n) - 1e-9
    """
)
def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_containment.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query(
    """
    with d as (
      select doc_id, source, md5('mixture:' || coalesce(doc_id::varchar, '')) k,
             coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size from documents),
    s as (select source, sum(size)::bigint source_size from d group by source),
    w as (
      select source, source_size,
             [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double w,
             2.0::double * source_size lim from s),
    r as (select *, lim / w ratio from w),
    l as (
      select *, (sum(source_size) over () * 1.5::double - coalesce(sum(lim) over before, 0))
                / (sum(w) over () - coalesce(sum(w) over before, 0)) level
      from r window before as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
    f as (select *, ratio <= level as at_limit, max(case when ratio > level then level end) over () free from l),
    t as (select source, source_size, case when at_limit then lim else w * free end target from f),
    b as (
      select d.doc_id, d.size, t.source_size, t.target, round(t.target)::bigint budget,
             coalesce(sum(d.size) over (partition by d.source order by k, d.doc_id, d.size
                      rows between unbounded preceding and 1 preceding), 0) before
      from d join t on d.source is not distinct from t.source)
    select doc_id, size, source_size, target,
           (coalesce(budget // nullif(source_size, 0), 0) * size
            + least(size, greatest(budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - before, 0)))::bigint taken
    from b
    """
)
def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op8_mixture.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(
    """
    with p as (select page_id, coalesce(html, '') html from pages),
    d as (select page_id, octet_length(encode(html))::bigint payload_bytes, sha256(html) payload_digest from p),
    f as (select payload_digest, min(page_id) as first, count(*) n from d where payload_bytes >= 100 group by 1),
    r as (select d.*, n > 1 and first is not null and (page_id is null or page_id > first) as again, first
          from d left join f using (payload_digest))
    select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end record_type,
           case when again then first end refers_to
    from r
    """
)
def op3_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = op3_warc.read_warc(op3_warc.write_warc(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return op9_projected.neighbours(vectors, vectors.where("vec_id % 20 = 0"))


@query()
def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_differencing.main_texts(table(spark, sf_dir, "pages"))


@query()
def op7_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = op7_paragraphs.repeated_passages(table(spark, sf_dir, "documents"))
    return passages.select("doc_id", "start", "words", "cluster_id", "kept")


@query()
def op10_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_licenses.license_notices(table(spark, sf_dir, "documents"))


@query(
    """
    with recursive bits as (select i, i::bigint c, 0 k from range(256) r(i)
      union all select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from bits where k < 8),
    crc as (select list(c order by i) t from bits where k = 8),
    runs as (
      select coalesce(doc_id::varchar, '') id,
             translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run
      from documents),
    each as (select id, run, count(*) c from runs where length(run) >= 7 group by all),
    coded as (
      select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
          list_transform(range(octet_length(encode(id || ':' || run))),
                         lambda i: ('0x' || hex(encode(id || ':' || run))[(2 * i + 1)::int : (2 * i + 2)::int])::bigint)),
          lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::int]))) h
      from each, crc),
    w as (
      select case when h % 31 = 0 then left(run, (h % length(run))::int) || right(run, (length(run) - h % length(run) - 1)::int) else run end word, sum(c)::bigint n
      from coded group by 1),
    v as (select * from w where length(word) >= 7 and n >= 2),
    gone as (select word, n, i, left(word, i::int) || right(word, (length(word) - i - 1)::int) rest from v, unnest(range(length(word))) u(i)),
    pairs as (
      select a.word, b.word near, b.n near_n from gone a join gone b on a.rest = b.rest and a.i = b.i and a.word <> b.word
      union select g.word, v.word, v.n from gone g join v on v.word = g.rest
      union select v.word, g.word, g.n from gone g join v on v.word = g.rest),
    best as (select word, count(*) n_near, max(near_n) most from pairs group by word),
    named as (
      select v.word, v.n, coalesce(n_near, 0)::bigint n_near, case when most >= 10 * v.n then most end form_n,
             case when most >= 10 * v.n then (select min(near) from pairs p where p.word = v.word and p.near_n = most) end form
      from v left join best using (word)),
    chain as (select word, form, coalesce(form, word) root from named
      union all select c.word, m.form, m.form from chain c join named m on m.word = c.root where c.form is not null and m.form is not null),
    last as (select word, max_by(root, n) root from chain join (select word root, n from named) r using (root) group by word)
    select word, form, root, n, n_near, form_n from named join last using (word)
    """
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_variants.variants(table(spark, sf_dir, "documents"))


@query(
    """
    with v as (
      select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
      from embeddings
      where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as (
      select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
      from v q join v c on q.r <> c.r where q.vec_id % 50 = 0),
    n as (select *, row_number() over (partition by r order by score desc, vec_id)::int as rank from p)
    select query_id, rank, vec_id, score from n where rank <= 5
    """
)
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_topk.top_products(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_alignment.agreement(table(spark, sf_dir, "documents"))
