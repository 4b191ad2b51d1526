"""Each corpus operator against brute force, and on awkward rows."""

import gzip
import io
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cueloom.llm import (
    graph, op1_resample, op2_differencing, op3_warc, op4_forest, op5_surrogates, op6_containment,
    op7_paragraphs, op8_mixture, op9_projected, op10_licenses,
)
from cueloom.llm.store import stored
from cueloom.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, vertex string, key int, root int, size int"
LONG = " ".join(f"w{i % 997}x{i % 1009}" for i in range(60_000))


def docs_of(spark, rows):
    full = [(i, t, "en", s, len(t or ""), "v", 1, 2, 3) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") * 2 + str(rng.randrange(60)) for _ in range(n)]


def awkward(spark):
    text = " ".join(prose(1, 80))
    return docs_of(spark, [
        (1, text, "a"), (1, text, "a"), (2, text + " more", None), (None, text, "b"), (3, None, "a"),
        (4, "", "b"), (5, "  \n", None), (6, "one two", "a"), (7, LONG, "c"), (None, None, None), (8, "one two", "a"),
    ])


def shingles(text):
    w = re.findall(r"[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_forest_equals_brute_force(spark):
    rows = []
    for g in range(12):
        base = prose(g, 120)
        for c in range(6):
            words = list(base)
            for k in range(c * 2):
                words[(k * 17 + c) % 120] = f"z{g}q{c}q{k}"
            rows.append((len(rows), " ".join(words), "a"))
    got = {r.doc_id: r for r in op4_forest.similar_documents(docs_of(spark, rows), block=4).collect()}
    sets = [shingles(r[1]) for r in rows]
    linked = [[j for j in range(len(rows)) if j != i and len(a & sets[j]) >= 0.8 * len(a | sets[j])] for i, a in enumerate(sets)]
    assert [got[i].links for i in range(len(rows))] == [len(x) for x in linked]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *[group[j] for j in linked[i]]]) for i in range(len(rows))]
    assert [got[i].class_id for i in range(len(rows))] == group
    kept = {r.doc_id for r in op4_forest.keep_one(docs_of(spark, rows)).collect()}
    assert kept == set(group)


def test_forest_awkward_rows(spark):
    found = op4_forest.similar_documents(awkward(spark)).collect()
    assert len(found) == 11
    assert sorted(r.links for r in found) == [0] * 5 + [1, 1] + [3] * 4
    kept = op4_forest.keep_one(awkward(spark))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in kept.collect())
    assert ids == sorted([(False, 1, False), (False, 3, True), (False, 4, False), (False, 5, False),
                          (False, 6, False), (False, 7, False), (True, 0, True)])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(101, 100)], "hi long, lo long")
    got = {r.vertex: r.root for r in op7_paragraphs.graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(prose(100 + i, rng.choice([6, 9, 20, 45, 90])))) for i in range(30)] + [(90, "alpha beta"), (91, ""), (92, None)]
    texts = []
    for i in range(40):
        words = prose(500 + i, rng.choice([30, 400, 3000]))
        if i % 2 == 0:
            item = items[i % 30][1].split()
            if i % 4 == 0 and len(item) > 40:
                item[20] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = item
        texts.append((i, " ".join(words), "a"))
    texts += [(60, "say ALPHA, beta now", "a"), (61, None, "a"), (62, "", "a")]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op6_containment.contained_items(docs, bench, block_items=10).collect()}
    want = {(60, 90)}
    for d, t, _ in texts:
        for i, x in items:
            s = shingles(x)
            if len((x or "").split()) >= 5 and len(s & shingles(t)) >= 0.8 * len(s) - 1e-9:
                want.add((d, i))
    assert got == want
    left = op6_containment.without_items(docs, bench)
    assert {r.doc_id for r in left.collect()} == {t[0] for t in texts} - {d for d, _ in want}


def test_paragraphs_find_pasted_passages(spark):
    passage = prose(7, 55)
    rows = [(i, " ".join(prose(1000 + i, 300)), "a") for i in range(30)]
    for i in range(0, 30, 3):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:90] + passage + w[90:]), "a")
    docs = docs_of(spark, rows)
    found = op7_paragraphs.repeated_passages(docs)
    hits = found.collect()
    assert {r.doc_id for r in hits} == set(range(0, 30, 3))
    first = {}
    for r in sorted(hits, key=lambda r: (r.doc_id, r.start)):
        assert r.kept == (r.cluster_id not in first)
        first.setdefault(r.cluster_id, r.doc_id)
    assert 0 in first.values()
    assert all(90 <= r.start and r.start + r.words <= 145 for r in hits)
    cut = {r.doc_id: r.text for r in op7_paragraphs.without_passages(docs, found).collect()}
    assert cut[0] == rows[0][1] and cut[1] == rows[1][1] and len(cut[27].split()) <= 329
    assert op7_paragraphs.repeated_passages(awkward(spark)).where("doc_id in (3,4,5,6,8)").count() == 0


def test_paragraphs_find_edited_passages_to_their_ends(spark):
    rows, spans = [], {}
    for g, (size, edits) in enumerate([(51, [25]), (60, [3]), (60, [30]), (100, []), (150, [40, 90]), (400, [60, 200, 330])]):
        passage = prose(50 + g, size)
        edited = [f"z{g}q{k}" if k in edits else w for k, w in enumerate(passage)]
        for c, text in enumerate([passage, edited]):
            w, at = prose(3000 + len(rows), 300), 70 + 31 * c
            spans[len(rows)] = (at, at + size)
            rows.append((len(rows), " ".join(w[:at] + text + w[at:]), "a"))
    docs = docs_of(spark, rows)
    found = op7_paragraphs.repeated_passages(docs)
    got = {r.doc_id: (r.start, r.start + r.words, r.cluster_id, r.kept) for r in found.collect()}
    assert found.count() == len(got) == len(rows)
    for d, (begin, end, cluster, kept) in got.items():
        first = spans[d][0] + (4 if d in (2, 3) else 0)  # three words before an edit may be cut off
        assert spans[d][0] <= begin <= first and end == spans[d][1]
        assert kept == (d % 2 == 0) and cluster == got[d - d % 2][2]
    cut = {r.doc_id: r.text for r in op7_paragraphs.without_passages(docs, found).collect()}
    assert cut[0] == rows[0][1] and len(cut[7].split()) == 300 and len(cut[11].split()) == 300


def test_mixture_budgets_and_awkward_rows(spark):
    docs = docs_of(spark, [(i, " ".join(prose(i, 1 + i % 9)), f"s{i % 5}") for i in range(300)])
    rows = op8_mixture.mix(docs).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(t - n) <= 1 and t <= 2 * s for t, n, s in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    again = op8_mixture.mix(docs.repartition(7), range_digits=1).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    odd = op8_mixture.mix(awkward(spark)).collect()
    assert len(odd) == 11 and all(r.taken == 0 for r in odd if not (r.text or "").strip())


def test_surrogates_keep_kind_and_distinctness(spark):
    texts = [f"mail u{i}@a{i % 7}.com, +1 ({200 + i}) 555-0{100 + i}, card 4{i:015d}, 10.0.{i}.7" for i in range(60)]
    texts += ["Mr. John Roe and MRS. Ann Roe, Mr. Roe", "Herr JOHN ROE, д-р; господин Иван Петров", None, "", "no data"]
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    out = {r.doc_id: r.text for r in op5_surrogates.with_surrogates(docs).collect()}
    for pattern in (r"\S+@\S+\.com", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d{16}\b", r"\b\d+\.\d+\.\d+\.\d+\b"):
        old = [m for t in texts[:60] for m in re.findall(pattern, t)]
        new = [m for i in range(60) for m in re.findall(pattern, out[i])]
        assert len(new) == 60 and len(set(new)) == 60 and not set(old) & set(new)
    names = re.fullmatch(r"Mr\. (\w+) (\w+) and MRS\. (\w+) (\w+), Mr\. (\w+)", out[60])
    assert names and names[2] == names[4] == names[5] != "Roe" and names[1] in op5_surrogates.GIVEN["latin"]["m"]
    assert names[3] in op5_surrogates.GIVEN["latin"]["f"]
    assert out[61].startswith(f"Herr {names[1].upper()} {names[2].upper()}, ")
    assert re.search(r"господин [А-Я][а-я]+ [А-Я][а-я]+$", out[61]) and "Петров" not in out[61]
    assert (out[62], out[63], out[64]) == (None, "", "no data")


def test_resampling_parts_junk_from_prose(spark):
    rows = [(i, " ".join(prose(i % 50, 40)), "a") for i in range(200)] + [(200 + i, "BUY!! NOW!! " * 30 + str(i), "a") for i in range(40)]
    rows += [(500, None, "a"), (501, "", "a"), (None, "aa bb", "a")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(0, 200, 2)] + [(200 + i, 0, 0) for i in range(0, 40, 2)] + [(None, 1, 0), (7, None, None)],
        "doc_id long, quality int, toxic int")
    kept = op1_resample.keep_good(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(200)) <= ids and not ids & set(range(200, 240)) and kept.columns == docs.columns
    assert op1_resample.keep_good(docs, labels.where("false")).count() == len(rows)


def test_resampling_drops_toxic_documents_of_good_quality(spark):
    rows = [(i, " ".join(prose(i % 50, 60)), "a") for i in range(300)]
    for i in range(0, 300, 5):  # long texts with a few toxic words
        w = prose(i % 50, 60) * 8
        rows[i] = (i, " ".join(w[:90] + ["vilest", "scum"] + w[90:]), "a")
    rows += [(300 + i, "BUY!! NOW!! " * 30 + str(i), "a") for i in range(40)]
    labels = spark.createDataFrame(
        [(i, 1, int(i % 5 == 0)) for i in range(300) if i % 3] + [(300 + i, 0, 0) for i in range(0, 40, 2)],
        "doc_id long, quality int, toxic int")
    for told in (labels, labels.where("quality = 1")):
        ids = {r.doc_id for r in op1_resample.keep_good(docs_of(spark, rows), told).collect()}
        assert {i for i in range(300) if i % 5} <= ids and not ids & set(range(0, 300, 5))
    assert not ids or {r.doc_id for r in op1_resample.keep_good(docs_of(spark, rows), labels).collect()}.isdisjoint(range(300, 340))


def test_kth_largest(spark):
    values = spark.createDataFrame([(float((i * 7919) % 1000) ** 3,) for i in range(1000)], "x double")
    ordered = sorted((r.x for r in values.collect()), reverse=True)
    for k in (1, 10, 517, 1000):
        assert op1_resample.kth_largest(values, "x", k) == ordered[k - 1]


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(i, f"http://h/{i}\n", big if i % 3 == 0 else f"<p>{i}") for i in range(40)] + [
        (50, None, None), (51, "u", ""), (None, "u", big), (3, "v", big), (0, "w", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    manifest = op3_warc.write_warc(pages, str(tmp_path / "w"), roll_bytes=600)
    assert manifest.count() > 4
    got = op3_warc.read_warc(manifest).collect()
    assert len(got) == len(rows)
    assert {r.page_id for r in got if r.record_type == "revisit"} == {3, *range(6, 40, 3), None}
    assert all(r.refers_to == 0 for r in got if r.record_type == "revisit")
    again = op3_warc.write_warc(pages.repartition(5), str(tmp_path / "w2"), roll_bytes=600)
    digest = lambda m: sorted((r.path.rsplit("/", 1)[1], r.sha256) for r in m.collect())
    assert digest(again) == digest(manifest)
    data = gzip.decompress(open(manifest.first().path, "rb").read()).replace(b"<p>", b"<q>", 1)
    with pytest.raises(ValueError):
        list(op3_warc.parse(io.BytesIO(data)))
    assert op3_warc.read_warc(op3_warc.write_warc(pages.where("false"), str(tmp_path / "e"))).count() == 0


PAGE = (
    "<html><head><title>t</title><script>a<b</script></head><body><nav><a>menu</a></nav><div class='ad x'>buy</div>{}"
    "<footer>&copy; f</footer></body></html>"
)


def test_page_texts(spark):
    body = "<h1>A &amp; B</h1><p>one\n  two<b>!<p>three<aside>no</aside><div class=comments><p>hi</div><form>q</form>"
    rows = [(1, "http://h/a", PAGE.format(f"<article>{body}</article>")), (2, None, None), (3, "http://g/", ""),
            (4, "http://k/a", PAGE.format("<p>same line</p><p>first page has these words of its own</p>")),
            (5, "http://k/b", PAGE.format("<p>same line</p><p>second page has other words instead</p>")),
            (6, "http://c/a", PAGE.format("<p>copy text</p>")), (7, "http://c/b", PAGE.format("<p>copy text</p>"))]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").coalesce(1)
    got = {r.page_id: r for r in op2_differencing.main_texts(pages).collect()}
    assert got[1].text == "A & B\none two!\nthree" and got[1].n_chars == 20
    assert (got[2].text, got[3].text, got[2].n_chars) == ("", "", 0)
    assert got[6].text == got[7].text == "copy text"
    near = {got[4].text, got[5].text}
    assert near <= {"same line\n" + w for w in ("first page has these words of its own", "second page has other words instead")} | {
        "first page has these words of its own", "second page has other words instead"}


def test_pages_at_range_edges_have_both_neighbours(spark):
    rows = []
    for i in range(24):  # every page shares one line with each of its two neighbours, and none with others
        own = " ".join(prose(700 + i, 20))
        rows.append((i, f"http://h/{i:02}", PAGE.format(f"<p>line {i}</p><p>{own}</p><p>line {i + 1}</p>"), own))
    rows.append((99, "http://i/0", PAGE.format("<p>line 24</p><p>alone</p>"), "line 24\nalone"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = {r[0]: r[3] for r in rows} | {0: "line 0\n" + rows[0][3], 23: rows[23][3] + "\nline 24"}
    for n in ("1", "4", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = [(r.page_id, r.text) for r in op2_differencing.main_texts(pages).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(got) == sorted(want.items())


def test_page_texts_are_stored_nowhere(spark):
    rows = [(i, f"http://h/{i % 40:02}", PAGE.format(f"<p>line {i}</p>")) for i in range(200)]
    pages = spark.createDataFrame([*rows, (None, None, None)], "page_id long, url string, html string")
    folder = Path(shared_dir(spark))
    before = set(folder.rglob("*"))
    got = [(r.page_id, r.text) for r in op2_differencing.main_texts(pages).collect()]
    assert set(folder.rglob("*")) == before
    assert sorted(got, key=str) == sorted([*((i, f"line {i}") for i in range(200)), (None, "")], key=str)
    assert op2_differencing.main_texts(pages.where("false")).count() == 0


def test_lcs_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert len(op2_differencing.shared_lines(a, b)) == table[-1, -1]
    assert op2_differencing.differenced(["x", "long own line", "y"], [["x", "q", "y"]], 0.5) == ["long own line"]


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[100:160] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [1.0]), (None, [1.0] * 16),
           (904, [None] + [1.0] * 15), (5, rows[5][1]), (905, [float("inf")] * 16)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = op9_projected.neighbours(vectors, vectors.where("vec_id % 20 = 0"), block_points=200, block_queries=10).collect()
    asked = sorted({r.query_id for r in got})
    assert asked == list(range(0, 900, 20))
    hit = 0
    for q in asked:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        score = (x * x[q]).sum(1)
        assert all(abs(score[r.vec_id] - r.score) < 1e-12 and r.vec_id != q for r in mine)
        score[q] = -np.inf
        hit += len({r.vec_id for r in mine} & set(np.lexsort((np.arange(900), -score))[:20].tolist()))
    assert hit >= 0.9 * 20 * len(asked)
    few = vectors.where("vec_id < 4")
    assert op9_projected.neighbours(few, few.where("vec_id = 0")).count() == 3
    assert op9_projected.neighbours(few.where("false"), few).count() == 0


def test_licenses(spark):
    texts = ["foo Released under the MIT license. Next", "Licensed under the Apache License, Version 1.1.",
             "Licensed under CC BY-NC 4.0. and Licensed under CC BY 4.0.", "a license plate", None, "",
             "x " + op10_licenses.TEMPLATES["MIT"][2].replace("free of charge", "without charge") + " y", "Licensed under CC BY-ND 4.0."]
    got = op10_licenses.license_notices(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(0, "MIT"), (2, "CC-BY-4.0"), (2, "CC-BY-NC-4.0"), (6, "MIT")]
    long = next(r for r in got if r.doc_id == 6)
    assert set(long.missing) | set(long.extra) == {"free", "of", "without"}
    assert texts[6][long.start : long.end].startswith("Permission")


def test_empty_documents_everywhere(spark):
    none = docs_of(spark, [(1, "a", "b")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for frame in (
        op1_resample.keep_good(none, labels), op4_forest.keep_one(none), op5_surrogates.with_surrogates(none),
        op6_containment.contained_items(none, bench), op6_containment.without_items(none, bench),
        op7_paragraphs.repeated_passages(none), op8_mixture.mix(none), op10_licenses.license_notices(none),
    ):
        assert frame.count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf))
        if name != "mixture":
            assert docs.columns == before.columns
        assert docs.count() <= before.count()
    assert docs.where("taken <= 0").count() == 0


def test_paragraphs_that_meet_only_their_neighbours_are_not_candidates(spark):
    def shared(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["content"])
        band = op7_paragraphs._bander(26, 24, 8, 2, 0.95)  # paragraphs one word apart stay under it
        rows = pa.Table.from_batches(list(band(iter([batch])))).sort_by("root")
        out = op7_paragraphs._shared(iter(rows.to_batches(max_chunksize=7)))
        return pa.Table.from_batches(list(out)).to_pandas()

    alone = [" ".join(prose(8000 + i, 400)) for i in range(10)]
    assert not len(shared(alone))
    # A copy with a changed word meets the original, and a text that repeats itself meets itself.
    words = alone[0].split()
    edited = " ".join([*words[:200], "changed", *words[201:]])
    met = shared([*alone, edited])
    assert len(met) and met.groupby("root").vertex.nunique().min() > 1
    assert len(shared([" ".join(["a", "b", "c", "d", "e", "f", "g"] * 20)]))


def test_paragraphs_words_around_neighbours_travel_once(spark):
    words = prose(8100, 600)
    starts = [0, 12, 25, 200, 590 - 26]
    wanted = [{"pack": p, "i": 0, "j": 0, "mine": 0, "id": 10 * p + k, "start": s} for p in (7, 3) for k, s in enumerate(starts)]
    batch = pa.RecordBatch.from_pylist(
        [{"content": " ".join(words), "doc_id": 1, "digest": 2, "wanted": wanted}],
        schema=pa.schema([("content", pa.string()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("wanted", pa.list_(pa.struct([
            ("pack", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("mine", pa.int32()), ("id", pa.int64()), ("start", pa.int32())])))]),
    )
    pieces = pa.Table.from_batches(list(op7_paragraphs._slicer(26, 48)(iter([batch]))))
    assert sorted(pieces["pack"].to_pylist()) == [3, 3, 3, 7, 7, 7]
    assert sum(map(len, pieces["words"].to_pylist())) == 2 * ((25 + 74) + (48 + 74) + (48 + 26 + 10))
    hashes = (op7_paragraphs.shingles.words(pa.array([" ".join(words)]))[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    around = op7_paragraphs._Windows(pieces, 26)
    for k in range(len(around.id)):
        text, _, at = around.around(k)
        s = around.start[k]
        assert s == starts[around.id[k] % 10] and at == min(s, 48)
        assert (text == hashes[max(0, s - 48) : s + 74]).all()


def test_paragraphs_that_share_a_root_are_linked_to_the_least(spark):
    texts = [" ".join(prose(8200 + i, 300)) for i in range(6)]
    words = texts[0].split()
    texts.append(" ".join([*words[:150], "changed", *words[151:]]))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 3])], ["content"]) for i in range(0, 7, 3)]
    band = op7_paragraphs._bander(26, 24, 8, 2, 0.95)
    plain = pa.Table.from_batches(list(band(iter(batches)))).sort_by("root")
    met = pa.Table.from_batches(list(op7_paragraphs._shared(iter(plain.to_batches())))).to_pandas()
    met["lo"] = met.groupby("root").vertex.transform("min")
    want = {(lo, hi) for lo, hi in zip(met.lo, met.vertex) if lo != hi}
    sent = pa.Table.from_batches(list(op7_paragraphs._sender(band, 5)(iter(batches)))).sort_by("part")
    got = pa.Table.from_batches(list(op7_paragraphs._met(iter(sent.to_batches(max_chunksize=2))))).to_pandas()
    assert want and set(zip(got.lo, got.hi)) == want


def test_components_that_leave_the_rounds_early(spark):
    chain = [(k + 1, k) for k in range(40)] + [(100, 99), (102, 99), (103, 102), (201, 200)]
    edges = spark.createDataFrame(chain, "hi long, lo long")
    for after in (1, 2):
        found = {r.vertex: r.root for r in op7_paragraphs.graph.components(edges, shed_after=after).collect()}
        assert found == {r.vertex: r.root for r in op7_paragraphs.graph.components(edges).collect()}
        assert found[40] == 0 and found[103] == 99 and found[201] == 200 and len(found) == 47
