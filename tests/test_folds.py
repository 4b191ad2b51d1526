"""Greedy operators against small loops over random rows, whole and in blocks."""

import random
import unicodedata
from statistics import median

import pytest
from pyspark.sql import functions as F

from cueloom.operators import batches as BT
from cueloom.operators import chunks as K
from cueloom.operators import intervals as I
from cueloom.operators import reconcile as R
from cueloom.operators import words as W

WORD = "media_id long, ordinal int, start double, end double, text string, speaker string"


def width(text):
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def random_words(seed, n=160, media=(1, 2)):
    rng = random.Random(seed)
    out = []
    for m in media:
        t = 0.0
        for i in range(n if m == 1 else n // 4):
            t = round(t + rng.choice([0, 0, 0.1, 0.2, 0.8, 1.5]), 3)
            d = rng.choice([0.01, 0.01, 0.02, 0.3, 0.5])
            text = rng.choice(["hi ", "yes. ", "漢字", "word ", " ", "a", 'so." ', "longer-word "])
            out.append((m, i, t, round(t + d, 3), text, rng.choice(["A", "A", "B", None])))
            t = round(t + d * rng.choice([0.5, 1]), 3)
    return out


def by_media(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def segmented(words, max_s, max_c):
    found = []
    for speaker in {w[5] for w in words}:
        track, current = [w for w in words if w[5] == speaker], []
        pieces = []
        for w in track:
            if current:
                before = current[-1][4].rstrip()
                while before and before[-1] in "\"'”’»›』」）)]":
                    before = before[:-1]
                joined = width("".join(x[4] for x in [*current, w]).strip())
                lasted = w[3] - current[0][2]
                hard = w[2] - current[-1][3] >= 0.8 or (before and before[-1] in ".?!。？！…")
                soft = (lasted > max_s and 2 * joined >= max_c) or (joined > max_c and 2 * lasted >= max_s)
                if hard or soft:
                    pieces.append(current)
                    current = []
            current = [*current, w]
        pieces.append(current)
        for p in pieces:
            text = "".join(x[4] for x in p).strip()
            if text:
                found.append((p[0][2], max(p[0][2], max(x[3] for x in p)), speaker, text, p[0][1], p[-1][1]))
    found.sort(key=lambda c: (c[0], c[1], c[2] or "", c[4]))
    return [(f"preview-{i}", *c) for i, c in enumerate(found, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_segment_words(spark, either, seed):
    rows = random_words(seed)
    got = W.segment_words(spark.createDataFrame(rows, WORD), 2.0, 16)
    got = sorted(
        (r.media_id, r.id, r.start, r.end, r.speaker or "", r.source, r.first_word, r.last_word) for r in got.collect()
    )
    want = sorted(
        (m, c[0], c[1], c[2], c[3] or "", *c[4:]) for m, ws in by_media(rows).items() for c in segmented(ws, 2.0, 16)
    )
    assert got == want


def repaired(words, limit):
    ws = [list(w) for w in words]
    if len({w[5] for w in ws}) < 2:
        return ws
    samples = {}
    for w in ws:
        if w[3] - w[2] >= 0.05:
            samples.setdefault(w[5], []).append((w[3] - w[2]) / max(1, width(w[4].strip())))
    everything = [x for xs in samples.values() for x in xs]
    overall = median(everything) if len(everything) >= 3 else 0.06
    for i in range(len(ws) - 1):
        speaker = ws[i][5]
        if speaker is None or ws[i + 1][5] == speaker:
            continue
        own = [j for j in range(i + 1) if ws[j][5] == speaker]
        run = []
        while own and ws[own[-1]][3] - ws[own[-1]][2] < 0.05:
            run.insert(0, own.pop())
        if not run:
            continue
        mine = samples.get(speaker, [])
        rate = median(mine) if len(mine) >= 3 else overall
        weights = [max(1, width(ws[j][4].strip())) for j in run]
        begin = ws[run[0]][2]
        stop = min(begin + sum(weights) * rate, begin + 5.0, limit)
        later = [w[2] for w in ws[i + 1 :] if w[5] == speaker]
        if later:
            stop = min(stop, later[0])
        if stop <= max(begin, ws[run[-1]][3]):
            continue
        done = 0
        for j, wt in zip(run, weights):
            ws[j][2] = begin + (stop - begin) * done / sum(weights)
            done += wt
            ws[j][3] = begin + (stop - begin) * done / sum(weights)
    return ws


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_repair_squeezed(spark, either, seed):
    rows = random_words(seed)
    limits = {1: 70.0, 2: 9.0}
    durations = spark.createDataFrame(list(limits.items()), "media_id long, duration double")
    got = W.repair_squeezed(spark.createDataFrame(rows, WORD), durations)
    got = {(r.media_id, r.ordinal): (r.start, r.end) for r in got.collect()}
    moved = 0
    for m, ws in by_media(rows).items():
        for old, new in zip(ws, repaired(ws, limits[m])):
            assert got[m, old[1]] == pytest.approx((new[2], new[3]), abs=1e-9)
            moved += (old[2], old[3]) != (new[2], new[3])
    assert moved > 5


def sliced(words, target, hard):
    gaps, reach = {}, None
    for a, b in zip(words, words[1:]):
        reach = a[3] if reach is None else max(reach, a[3])
        if b[2] - reach >= 0.8:
            gaps[a[1]] = b[2] - reach
    out, at = [], 0
    while at < len(words):
        if len(words) - at <= hard:
            out.append((at, len(words) - 1, False))
            break
        near = [o for o in range(at + max(0, target // 2 - 1), at + target) if o in gaps]
        far = [o for o in range(at + target, at + hard - 1) if o in gaps]
        cut = max(near, key=lambda o: (gaps[o], -o)) if near else far[0] if far else None
        end = at + hard - 1 if cut is None else cut
        out.append((at, end, cut is None))
        at = end + 1
    return out


@pytest.mark.parametrize("seed,target,block", [(6, 8, 16), (7, 5, 65536), (8, 12, 24)])
def test_batch_words(spark, either, seed, target, block):
    rows = random_words(seed, 400)
    got = W.batch_words(spark.createDataFrame(rows, WORD), target, block=block)
    got = sorted((r.media_id, r.batch, r.first_ordinal, r.last_ordinal, r.forced_end) for r in got.collect())
    want = [(m, i, *b) for m, ws in sorted(by_media(rows).items()) for i, b in enumerate(sliced(ws, target, 2 * target))]
    assert got == want


@pytest.mark.parametrize("seed", [9, 10])
def test_merge_overlap_in_any_arrival_order(spark, either, seed):
    rng = random.Random(seed)
    texts = ["Hi  there", "hi THERE", "straße", "STRASSE", "no"]
    row = lambda: (1 + (rng.random() < 0.2), round(rng.uniform(0, 60), 1), rng.choice(texts))
    old = [(m, f"o{i}", s, s + 1, t, None) for i, (m, s, t) in enumerate(row() for _ in range(15))]
    new = [(m, i, s, s + 1, t, "S") for i, (m, s, t) in enumerate(row() for _ in range(120))]
    got = R.merge_overlap(
        spark.createDataFrame(old, "media_id long, id string, start double, end double, source string, speaker string"),
        spark.createDataFrame(new, "media_id long, seq long, start double, end double, source string, speaker string"),
    )
    got = sorted((r.media_id, r.id, r.start, r.source) for r in got.where("incoming").collect())
    want = []
    for m in (1, 2):
        kept = [(r[2], " ".join(r[4].casefold().split())) for r in old if r[0] == m]
        for r in (r for r in new if r[0] == m):
            key = " ".join(r[4].casefold().split())
            if not any(k == key and r[2] - 2.5 <= s <= r[2] + 2.5 for s, k in kept):
                kept.append((r[2], key))
                want.append((m, str(len(kept)), r[2], r[4]))
    assert got == sorted(want)


def merged(chunks, words):
    """Chunk merge by exhaustive matching, for one recording."""
    norm = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum())
    tracks, parent, fresh = [], {}, 0
    for k, (c0, c1) in enumerate(chunks):
        rows = [[s + c0, e + c0, t, sp] for s, e, t, sp in words[k]]
        pairs = []
        if k and c0 < chunks[k - 1][1]:
            hi = chunks[k - 1][1]
            touching = lambda w: w[1] >= c0 and w[0] <= hi and norm(w[2])
            near = {}
            for i, a in enumerate(tracks[-1]):
                for j, b in enumerate(rows):
                    if touching(a) and touching(b) and norm(a[2]) == norm(b[2]) and b[0] - 0.6 <= a[0] <= b[0] + 0.6 and abs(a[1] - b[1]) <= 0.6:
                        near[i, j] = abs(a[0] - b[0]) + abs(a[1] - b[1])

            def only(side, key):
                ds = sorted((d, p) for p, d in near.items() if p[side] == key)
                return None if len(ds) > 1 and abs(ds[0][0] - ds[1][0]) <= 1e-6 else ds[0][1]

            pairs = [p for p in near if only(0, p[0]) == p == only(1, p[1])]
        votes = {}
        for i, j in pairs:
            if rows[j][3] is not None and tracks[-1][i][3] is not None:
                votes[rows[j][3], tracks[-1][i][3]] = votes.get((rows[j][3], tracks[-1][i][3]), 0) + 1
        names = {}
        for w in rows:
            if w[3] is None or w[3] in names:
                continue
            mine = [g for loc, g in votes if loc == w[3]]
            if len(mine) == 1 and votes[w[3], mine[0]] >= 2 and sum(g == mine[0] for _, g in votes) == 1:
                names[w[3]] = mine[0]
            else:
                names[w[3]], fresh = str(fresh), fresh + 1
        for w in rows:
            w[3] = names.get(w[3])
        tracks.append(rows)
        for i, j in pairs:
            parent[k, j] = (k - 1, i)
    chains = {}
    for k, rows in enumerate(tracks):
        lo = (chunks[k - 1][1] + chunks[k][0]) / 2 if k else float("-inf")
        hi = (chunks[k][1] + chunks[k + 1][0]) / 2 if k + 1 < len(chunks) else float("inf")
        for j, w in enumerate(rows):
            top = (k, j)
            while top in parent:
                top = parent[top]
            chains.setdefault(top, []).append((lo <= (w[0] + w[1]) / 2 < hi, w))
    out = []
    for variants in chains.values():
        mine = [w for ok, w in variants if ok]
        if mine or len(variants) > 1:
            out.append((mine or [w for _, w in variants])[0])
    return sorted((round(w[0], 6), round(w[1], 6), w[2], w[3]) for w in out)


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_merge_chunks(spark, either, seed):
    rng = random.Random(seed)
    bounds = [(0, 1000), (600, 1600), (1200, 2200), (1800, 2500)]
    spoken = [(round(i * 0.35 + rng.random() * 0.1, 2), rng.choice(["a", "b", "The", "the", "…"]), rng.choice("XYZ")) for i in range(70)]
    words = []
    for k, (f0, f1) in enumerate(bounds):
        rows = [
            (round(s - f0 / 100 + rng.choice([0, 0.03, -0.02]), 3), t, f"{(ord(sp) + k) % 3}" if rng.random() < 0.95 else None)
            for s, t, sp in spoken if f0 / 100 <= s <= f1 / 100 and rng.random() < 0.95
        ]
        words.append([(s, round(s + 0.2, 3), t, sp) for s, t, sp in rows])
    plan = spark.createDataFrame(
        [(1, k, a, b, 100) for k, (a, b) in enumerate(bounds)] + [(2, 0, 0, 1000, 100)],
        "media_id long, chunk long, start_frame long, end_frame long, rate int",
    )
    flat = [(1, k, j, *w) for k, ws in enumerate(words) for j, w in enumerate(ws)]
    flat += [(2, 0, 0, 3.0, 3.5, "later", "q"), (2, 0, 1, 1.0, 1.5, "first", "q")]
    got = K.merge_chunks(plan, spark.createDataFrame(flat, "media_id long, chunk long, pos long, start double, end double, text string, speaker string")).collect()
    ones = sorted((round(r.start, 6), round(r.end, 6), r.text, r.speaker) for r in got if r.media_id == 1)
    key = lambda t: tuple(map(str, t))
    assert sorted(ones, key=key) == sorted(merged([(a / 100, b / 100) for a, b in bounds], words), key=key)
    assert sorted(r.ordinal for r in got if r.media_id == 1) == list(range(len(ones)))
    # A single chunk is only sorted; labels stay.
    assert [(r.ordinal, r.text, r.speaker) for r in sorted(got, key=lambda r: r.ordinal) if r.media_id == 2] == [(0, "first", "q"), (1, "later", "q")]


def test_validate_responses(spark):
    words = [(1, 0, i, float(i), i + 0.5, f"w{i} ", "A" if i < 6 or i == 8 else "B") for i in range(10)]
    words += [(1, b, 10 * b + i, 10.0 * b + i, 10 * b + i + 0.5, "x ", "A") for b in (1, 2, 3) for i in range(4)]
    items = [
        # Batch 0: good, claimed twice, the rejected claim leaves word 4 to the next one.
        (1, 0, 0, 0, 2, "s", "t"), (1, 0, 1, 2, 4, "s", "t"), (1, 0, 2, 3, 8, "s", "t"), (1, 0, 3, 6, 9, "s", "t"),
        (1, 0, 4, 5, 7, "s", "t"), (1, 0, 5, 7, 99, "s", "t"), (1, 0, 6, None, 3, "s", "t"),
        (1, 1, 0, 10, 13, "s", "t"),
        (1, 2, 0, 20, 22, "s", " "),
    ]
    accepted, errors, overruns = BT.validate_responses(
        spark.createDataFrame(items, "media_id long, batch long, pos long, first_word int, last_word int, source string, translated string"),
        spark.createDataFrame(words, "media_id long, batch long, ordinal int, start double, end double, text string, speaker string"),
    )
    assert [(r.batch, r.id, r.start, r.end) for r in accepted.collect()] == [(1, "w10-13", 10.0, 13.5)]
    said = {(r.batch, r.pos): r.message for r in errors.collect()}
    assert set(said) == {(0, 1), (0, 4), (0, 5), (0, 6), (2, 0), (2, None), (3, None)}
    assert "already covered" in said[0, 1] and "different speakers" in said[0, 4]
    assert "outside this batch" in said[0, 5] and "missing integer" in said[0, 6]
    assert "empty translation" in said[2, 0] and said[2, None].endswith("cue: 23") and "no cues" in said[3, None]
    assert overruns.count() == 0


def test_soft_limits_reject_unless_accepted(spark):
    words = [(1, 0, i, float(i), i + 0.9, "w ", None) for i in range(12)]
    items = [(1, 0, 0, 0, 11, "x" * 50, "y")]
    args = (
        spark.createDataFrame(items, "media_id long, batch long, pos long, first_word int, last_word int, source string, translated string"),
        spark.createDataFrame(words, "media_id long, batch long, ordinal int, start double, end double, text string, speaker string"),
    )
    accepted, errors, overruns = BT.validate_responses(*args)
    assert (accepted.count(), errors.count(), overruns.count()) == (0, 0, 1)
    assert BT.validate_responses(*args, accept_overruns=True)[0].count() == 1


def test_crosstalk_equals_pair_predicate(spark, either):
    rng = random.Random(14)
    rows = [(1, str(i), s := round(rng.uniform(0, 40), 1), round(s + rng.choice([0, 0.5, 2, 9]), 1), rng.choice(["A", "B", "C", None, ""])) for i in range(120)]
    got = {r.id for r in I.crosstalk(spark.createDataFrame(rows, "media_id long, id string, start double, end double, speaker string")).collect()}
    assert got == {
        a[1] for a in rows for b in rows
        if a[4] and b[4] and a[4] != b[4] and a[2] < b[3] and b[2] < a[3]
    }


def test_exact_median_and_quantile(spark, either):
    rng = random.Random(15)
    rows = [(m, rng.randint(0, 9) / 4) for m in (1, 2, 3) for _ in range(m * 11)]
    df = spark.createDataFrame(rows, "media_id long, v double")
    med = {r.media_id: (r.median, r.samples) for r in I.exact_median(df, ["media_id"], "v").collect()}
    cut = {r.media_id: r.quantile for r in I.index_quantile(df, "v", 0.2).collect()}
    for m in (1, 2, 3):
        vs = sorted(v for k, v in rows if k == m)
        assert med[m] == (median(vs), len(vs))
        assert cut[m] == vs[min(len(vs) - 1, int(len(vs) * 0.2))]
    assert df.where(F.lit(False)).count() == 0
