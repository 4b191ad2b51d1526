"""Spelling variants against brute force, and on awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from cueloom.llm import op12_variants

SCHEMA = "doc_id long, text string, word string, n long, run string, key long, root string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "r", 2, "q") for i, t in rows], SCHEMA)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    held = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    forms, number = {}, {}
    for w, n in held.items():
        others = [x for x in held if near(w, x)]
        number[w] = len(others)
        best = min(others, key=lambda x: (-held[x], x), default=None)
        forms[w] = best if best is not None and held[best] >= 10 * n else None
    out = []
    for w, n in held.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, number[w], held[forms[w]] if forms[w] else None))
    return sorted(out, key=repr)


def answer(df):
    return sorted((tuple(r) for r in op12_variants.variants(df).collect()), key=repr)


def test_signatures_miss_no_near_word():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(7, 14)))
        at, kind = rng.randrange(len(a) + 1), rng.randrange(2)
        b = a[:at] + rng.choice("abcdeéßz") + a[at + kind :]
        if near(a, b):
            assert set(op12_variants.signatures(a)) & set(op12_variants.signatures(b)), (a, b)


@pytest.mark.parametrize(("distance", "first", "second"), [(2, 2, 4), (1, 2, 1), (2, 1, 5), (3, 2, 3)])
def test_part_enum_finds_all_within_the_distance(distance, first, second):
    rng = random.Random(2)
    for _ in range(500):
        a = [rng.choice("abcdefgh") for _ in range(9)]
        b = list(a)
        for _ in range(distance // 2):
            b[rng.randrange(9)] = rng.choice("abcdefgh")
        if distance % 2:
            b.append("a")
        assert set(op12_variants.part_enum("".join(a), distance, first, second)) & set(
            op12_variants.part_enum("".join(b), distance, first, second))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(7, 11))) for _ in range(25)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(60):
            w = base[min(24, int(rng.expovariate(0.25)))]
            if rng.random() < 0.08:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice("abcdéÉ") + w[at + rng.randrange(2) :]
            text.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", "\n", ", ", "-"]).join(text)))
    got = answer(frame(spark, rows).repartition(3))
    assert got == brute(rows)
    assert sum(r[1] is not None for r in got) > 20


def test_chains_are_followed_to_the_last_form(spark):
    rows = [(1, "letters " * 2 + "lettera " * 25 + "lettaaa " * 2), (2, "lettaa lettaaa " * 1 + "letteraa " * 300)]
    rows += [(3, "letterab " * 4000)]
    assert answer(frame(spark, rows)) == brute(rows)
    assert {r.word: r.root for r in op12_variants.variants(frame(spark, rows)).collect()}["lettera"] == "letterab"


def test_awkward_rows(spark):
    long = "pneumonoultra" * 4000 + " " + "repeated " * 20000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "abcdefgh abcdefgh"), (None, "abcdefgh"), (4, long), (4, long),
            (5, "ABCDEFGH × ÷ ×ÀÉÎÕÜß÷ ÀÉÎÕÜSS Ωmega"), (5, "×ÀÉÎÕÜß÷")]
    assert answer(frame(spark, rows)) == brute(rows)
    assert answer(frame(spark, [])) == []
    with pytest.raises(ValueError):
        op12_variants.variants(frame(spark, rows), times=1)
