"""Token alignment against a loop over tokens, and on awkward rows."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest

from cueloom.llm import op11_alignment as O

A, B = f"{O.FOLDER}/{O.A_FILE}", f"{O.FOLDER}/{O.B_FILE}"
SCHEMA = "doc_id long, text string, links int, n_a string, pair int, rows string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], SCHEMA)


def tokens_of(text):
    """Ids and bytes of both tokenizers, straight from the libraries; None if they do not spell the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = O.byte_letters()
    names = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    a = whole.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    a_bytes = [bytes(letters[c] for c in names[i]) for i in a]
    b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    want = (" " + text).encode()
    return None if b"".join(a_bytes) != want or b"".join(b_bytes) != want else (a, b, a_bytes, b_bytes)


def brute(rows):
    links_of, base = [], []
    for i, text in rows:
        found = tokens_of(text) if text else None
        if found is None:
            base.append((i, 0, 0, 0, ""))
            links_of.append([])
            continue
        a, b, a_bytes, b_bytes = found
        groups, links, x, y, xs, ys = [], [], 0, 0, [], []
        i_a = i_b = 0
        while i_a < len(a) or i_b < len(b):
            if x <= y and i_a < len(a):
                x += len(a_bytes[i_a])
                xs.append(a[i_a])
                i_a += 1
            else:
                y += len(b_bytes[i_b])
                ys.append(b[i_b])
                i_b += 1
            if x == y:
                groups.append((xs, ys))
                links.append((xs[-1], ys[-1]))
                xs, ys = [], []
        text = ";".join("|".join(",".join(map(str, part)) for part in g) for g in groups)
        base.append((i, len(a), len(b), len(groups), hashlib.sha256(text.encode()).hexdigest()))
        links_of.append(links)
    counts = Counter(x for links in links_of for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        ((i, n_a, n_b, n_g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha)
         for (i, n_a, n_b, n_g, sha), links in zip(base, links_of)), key=repr)


def answer(df, **parameters):
    return sorted((tuple(r) for r in O.agreement(df, **parameters).collect()), key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["the", "Überraschung", "naïve", "123,456", "don't", " ", "  ", "\n", "\t", "東京", "😀", "x" * 30, "État", "a1b2", "-", "…"]
    return ["".join(rng.choice(bits) + rng.choice([" ", "", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_equals_a_loop_over_tokens(spark):
    rows = list(enumerate(texts(1, 60)))
    want = brute(rows)
    assert answer(frame(spark, rows).repartition(3), chunk=500) == want
    assert answer(frame(spark, rows).repartition(1)) == want


def test_awkward_rows(spark):
    long = " ".join(texts(2, 400))
    rows = [(1, None), (2, ""), (3, " "), (None, "the cat"), (None, "the cat"), (4, "the cat"), (5, "a▁b"), (6, "<|endoftext|> </s> <0x41>"),
            (7, "nul\0byte\r\n\x85 "), (8, " " * 5000 + "x"), (9, long), (9, long), (10, "é" * 3000)]
    got = answer(frame(spark, rows))
    assert got == brute(rows)
    assert [r[1:] for r in got if r[0] in (1, 2, 5)] == [(0, 0, 0, 0, 0, 0, "")] * 3
    assert answer(frame(spark, [])) == []
    assert answer(frame(spark, [(1, None)])) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_pairs_are_those_that_overlap(spark):
    for row in O.aligned(frame(spark, list(enumerate(texts(3, 25))))).collect():
        _, _, a_bytes, b_bytes = tokens_of(texts(3, 25)[row.doc_id])
        a_end, b_end = np.cumsum([len(t) for t in a_bytes]), np.cumsum([len(t) for t in b_bytes])
        a_start, b_start = a_end - [len(t) for t in a_bytes], b_end - [len(t) for t in b_bytes]
        want = [(i, j, bool(a_end[i] == b_end[j])) for i in range(len(a_end)) for j in range(len(b_end))
                if a_start[i] < b_end[j] and b_start[j] < a_end[i]]
        assert list(zip(row.pair_a, row.pair_b, row.ends)) == want
        assert [row.a_groups[i] for i, _, _ in want] == [row.b_groups[j] for _, j, _ in want]


def test_quick_and_slow_encoders_agree():
    a, b, pairs = O.tokenizers_of(A, B)
    assert a.fast is not None
    some = texts(4, 100) + [" " * 4000 + "end", "\n" * 3000]
    assert a.encode(some) == a.slow(some)
    held = set(pairs.tolist())
    for text in texts(5, 40):
        found = tokens_of(text)
        if found is not None:
            ends = [dict(zip(np.cumsum([len(t) for t in side]), ids)) for ids, side in zip(found[:2], found[2:])]
            assert all(ends[0][e] * len(b.vocabulary.tokens) + ends[1][e] in held for e in set(ends[0]) & set(ends[1]))


@pytest.mark.parametrize(("a", "b"), [([], []), ([3], [3]), ([1, 4, 6], [2, 4, 5, 6])])
def test_coalesce(a, b):
    found = O.coalesce(np.array(a, np.int64), np.array(b, np.int64))
    if len(a) == 3:
        assert found.a_group.tolist() == [0, 0, 1] and found.b_group.tolist() == [0, 0, 1, 1]
        assert list(zip(found.pair_a, found.pair_b, found.ends.tolist())) == [
            (0, 0, False), (1, 0, False), (1, 1, True), (2, 2, False), (2, 3, True)]
