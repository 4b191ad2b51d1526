"""Token alignment of two tokenizers by interval coalescing over bytes.

Both tokenizers read the same text, so every token is an interval of the same bytes. The
tokens of both are sorted together by start (``numpy.lexsort``), the running maximum of
their ends is accumulated, and a group breaks where a start reaches that maximum: a place
where both tokenizers end a token. Inside a group every A token is paired with each B token
it overlaps; a pair whose intervals end together is a link.

Counts of linked id pairs are corpus-wide. Of two tokens that end together one is a suffix
of the other, so only pairs of ids related in that way can occur: their number depends on
the two vocabularies alone (about a byte length per token, however large the corpus).
Pairs are numbered by that list, tasks count into an array of that length, the sums are
exchanged, and the totals go back to the tasks; no row of the corpus is exchanged.

A is a byte-level BPE file of the ``tokenizers`` library, read with a space before the text;
B is a SentencePiece model, which adds that space itself. Where A's file is plain
byte-level BPE with merges in order of ids, its vocabulary runs on the faster ``tiktoken``
with the file's own pre-splitting pattern, with equal ids; texts with very long runs of
white space, which that library can't split, and other files run on ``tokenizers``.

Defined results: a null or empty text, and one whose tokens do not spell it byte for byte
(say, one that holds the character a piece writes for a space), has no tokens: zeros and
empty lists. Every row is aligned, whether or not it repeats another or its ``doc_id`` is
null. Long texts are tokenized whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.store import stored

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_CHARS = 1 << 19
# Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"\s{2048}")


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabulary(NamedTuple):
    """Token bytes by id; None for ids that no text is split into."""

    tokens: list[bytes | None]

    def lengths(self) -> np.ndarray:
        return np.array([len(t or b"") for t in self.tokens], np.int64)


class ByteBpe:
    """Tokenizer A."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        special = {t["content"] for t in file.get("added_tokens", [])}
        tokens: list[bytes | None] = [None] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            if text not in special:
                tokens[i] = bytes(letters[c] for c in text)
        self.vocabulary = Vocabulary(tokens)
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
        split = file.get("pre_tokenizer") or {}
        usual = (
            file.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space") and merged == sorted(merged) and not file["model"].get("ignore_merges")
        )
        self.fast = None
        if usual:
            import tiktoken

            ranks = {t: i for i, t in enumerate(tokens) if t is not None}
            self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return [self.slow([t])[0] if LONG_SPACE.search(t) else self.fast.encode_ordinary(" " + t) for t in texts]
        return self.slow(texts)

    def slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens: list[bytes | None] = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                tokens.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                tokens.append(None)
            else:
                tokens.append(piece.replace("▁", " ").encode())
        self.vocabulary = Vocabulary(tokens)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def linkable(a: Vocabulary, b: Vocabulary) -> np.ndarray:
    """Sorted codes (A id * size of B + B id) of all id pairs whose tokens can end together."""
    by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
    for held, vocabulary in zip(by_bytes, (a, b)):
        for i, token in enumerate(vocabulary.tokens):
            if token:
                held.setdefault(token, []).append(i)
    codes, size = set(), len(b.tokens)
    for token, ids in by_bytes[0].items():
        for cut in range(len(token)):
            codes.update(i * size + j for j in by_bytes[1].get(token[cut:], ()) for i in ids)
    for token, ids in by_bytes[1].items():
        for cut in range(len(token)):
            codes.update(i * size + j for i in by_bytes[0].get(token[cut:], ()) for j in ids)
    return np.array(sorted(codes), np.int64)


@lru_cache(maxsize=4)
def tokenizers_of(a_path: str, b_path: str) -> tuple[ByteBpe, Pieces, np.ndarray]:
    """Both tokenizers and their linkable pairs, once per worker."""
    a, b = ByteBpe(a_path), Pieces(b_path)
    return a, b, linkable(a.vocabulary, b.vocabulary)


class Aligned(NamedTuple):
    """Tokens of several texts in one row of bytes, and what belongs together.

    ``a_group``/``b_group``: group of each token. ``pair_a``, ``pair_b``: places of
    overlapping tokens in order. ``ends``: whether a pair ends together.
    """

    a_group: np.ndarray
    b_group: np.ndarray
    pair_a: np.ndarray
    pair_b: np.ndarray
    ends: np.ndarray


def coalesce(a_end: np.ndarray, b_end: np.ndarray) -> Aligned:
    """Groups and overlapping pairs of two divisions of the same bytes, given their ends."""
    n = len(a_end)
    end = np.concatenate([a_end, b_end])
    start = np.concatenate([np.concatenate([[0], e])[:-1] for e in (a_end, b_end)])
    side = np.repeat([0, 1], [n, len(b_end)])
    order = np.lexsort((side, start))
    start, side = start[order], side[order]
    reach = np.maximum.accumulate(end[order])
    new = np.ones(len(order), bool)
    new[1:] = start[1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    # After each start, the last A and the last B token begun are the two that overlap there.
    final = np.ones(len(order), bool)
    final[:-1] = start[1:] != start[:-1]
    pair_a, pair_b = np.cumsum(side == 0)[final] - 1, np.cumsum(side == 1)[final] - 1
    return Aligned(group[:n], group[n:], pair_a, pair_b, a_end[pair_a] == b_end[pair_b])


class Chunk(NamedTuple):
    """Some rows, the flat ids of their tokens, tokens per text, and their alignment."""

    rows: pa.RecordBatch
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_size: np.ndarray
    b_size: np.ndarray
    found: Aligned

    def texts(self, side: str) -> np.ndarray:
        """The text each token belongs to."""
        size = getattr(self, f"{side}_size")
        return np.repeat(np.arange(len(size)), size)


def _spelled(tokens: list[bytes | None], ids: list[int], text: bytes) -> bool:
    parts = [tokens[i] for i in ids]
    return None not in parts and b"".join(parts) == text  # type: ignore[arg-type]


def _aligned_chunks(batches: Iterator[pa.RecordBatch], a: ByteBpe, b: Pieces, chunk: int) -> Iterator[Chunk]:
    a_length, b_length = a.vocabulary.lengths(), b.vocabulary.lengths()
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy())
        begin = 0
        while begin < len(batch):
            before = sizes[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(sizes, before + chunk, "right")))
            rows = batch.slice(begin, stop - begin)
            begin = stop
            texts = [t or "" for t in rows.column("text").to_pylist()]
            ids = a.encode(texts), b.encode(texts)
            for i, text in enumerate(texts):
                whole = (" " + text).encode()
                if not text or not all(_spelled(t.vocabulary.tokens, x[i], whole) for t, x in zip((a, b), ids)):
                    ids[0][i], ids[1][i] = [], []
            size = [np.array([len(x) for x in own], np.int64) for own in ids]
            flat = [np.fromiter(chain.from_iterable(own), np.int64, n.sum()) for own, n in zip(ids, size)]
            found = coalesce(np.cumsum(a_length[flat[0]]), np.cumsum(b_length[flat[1]]))
            yield Chunk(rows, flat[0], flat[1], size[0], size[1], found)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _whole(chunk: Chunk) -> pa.RecordBatch:
    """Everything about the alignment, places and groups counted from each text's first."""
    a_text, b_text = chunk.texts("a"), chunk.texts("b")
    a_first, b_first = np.cumsum(chunk.a_size) - chunk.a_size, np.cumsum(chunk.b_size) - chunk.b_size
    group = np.zeros(len(chunk.a_size), np.int64)
    some = np.flatnonzero(chunk.a_size)
    group[some] = chunk.found.a_group[a_first[some]]
    pair_text = a_text[chunk.found.pair_a]
    pairs = np.bincount(pair_text, minlength=len(chunk.a_size))
    return pa.RecordBatch.from_arrays(
        [chunk.rows.column("doc_id").cast(pa.int64()), *(_lists(values.astype(np.int32), sizes) for values, sizes in (
            (chunk.a_ids, chunk.a_size), (chunk.b_ids, chunk.b_size),
            (chunk.found.a_group - group[a_text], chunk.a_size), (chunk.found.b_group - group[b_text], chunk.b_size),
            (chunk.found.pair_a - a_first[pair_text], pairs), (chunk.found.pair_b - b_first[pair_text], pairs),
        )), _lists(chunk.found.ends, pairs)],
        ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups", "pair_a", "pair_b", "ends"],
    )


def aligned(
    docs: DataFrame, a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}", chunk: int = CHUNK_CHARS
) -> DataFrame:
    """Per document its tokens of both kinds, their groups, and the overlapping pairs.

    ``a_groups``/``b_groups`` number each token's group from 0. ``pair_a``/``pair_b`` are
    places in ``a_ids``/``b_ids``; ``ends`` tells which pairs end together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _ = tokenizers_of(a_path, b_path)
        yield from map(_whole, _aligned_chunks(batches, a, b, chunk))

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, "
        "pair_a array<int>, pair_b array<int>, ends array<boolean>")


@lru_cache(maxsize=None)
def _written(bits: int) -> np.ndarray:
    """Ids below 2 ** ``bits`` with what may follow them: comma, bar, semicolon, nothing."""
    return np.array([[f"{i}{mark}" for i in range(1 << bits)] for mark in (",", "|", ";", "")], object)


def _digests(chunk: Chunk) -> list[str]:
    """SHA-256 of each text's groups, written as A ids, a bar, B ids, parted by semicolons."""
    group = np.concatenate([chunk.found.a_group, chunk.found.b_group])
    side = np.repeat([0, 1], [len(chunk.a_ids), len(chunk.b_ids)])
    text = np.concatenate([chunk.texts("a"), chunk.texts("b")])
    order = np.lexsort((side, group))
    group, side, text = group[order], side[order], text[order]
    mark = np.zeros(len(order), np.int64)
    mark[:-1] = np.where(text[1:] != text[:-1], 3, np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1]))
    mark[-1:] = 3
    ids = np.concatenate([chunk.a_ids, chunk.b_ids])[order]
    parts = _written(int(ids.max(initial=0)).bit_length())[mark, ids]
    cuts = np.searchsorted(text, np.arange(len(chunk.a_size) + 1))
    return [
        hashlib.sha256("".join(parts[i:j].tolist()).encode()).hexdigest() if j > i else ""
        for i, j in zip(cuts[:-1], cuts[1:])
    ]


def agreement(
    docs: DataFrame, a_path: str = f"{FOLDER}/{A_FILE}", b_path: str = f"{FOLDER}/{B_FILE}", chunk: int = CHUNK_CHARS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    A link's count is that of its id pair among all links of all documents; ``n_best`` are
    the links whose count no other pair of the same B id exceeds.
    """
    codes = tokenizers_of(a_path, b_path)[2]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, pairs = tokenizers_of(a_path, b_path)
        for part in _aligned_chunks(batches, a, b, chunk):
            found, n = part.found, len(part.a_size)
            at = found.pair_a[found.ends]
            code = part.a_ids[at] * len(b.vocabulary.tokens) + part.b_ids[found.pair_b[found.ends]]
            links = np.bincount(part.texts("a")[at], minlength=n)
            first = np.ones(len(part.a_ids), bool)
            first[1:] = part.found.a_group[1:] != part.found.a_group[:-1]
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id").cast(pa.int64()), pa.array(part.a_size), pa.array(part.b_size),
                 pa.array(np.bincount(part.texts("a")[first], minlength=n)), pa.array(_digests(part), pa.string()),
                 _lists(np.searchsorted(pairs, code).astype(np.int32), links)],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(codes), np.int64)
        for batch in batches:
            total += np.bincount(batch.column("links").flatten().to_numpy(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])

    linked = stored(docs.select("doc_id", "text").mapInArrow(
        link, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"))
    # Bounded by the two vocabularies: at most one row per linkable pair.
    summed = linked.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(len(codes), np.int64)
    totals[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    second = codes % len(tokenizers_of(a_path, b_path)[1].vocabulary.tokens)
    most = np.zeros(second.max(initial=0) + 1, np.int64)
    np.maximum.at(most, second, totals)
    shared = docs.sparkSession.sparkContext.broadcast((totals, totals == most[second]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            links = batch.column("links")
            flat, at = links.flatten().to_numpy(), links.offsets.to_numpy() - links.offsets[0].as_py()
            sums = [np.concatenate([[0], np.cumsum(x[flat])]) for x in (best, counts)]
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.diff(at), pa.int64()), *(pa.array(x[at[1:]] - x[at[:-1]], pa.int64()) for x in sums),
                 batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return linked.mapInArrow(
        judge, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
