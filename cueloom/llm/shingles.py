"""Words and five-word shingles of Arrow text batches, as arrays of hashes.

Texts come lower-cased from the JVM (``lowered``); everything else is done with array
operations over the bytes of many texts at once, so no Python loop sees a word. A word is
a run of ASCII letters and digits and of characters beyond ASCII; ASCII punctuation and
control characters, and the Latin-1, general and CJK punctuation blocks part words. Null
and empty texts have no words. A text of one to four words has one shingle, made of all
its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 5
CHUNK_BYTES = 1 << 19
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        size = max(n, CHUNK_BYTES + (1 << 16))
        both = []
        for base in (_PRIME, inverse):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _powers = (both[0], both[1])
    return _powers[0][:n], _powers[1][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins and the last one ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about ``size`` bytes, so that work arrays stay small."""
    _, at = text_bytes(texts)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(at, at[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield begin, texts.slice(begin, end - begin)
        begin = end


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _inside(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    inside = _WORD_BYTE[data]
    lead = np.flatnonzero((data[:-1] == 0xC2) | (data[:-1] == 0xE2) | (data[:-1] == 0xE3))
    first, second = data[lead], data[lead + 1]
    # U+00A0..U+00BF, U+2000..U+207F and U+3000..U+303F
    latin = lead[(first == 0xC2) & (second >= 0xA0)]
    wide = lead[((first == 0xE2) & (second <= 0x81)) | ((first == 0xE3) & (second == 0x80))]
    inside[latin] = inside[latin + 1] = False
    inside[wide] = inside[wide + 1] = False
    inside[np.minimum(wide + 2, len(data) - 1)] = False
    return inside


def _hash_runs(data: np.ndarray, at: np.ndarray, kind: np.ndarray):
    """Hash the runs of equal non-zero ``kind``; a run never leaves its text."""
    new = np.empty(len(data) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:-1])
    new[at] = True
    starts = np.flatnonzero(new[:-1] & (kind > 0))
    ends = np.flatnonzero(new[1:] & (kind > 0)) + 1
    power, inverse = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, at), starts, ends


_NO_RUNS = np.empty(0, np.int64)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of each text (and the end), and byte spans."""
    data, at = text_bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64), _NO_RUNS, _NO_RUNS
    return _hash_runs(data, at, _inside(data).view(np.uint8))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of runs of other visible characters, and each text's first."""
    data, at = text_bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    kind = np.where(_inside(data), np.uint8(1), np.where(data > 0x20, np.uint8(2), np.uint8(0)))
    return _hash_runs(data, at, kind)[:2]


def content_ids(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    """A 16-byte id of each text's word sequence; texts of the same words share it."""
    counts = np.diff(first)
    position = (np.arange(len(hashes)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    ids = np.zeros((len(counts), 2), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        for k, factor in enumerate((0x9FB21C651E98DF25, 0xD1342543DE82EF95)):
            placed = mix(hashes + (position + np.uint64(1)) * np.uint64(factor))
            ids[full, k] = mix(np.add.reduceat(placed, first[full]) + np.uint64(k))
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(16), len(ids), [None, pa.py_buffer(ids.tobytes())]
    ).cast(pa.binary())


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in word order, and the first one of each text (and the end)."""
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    if not at[-1]:
        return np.empty(0, np.uint64), at
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        rolled += padded[k : k + len(hashes)] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    position = np.arange(at[-1]) - np.repeat(at[:-1], sizes) + np.repeat(first[:-1], sizes)
    out = rolled[position]
    for i in np.flatnonzero((counts > 0) & (counts < n)):  # the few very short texts
        part = hashes[first[i] : first[i + 1]]
        factors = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(len(part))]
        out[at[i]] = (part * np.array(factors, np.uint64)).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out), at


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    out: list[np.ndarray] = []
    for _, part in chunks(texts):
        values, at = shingles(*words(part)[:2])
        out += [np.unique(values[at[i] : at[i + 1]]) for i in range(len(part))]
    return out


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def minhash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Least value of each of ``n`` permutations over the ranges [start, end), none empty."""
    sig = np.empty((len(starts), n), np.uint32)
    if not len(starts):
        return sig
    folded = (values >> np.uint64(32)).astype(np.uint32)
    joined = len(starts) == 1 or bool(np.all(starts[1:] == ends[:-1]))
    if joined:
        folded, cuts = folded[starts[0] : ends[-1]], starts - starts[0]
    else:
        folded = np.concatenate([folded, [np.uint32(0xFFFFFFFF)]])
        cuts = np.stack([starts, ends], 1).ravel()
    work = np.empty_like(folded)
    for j, (a, b) in enumerate(zip(*permutations(n, seed))):
        np.multiply(folded, a, out=work)
        np.add(work, b, out=work)
        least = np.minimum.reduceat(work, cuts)
        sig[:, j] = least if joined else least[::2]
    return sig


def combine(columns: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key of several signature columns."""
    key = np.full(len(columns), np.uint64(salt * 2 + 1), np.uint64)
    for j in range(columns.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + columns[:, j].astype(np.uint64))
    return key.view(np.int64)
