"""Benchmark items inside documents, by size-partitioned MinHash containment search.

A short item has a tiny Jaccard similarity to a long document, so both sides are
partitioned by size. Items fall into size classes (powers of two). For a class of items
of up to U shingles a document is cut into windows of 2U shingles at every U, so a passage
of an item's length lies whole in one window, and the containment threshold turns into a
Jaccard threshold of that partition (``jaccard_bound``), for which the number of
permutations is chosen. A window that agrees with an item in one minimum is a candidate;
the exact share of the item's shingles found in the whole document decides.

Documents are never shuffled: the items are the small side. They are searched in blocks
of ``block_items``, so what a task holds is bounded whatever the benchmark's size.

Defined results: null and empty items match nothing, null and empty documents hold
nothing. Items of fewer than five words are searched as exact phrases. Items that repeat
an id or a text are searched each; documents that repeat are reported each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm import shingles

THRESHOLD = 0.8
RECALL = 0.9999
BLOCK_ITEMS = 20_000
SMALLEST = 8
FILTER_BITS = 22


def jaccard_bound(threshold: float) -> float:
    """Least Jaccard similarity of a contained item and its window, over a size class.

    The item has more than U/2 shingles, the window at most 2U, the union at most 2U and
    the part of the item that is missing.
    """
    return threshold * 0.5 / (2 + (1 - threshold) * 0.5)


def permutations_for(threshold: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard_bound(threshold)))


@dataclass
class Items:
    """A block of items with its lookup tables, one per size class."""

    ids: list
    sets: list[np.ndarray]
    perms: int
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    phrases: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    @classmethod
    def build(cls, ids: list, texts: list[str | None], perms: int) -> Items:
        hashes, first = shingles.words(pa.array(texts, pa.string()))[:2]
        values, at = shingles.shingles(hashes, first)
        counts = np.diff(first)
        sets = [np.unique(values[at[i] : at[i + 1]]) for i in range(len(ids))]
        out = cls(ids, sets, perms)
        sizes = np.diff(at)
        for n in sorted(set(counts[(counts > 0) & (counts < shingles.WORDS)].tolist())):
            grams, where = shingles.shingles(hashes, first, n)
            table = out.phrases.setdefault(n, {})
            for i in np.flatnonzero(counts == n):
                table.setdefault(int(grams[where[i]]), []).append(int(i))
        long = np.flatnonzero(counts >= shingles.WORDS)
        upper = np.maximum(SMALLEST, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
        for u in np.unique(upper[long]):
            own = long[upper[long] == u]
            sig = shingles.minhash(values, at[own], at[own + 1], perms)
            keys = _slot_keys(sig).ravel()
            order = np.argsort(keys, kind="stable")
            out.classes[int(u)] = (keys[order], np.repeat(own, perms)[order], _bits(keys))
        return out


def _slot_keys(sig: np.ndarray) -> np.ndarray:
    return sig.astype(np.uint64) | (np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32))


def _bit_of(keys: np.ndarray) -> np.ndarray:
    return shingles.mix(keys) >> np.uint64(64 - FILTER_BITS)


def _bits(keys: np.ndarray) -> np.ndarray:
    """A bitmap that lets all keys and few others pass."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[_bit_of(keys)] = True
    return bits


def _windows(sig: np.ndarray, blocks: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Minima over windows of 2 * factor blocks at every factor blocks, and their texts."""
    starts, ends, owner = [], [], []
    firsts = np.concatenate([[0], np.cumsum(blocks)])
    for t in np.flatnonzero(blocks):
        s = np.arange(firsts[t], firsts[t + 1], factor)
        starts.append(s)
        ends.append(np.minimum(s + 2 * factor, firsts[t + 1]))
        owner.append(np.full(len(s), t))
    s, e = np.concatenate(starts), np.concatenate(ends)
    padded = np.concatenate([sig, np.full((1, sig.shape[1]), 0xFFFFFFFF, np.uint32)])
    return np.minimum.reduceat(padded, np.stack([s, e], 1).ravel(), axis=0)[::2], np.concatenate(owner)


def find(texts: pa.Array, items: Items, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(row, item, containment) of every contained item, in order."""
    for begin, part in shingles.chunks(texts):
        hashes, first = shingles.words(part)[:2]
        values, at = shingles.shingles(hashes, first)
        found: set[tuple[int, int]] = set()
        if items.classes and len(values):
            base = min(items.classes)
            sizes = np.diff(at)
            blocks = -(-sizes // base)
            step = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = np.repeat(at[:-1], blocks) + step * base
            ends = np.minimum(starts + base, np.repeat(at[1:], blocks))
            sig = shingles.minhash(values, starts, ends, items.perms)
            for u, (keys, owners, bits) in items.classes.items():
                minima, text_of = _windows(sig, blocks, u // base)
                slots = _slot_keys(minima)
                w, j = np.nonzero(bits[_bit_of(slots)])
                lo = np.searchsorted(keys, slots[w, j], "left")
                hi = np.searchsorted(keys, slots[w, j], "right")
                for k in np.flatnonzero(hi > lo):
                    t = int(text_of[w[k]])
                    found.update((t, int(o)) for o in owners[lo[k] : hi[k]])
        held: dict[int, np.ndarray] = {}
        for t, i in sorted(found):
            if t not in held:
                held = {t: np.unique(values[at[t] : at[t + 1]])}
            share = float(np.isin(items.sets[i], held[t], assume_unique=True).mean())
            if share >= threshold - 1e-12:
                yield begin + t, i, share
        for n, table in items.phrases.items():
            grams, where = shingles.shingles(hashes, first, n)
            enough = np.repeat(np.diff(first) >= n, np.diff(where))
            hit = np.flatnonzero(np.isin(grams, np.array(list(table), np.uint64)) & enough)
            text_of = np.searchsorted(where, hit, "right") - 1
            for t, i in sorted({(int(t), i) for t, g in zip(text_of, hit) for i in table[int(grams[g])]}):
                yield begin + t, i, 1.0


def _blocks(items: DataFrame, recall: float, threshold: float, block_items: int) -> Iterator[Items]:
    """Item blocks of bounded size, one in the driver at a time."""
    n = items.count()
    parts = max(1, -(-n // block_items))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    perms = permutations_for(threshold, recall)
    for p in range(parts):
        rows = items.where(part == p).select("item_id", shingles.lowered(F.col("text")).alias("t")).collect()
        yield Items.build([r["item_id"] for r in rows], [r["t"] for r in rows], perms)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
    recall: float = RECALL, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, containment) of each item found in a document."""

    def search(block: Items) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(find(batch.column("content"), block, threshold))
                rows = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows),
                     pa.array([block.ids[h[1]] for h in hits], pa.int64()),
                     pa.array([h[2] for h in hits], pa.float64())],
                    ["doc_id", "item_id", "containment"],
                )

        return run

    content = docs.select("doc_id", shingles.lowered(F.col("text")).alias("content"))
    schema = "doc_id long, item_id long, containment double"
    return _union([
        content.mapInArrow(search(b), schema) for b in _blocks(items, recall, threshold, block_items)
    ])


def without_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
    recall: float = RECALL, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The documents that hold no item, columns unchanged, without a shuffle."""
    def free_of(block: Items) -> Callable:
        def clean(content: pa.Array) -> pa.Array:
            keep = np.ones(len(content), bool)
            keep[[h[0] for h in find(content, block, threshold)]] = False
            return pa.array(keep)

        return F.arrow_udf(clean, "boolean")

    for block in _blocks(items, recall, threshold, block_items):
        docs = docs.where(free_of(block)(shingles.lowered(F.col("text"))))
    return docs
