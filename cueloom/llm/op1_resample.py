"""Quality by importance resampling over hashed n-grams.

Two generative models count hashed unigrams and bigrams: one over clean documents (labelled
good and not toxic), one over all documents. A document's importance is the sum over its
n-grams of log(p_clean / p_raw). Adding Gumbel noise and keeping the k largest draws k
documents without replacement in proportion to importance. k is the number of documents
that score at or above the cut that best parts good from bad labelled documents; a toxic
document counts as bad, whatever its quality.

A few toxic words drown in the sum over a long document, so a second ratio tells toxic
documents: log(p_toxic / p_clean) of the labelled documents that hold an n-gram, where it
is at least ``MARKED``, summed over a document. Documents above the value that best parts
toxic from other labelled documents have their importance lowered under the cut, by more
than noise can lift.

The clean model and the cut use at most ``label_rows`` labelled documents (the least by
hash, a documented bound), one half for each, so the cut never judges what the model has
counted. Both counts are smoothed on the clean model's scale: an n-gram weighs only as
far as enough of it was expected. The raw model counts every n-gram of every document. Noise is
a function of id and text, so reruns agree and equal rows share their fate.

Defined results: null and empty texts score 0. Labels with a null id or quality are
ignored; a document labelled twice counts as good only if all its labels say so. Without
good or without bad labels nothing can be told apart and every document stays. Rows tied
with the k-th stay too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm import shingles
from cueloom.llm.store import stored

BUCKETS = 1 << 16
LABEL_ROWS = 20_000
SEED = 17
SMOOTHING = 5.0
BINS = 1024
TOXIC_SMOOTHING = 2.0
MARKED = 1.0
#: More than the largest Gumbel draw of a 52-bit unit.
BELOW = 64.0


def ngram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's unigrams and bigrams, and the text of each."""
    hashes, first = shingles.tokens(texts)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    joined = shingles.mix(hashes[pairs] * np.uint64(0x9E3779B97F4A7C15) + hashes[pairs + 1])
    both = np.concatenate([hashes, joined])
    return (both >> np.uint64(20)).astype(np.int64) & (buckets - 1), np.concatenate([owner, owner[pairs]])


def _counter(buckets: int):
    """One row of counts per task and bucket, whatever the number of documents.

    ``toxic_in`` and ``clean_in`` count labelled documents that hold an n-gram; the row
    after the last bucket counts all of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, clean, toxic_in, clean_in = (np.zeros(buckets + 1, np.int64) for _ in range(4))
        for batch in batches:
            good, toxic = (
                batch.column(c).fill_null(False).to_numpy(zero_copy_only=False) for c in ("good", "toxic")
            )
            clean_in[buckets] += good.sum()
            toxic_in[buckets] += toxic.sum()
            for begin, texts in shingles.chunks(batch.column("text")):
                slot, owner = ngram_buckets(texts, buckets)
                raw += np.bincount(slot, minlength=buckets + 1)
                clean += np.bincount(slot[good[begin + owner]], minlength=buckets + 1)
                for told, held in ((good, clean_in), (toxic, toxic_in)):
                    mine = told[begin + owner]
                    held += np.bincount(np.unique(owner[mine] * buckets + slot[mine]) % buckets, minlength=buckets + 1)
        used = np.flatnonzero(raw + clean_in + toxic_in)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(c[used]) for c in (raw, clean, toxic_in, clean_in))],
            ["bucket", "raw", "clean", "toxic_in", "clean_in"],
        )

    return count


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, good, bad, toxic, fit) of at most ``rows`` labelled documents."""
    told = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .select(
            "doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).alias("good"),
            ((F.col("q") == 0) | (F.col("t") == 1)).alias("bad"), (F.col("t") == 1).alias("toxic"),
        )
    )
    picked = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return picked.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)


@dataclass
class Model:
    log_ratio: np.ndarray
    cut: float | None
    toxic_ratio: np.ndarray
    toxic_cut: float | None = None

    def _sums(self, text: Column, use) -> Column:
        ratio, toxic = self.log_ratio, self.toxic_ratio

        def run(texts: pa.Array) -> pa.Array:
            out = np.zeros((2, len(texts)))
            for begin, part in shingles.chunks(texts):
                slot, owner = ngram_buckets(part, len(ratio))
                for k, weights in enumerate((ratio, toxic)):
                    out[k, begin : begin + len(part)] = np.bincount(owner, weights[slot], minlength=len(part))
            return pa.array(use(*out))

        return F.arrow_udf(run, "double")(F.coalesce(text, F.lit("")))

    def plain(self, text: Column) -> Column:
        """Importance before toxicity lowers it."""
        return self._sums(text, lambda score, toxicity: score)

    def toxicity(self, text: Column) -> Column:
        return self._sums(text, lambda score, toxicity: toxicity)

    def score(self, text: Column) -> Column:
        cut, most = self.cut, self.toxic_cut
        if cut is None or most is None:
            return self.plain(text)
        return self._sums(
            text, lambda score, toxicity: np.where(toxicity > most, np.minimum(score, cut - BELOW) - toxicity, score)
        )


def fit(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_rows: int = LABEL_ROWS
) -> Model:
    # At most ``label_rows`` rows, so they may be broadcast.
    sample = labelled_sample(labels, label_rows)
    # At most ``buckets`` rows reach the driver.
    counts = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")
        .select("text", (F.col("good") & F.col("fit")).alias("good"), (F.col("toxic") & F.col("fit")).alias("toxic"))
        .mapInArrow(_counter(buckets), "bucket long, raw long, clean long, toxic_in long, clean_in long")
        .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "clean", "toxic_in", "clean_in"))).toPandas()
    )
    table = np.zeros((4, buckets + 1))
    table[:, counts["bucket"]] = counts[["raw", "clean", "toxic_in", "clean_in"]].to_numpy().T
    (raw, clean, toxic_in, clean_in), (toxic_docs, clean_docs) = table[:, :buckets], table[2:, buckets]
    if not clean.any():
        return Model(np.zeros(buckets), None, np.zeros(buckets))
    usual = clean_in * (toxic_docs / clean_docs)
    toxic = np.log(toxic_in + TOXIC_SMOOTHING) - np.log(usual + TOXIC_SMOOTHING)
    expected = raw * (clean.sum() / raw.sum())
    model = Model(np.log(clean + SMOOTHING) - np.log(expected + SMOOTHING), None, np.where(toxic >= MARKED, toxic, 0.0))
    told = docs.select("doc_id", "text").join(
        F.broadcast(sample.where("(good or bad) and not fit")), "doc_id"
    )
    scored = told.select(
        "good", "toxic", model.plain(F.col("text")).alias("score"), model.toxicity(F.col("text")).alias("toxicity")
    )
    # A repeated id could make more rows of the bounded sample; the bound holds again here.
    rows = scored.limit(label_rows).toPandas()
    score, good = rows["score"].to_numpy(), rows["good"].to_numpy(bool)
    toxicity, toxic = rows["toxicity"].to_numpy(), rows["toxic"].to_numpy(bool)
    most = best_cut(-toxicity, ~toxic)
    told = toxicity > -most if most is not None else np.zeros(len(rows), bool)
    if told.any() and told[toxic].mean() > told[~toxic].mean():
        model.toxic_cut = -most
        score = np.where(told, score.min() - 1, score)
    model.cut = best_cut(score, good)
    return model


def best_cut(scores: np.ndarray, good: np.ndarray) -> float | None:
    """The score that parts good from bad with most of both right; None if one is absent."""
    if good.all() or not good.any():
        return None
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    right = np.cumsum(~g) / (~g).sum() - np.cumsum(g) / g.sum()
    last = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    best = last[np.argmax(right[last])]
    return float(s[best] if best == len(s) - 1 else (s[best] + s[best + 1]) / 2)


def gumbel(seed: int) -> Column:
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """A value that at least k rows reach and, but for ties, no more; by histograms.

    Each round counts the rows of ``BINS`` equal ranges, so the driver sees counts only.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while high > low:
        width = (high - low) / BINS
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        inside = keys.where(F.col(column).between(low, high))
        rows = inside.groupBy(slot.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most")
        ).collect()
        counts = {r["b"]: (r["n"], r["least"], r["most"]) for r in rows}
        for b in sorted(counts, reverse=True):
            n, least, most = counts[b]
            if above + n >= k:
                low, high = least, most
                break
            above += n
        if above + n == k:
            break
    return low


def resampled(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_rows: int = LABEL_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """The documents drawn, with ``__importance`` and ``__draw`` (importance plus noise)."""
    model = fit(docs, labels, buckets, label_rows)
    scored = docs.withColumn("__importance", model.score(F.col("text"))).withColumn(
        "__draw", F.col("__importance") + gumbel(seed)
    )
    if model.cut is None:
        return scored
    keys = stored(scored.select("__importance", "__draw"))
    k = keys.where(F.col("__importance") >= model.cut).count()
    if not k:
        return scored.where(F.lit(False))
    return scored.where(F.col("__draw") >= kth_largest(keys, "__draw", k))


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents drawn, with the columns they had."""
    kept = resampled(docs, labels, **parameters)
    return kept.select(*docs.columns)
