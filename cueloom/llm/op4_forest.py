"""Documents whose five-word shingles reach a Jaccard similarity, by a MinHash LSH forest.

Each text gets ``trees`` labels of up to ``max_depth`` minimum hashes. Rows that share a
label prefix share a trie node. The prefix is shortened from the full label until the
probability that two texts at the threshold meet in some tree reaches the target recall
(``prefix_depth``); the nodes of that depth are the candidates. Every candidate component
is then verified exactly, in blocks.

Defined results: null and empty texts, and texts without letters or digits, have no
shingles, stand alone and link to nothing. Texts equal after normalization are one
vertex: their rows link to each other without comparison. Rows that repeat a ``doc_id``
are rows like any other; null ids are compared as null. A class is a connected component;
its id is the least ``doc_id`` in it (null if all are null). Other columns are carried by
``keep_one`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm import graph, shingles
from cueloom.llm.store import stored

TREES = 32
MAX_DEPTH = 12
RECALL = 0.995
THRESHOLD = 0.8


def prefix_depth(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """The longest prefix with which the forest still reaches the recall at the threshold."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def _labeller(trees: int, depth: int):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in shingles.chunks(batch.column("content")):
                hashes, first = shingles.words(texts)[:2]
                values, at = shingles.shingles(hashes, first)
                full = np.flatnonzero(np.diff(at) > 0)
                sig = shingles.minhash(values, at[full], at[full + 1], trees * depth)
                keys = np.stack(
                    [shingles.combine(sig[:, t * depth : (t + 1) * depth], t) for t in range(trees)], 1
                )
                sizes = np.zeros(len(texts), np.int32)
                sizes[full] = trees
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                rows = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("digest"), shingles.content_ids(hashes, first),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                    ["doc_id", "digest", "vertex", "keys"],
                )

    return label


def _content(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")


def similar_documents(
    docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES,
    max_depth: int = MAX_DEPTH, recall: float = RECALL, block: int = graph.BLOCK,
) -> DataFrame:
    """One row per document: doc_id, digest, class, copy_id, class_id, links.

    ``digest`` is the text's MD5, ``class`` a key of the class, ``copy_id`` the least id
    among texts of the same words, ``class_id`` the least id of the class, ``links`` the
    number of other documents at or above the threshold.
    """
    depth = prefix_depth(trees, max_depth, threshold, recall)
    labelled = stored(
        _content(docs).select("doc_id", "digest", shingles.lowered(F.col("text")).alias("content"))
        .mapInArrow(
            _labeller(trees, depth), "doc_id long, digest binary, vertex binary, keys array<long>"
        )
    )
    # Equal texts become one vertex before anything is exploded.
    keyed = labelled.groupBy("vertex").agg(F.first("keys").alias("keys")).select(
        "vertex", F.explode("keys").alias("key")
    )
    candidates = graph.components(graph.star_edges(keyed))
    sizes = stored(candidates.groupBy("root").agg(F.count(F.lit(1)).alias("size")))

    vertices = labelled.groupBy("vertex").agg(
        F.min(F.struct("doc_id", "digest")).alias("first"), F.min("doc_id").alias("copy_id"),
        F.count(F.lit(1)).alias("copies"), (F.max(F.size("keys")) == 0).alias("alone"),
    )
    chosen = vertices.join(candidates, "vertex").select(
        "vertex", "root", "copies", F.col("first.doc_id").alias("__id"),
        F.col("first.digest").alias("__digest"),
    )
    # One text per vertex. The id is in the key, so copies of one text spread.
    texts = _content(docs)
    same = texts["doc_id"].eqNullSafe(chosen["__id"]) & texts["digest"].eqNullSafe(chosen["__digest"])
    members = (
        texts.join(chosen, same)
        .select("vertex", "root", "copies", shingles.lowered(F.col("text")).alias("content"))
        .dropDuplicates(["vertex"])
    )
    verified = stored(
        graph.in_blocks(members, sizes, block).applyInArrow(
            graph.verifier(shingles.shingle_sets, threshold, pa.binary()),
            "vertex binary, links long, near binary",
        )
    )
    links = verified.groupBy("vertex").agg(F.sum("links").alias("links"))
    classes = graph.components(
        verified.where("vertex <> near").select(F.col("vertex").alias("hi"), F.col("near").alias("lo"))
    )
    named = (
        vertices.drop("first").join(links, "vertex", "left").join(classes, "vertex", "left")
        .withColumn("class", F.coalesce("root", "vertex")).drop("root")
    )
    least = named.groupBy("class").agg(F.min("copy_id").alias("class_id"))
    named = named.join(least, "class").withColumn(
        "links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    )
    rows = labelled.select("doc_id", "digest", "vertex").join(named.drop("copies"), "vertex")
    alone = F.col("alone")
    return rows.select(
        "doc_id", "digest", "class", "alone",
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("links"),
    )


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """Documents without all but one of each class, columns unchanged.

    The row with the least ``doc_id`` stays; of rows that also share that id, one with
    the least MD5. Texts without words are no copies of each other: all stay.
    """
    found = similar_documents(docs, **parameters)
    one = (
        found.where(~F.col("alone")).groupBy("class")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("s"))
        .select(F.col("s.doc_id").alias("__id"), F.col("s.digest").alias("__digest"), F.lit(True).alias("__one"))
    )
    all_blank = found.where("alone").select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.lit(False).alias("__one")
    ).distinct()
    stays = one.unionByName(all_blank)
    marked = docs.withColumn("__at", F.unhex(F.md5("text")))
    match = marked["doc_id"].eqNullSafe(stays["__id"]) & marked["__at"].eqNullSafe(stays["__digest"])
    once = Window.partitionBy("doc_id", "__at", "__one").orderBy("__one")
    return (
        marked.join(stays, match).withColumn("__n", F.row_number().over(once))
        .where("__n = 1 or not __one").select(*docs.columns)
    )
