"""Connected components and exact verification of candidate groups, without pairs.

Vertices are distinct contents. A candidate group names each member once, so edges are
linear in the members. Components of candidates are then verified exactly in blocks of
bounded size; a block returns counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from cueloom.llm.store import stored

BLOCK = 256
PACK = 64
COLUMNS = 4096


def star_edges(keyed: DataFrame) -> DataFrame:
    """(hi, lo): each vertex of a key with the key's least vertex.

    ``keyed`` has ``key`` and ``vertex``. Keys of one vertex vanish after a partial
    aggregate; no key's members are ever gathered in one place.
    """
    groups = (
        keyed.groupBy("key").agg(F.min("vertex").alias("lo"), F.max("vertex").alias("top"))
        .where("lo <> top").drop("top")
    )
    return (
        keyed.join(groups, "key").where("vertex <> lo")
        .select(F.col("vertex").alias("hi"), "lo").distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60, shed_after: int | None = None) -> DataFrame:
    """(vertex, root) of every vertex with an edge; root is the component's least vertex.

    ``edges`` holds (hi, lo) with hi > lo. A round links each vertex to its least
    neighbour's own link and the neighbours to each other, so path lengths halve. Each
    round is written to the shared folder: a lost executor costs a round's reread, not a replay.
    After ``shed_after`` rounds the components that are done, most of them, leave the rounds.
    """
    edges = stored(edges.select("hi", "lo"))
    done = None
    for k in range(max_rounds):
        least = edges.groupBy("hi").agg(F.min("lo").alias("r"))
        up = least.select(F.col("hi").alias("r"), F.col("r").alias("rr"))
        jumped = least.join(up, "r", "left").select(
            "hi", F.coalesce("rr", "r").alias("lo"), F.col("rr").isNotNull().cast("int").alias("moved")
        )
        sides = (
            edges.join(least, "hi").where("lo <> r")
            .select(F.greatest("lo", "r").alias("hi"), F.least("lo", "r").alias("lo"), F.lit(1).alias("moved"))
        )
        step = jumped.unionByName(sides).groupBy("hi", "lo").agg(F.max("moved").alias("moved"))
        step = stored(step)
        edges = step.drop("moved")
        if step.where("moved = 1").isEmpty():
            break
        if k + 1 == shed_after:
            # A star is done if no edge that moved touches its root or one of its leaves.
            moved, still = (step.where(F.col("moved") == m).select("hi", "lo") for m in (1, 0))
            touched = stored(moved.select(F.explode(F.array("hi", "lo")).alias("hi")).distinct())
            open_roots = stored(
                still.join(touched, "hi", "left_semi").select("lo").unionByName(touched.select(F.col("hi").alias("lo"))).distinct()
            )
            done = stored(still.join(open_roots, "lo", "left_anti"))
            edges = stored(still.join(open_roots, "lo", "left_semi").unionByName(moved))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if done is not None:
        edges = edges.unionByName(done)
    star = edges.select(F.col("hi").alias("vertex"), F.col("lo").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("vertex"), "root").distinct())


def in_blocks(members: DataFrame, sizes: DataFrame, block: int = BLOCK) -> GroupedData:
    """Members of each root grouped for ``verifier``, in tasks of bounded size.

    ``members`` has ``root``, ``vertex``, ``copies`` and ``content``; ``sizes`` has
    ``root`` and ``size``, its number of vertices. A root of k > 1 blocks of about ``block``
    vertices is dealt to block pairs (i, j), i <= j, so a vertex goes to k tasks. Roots of
    one block, almost all, are packed together: a pair found across roots is exact as well.
    """
    few = sizes.where(F.col("size") <= block).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    packs = max(1, -(-few // PACK))
    blocks = F.ceil(F.col("size") / block).cast("int")
    root = F.xxhash64("root")
    return (
        members.join(sizes, "root").withColumn("alone", F.col("size") <= block)
        .withColumn("pack", F.when(F.col("alone"), F.pmod(root, F.lit(packs))).otherwise(root))
        .withColumn("mine", F.pmod(F.xxhash64("vertex"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
        .select("alone", "pack", "i", "j", "mine", "vertex", "copies", "content")
        .groupBy("alone", "pack", "i", "j")
    )


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n = len(sets)
    shared = np.zeros((n, n), np.float32)
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    group = np.cumsum(fresh) - 1
    common = (np.bincount(group, minlength=1) >= 2)[group] if len(values) else np.empty(0, bool)
    owner, group = owner[common], group[common]
    if not len(group):
        return shared.astype(np.int64)
    group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    width = min(COLUMNS, group[-1] + 1)
    cuts = np.searchsorted(group, np.arange(0, group[-1] + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        table = np.zeros((n, width), np.float32)
        table[owner[a:b], group[a:b] - k * width] = 1
        shared += table @ table.T
    return shared.astype(np.int64)


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two different sets reach the Jaccard threshold."""
    shared = overlaps(sets)
    size = np.array([len(s) for s in sets], np.int64)
    union = size[:, None] + size[None, :] - shared
    linked = (shared >= threshold * union - 1e-9) & (shared > 0)
    np.fill_diagonal(linked, False)
    return linked


def _same(ids: pa.Array) -> np.ndarray:
    """Rows of one vertex, which may come with several of its groups."""
    code = ids.dictionary_encode().indices.to_numpy()
    return code[:, None] == code[None, :]


def verifier(sets_of: Callable[[pa.Array], list[np.ndarray]], threshold: float, id_type: pa.DataType):
    """For ``applyInArrow`` over ``in_blocks``: links of each vertex and its local root.

    Rows need ``vertex``, ``mine``, ``i``, ``j``, ``copies`` and ``content``. Between two
    blocks only pairs across count, so a pair is counted in exactly one task.
    """

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vertex")
        ids = rows.column("vertex").combine_chunks()
        block = rows.column("mine").to_numpy()
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        linked = similar(sets_of(rows.column("content")), threshold)
        linked &= ~_same(ids)
        if i != j:
            linked &= block[:, None] != block[None, :]
        links = linked @ rows.column("copies").to_numpy()
        root = np.arange(len(ids))
        while True:  # least neighbour, again and again: ids are sorted, so index order is id order
            least = np.where(linked, root[None, :], len(ids)).min(1, initial=len(ids))
            new = np.minimum(root, least)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        found = np.flatnonzero(linked.any(1))
        return pa.table({
            "vertex": ids.take(pa.array(found)).cast(id_type),
            "links": pa.array(links[found].astype(np.int64)),
            "near": ids.take(pa.array(root[found])).cast(id_type),
        })

    return verify


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` values that catch a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
