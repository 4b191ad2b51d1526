"""Nearest neighbours by stable projections in a kd-tree with a chi-square stop.

Vectors get one more component, so that the largest inner product becomes the least
Euclidean distance. Every point is projected onto ``dims`` Gaussian directions; the squared
projected length of a difference divided by its true squared length then follows a
chi-square law with ``dims`` degrees. A block of points is a kd-tree over the projections.
A query visits leaves by projected distance and verifies their points with the original
vectors, until the next leaf is so far that a point nearer than the present k-th would
project that far with probability below 1 - ``confidence``. Each true neighbour is
therefore missed with at most that probability.

Points and queries are dealt to (point block, query block) cells of bounded size; the best
of each cell are merged by rank. Equal vectors differ in id only, so all but their k + 1
smallest ids are left out of the index: no other can be among a query's k nearest.

Defined results: a row with a null id takes no part; nor does a vector that is null, zero,
of another length than the most frequent one, or holds a null or non-finite component.
Rows that share an id count once, with the least vector. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.store import stored

K = 20
DIMS = 16
CONFIDENCE = 0.95
LEAF = 64
LEAVES_A_ROUND = 8
POINTS = 8192
QUERIES = 1024
SEED = 5


def chi_square_quantile(p: float, dims: int) -> float:
    """By bisection; ``dims`` is even, so the tail is a finite Poisson sum."""
    if dims % 2:
        raise ValueError("an even number of projections is needed")

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def kd_leaves(projected: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Point indices of each leaf: halved along the widest axis until small enough."""
    todo, out = [np.arange(len(projected))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        axis = int(np.argmax(np.ptp(projected[own], axis=0)))
        half = len(own) // 2
        order = own[np.argpartition(projected[own, axis], half)]
        todo += [order[half:], order[:half]]
    return out


def nearest(
    points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
    k: int, largest: float, directions: np.ndarray, stop: float, leaf: int = LEAF,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query rows, ids and exact inner products of the best k per query, and points verified."""
    lift = np.sqrt(np.maximum(largest - (points**2).sum(1), 0))
    projected = points @ directions[:-1] + lift[:, None] * directions[-1]
    aim = queries @ directions[:-1]
    leaves = kd_leaves(projected, leaf)
    low = np.array([projected[own].min(0) for own in leaves])
    high = np.array([projected[own].max(0) for own in leaves])
    gap = np.zeros((len(queries), len(leaves)))
    for d in range(projected.shape[1]):
        side = np.maximum(np.maximum(low[:, d] - aim[:, d, None], aim[:, d, None] - high[:, d]), 0)
        gap += side * side
    order = np.argsort(gap, axis=1, kind="stable")
    gap = np.take_along_axis(gap, order, 1)
    width, spare = LEAVES_A_ROUND * leaf, 3 * k
    best = np.full((len(queries), spare), -np.inf)
    who = np.full((len(queries), spare), -1)
    length = (queries**2).sum(1) + largest
    active = np.arange(len(queries))
    verified = 0
    for begin in range(0, len(leaves), LEAVES_A_ROUND):
        turn = order[active, begin : begin + LEAVES_A_ROUND]
        score = np.full((len(active), width), -np.inf)
        point = np.full((len(active), width), -1)
        flat, slot = turn.ravel(), np.tile(np.arange(turn.shape[1]), len(active))
        row = np.repeat(np.arange(len(active)), turn.shape[1])
        by_leaf = np.argsort(flat, kind="stable")
        cuts = np.searchsorted(flat[by_leaf], np.arange(len(leaves) + 1))
        for n in np.flatnonzero(np.diff(cuts)):
            own, rows = leaves[n], by_leaf[cuts[n] : cuts[n + 1]]
            at = slot[rows][:, None] * leaf + np.arange(len(own))
            score[row[rows][:, None], at] = queries[active[row[rows]]] @ points[own].T
            point[row[rows][:, None], at] = own
            verified += len(rows) * len(own)
        own_id = (point >= 0) & (ids[point] == query_ids[active][:, None])
        score[own_id], point[own_id] = -np.inf, -1
        score = np.concatenate([best[active], score], 1)
        point = np.concatenate([who[active], point], 1)
        top = np.argpartition(-score, spare - 1, axis=1)[:, :spare]
        best[active], who[active] = np.take_along_axis(score, top, 1), np.take_along_axis(point, top, 1)
        if begin + LEAVES_A_ROUND >= len(leaves):
            break
        kth = -np.partition(-best[active], k - 1, axis=1)[:, k - 1]
        reach = np.where(np.isfinite(kth), np.maximum(length[active] - 2 * kth, 0), np.inf)
        active = active[gap[active, begin + LEAVES_A_ROUND] < stop * reach]
        if not len(active):
            break
    q, c = np.nonzero(who >= 0)
    found = who[q, c]
    # Summed in one order for every pair, so equal vectors have equal scores everywhere.
    exact = (queries[q] * points[found]).sum(1)
    rank = np.lexsort((ids[found], -exact, q))
    q, found, exact = q[rank], found[rank], exact[rank]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], ids[found[keep]], exact[keep], verified


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE,
    block_points: int = POINTS, block_queries: int = QUERIES, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows."""
    lengths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count()
    top = lengths.where("n > 0").orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = top[0]["n"] if top else 0

    def usable(df: DataFrame) -> DataFrame:
        wide = F.transform("embedding", lambda x: x.cast("double"))
        fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        some = F.exists("v", lambda x: x != 0)
        return (
            df.where("vec_id is not null").where(F.size("embedding") == size)
            .select("vec_id", wide.alias("v")).where(fit & some).groupBy("vec_id").agg(F.min("v").alias("v"))
        )

    same = Window.partitionBy("v").orderBy("vec_id")
    points = stored(usable(vectors).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"))
    asked = stored(usable(queries))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n_points, largest = points.agg(F.count(F.lit(1)), F.coalesce(F.max(square), F.lit(0.0))).first()
    parts, groups = -(-n_points // block_points) or 1, -(-asked.count() // block_queries) or 1
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((size + 1, dims))
    stop = chi_square_quantile(confidence, dims)

    def own_and_all(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        q, ids, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        asked_ids = wanted.column("vec_id").to_numpy()
        if len(held) and len(wanted):
            held = held.sort_by("vec_id")
            q, ids, score, _ = nearest(
                _matrix(held.column("v")), held.column("vec_id").to_numpy(), _matrix(wanted.column("v")),
                asked_ids, k, largest, directions, stop)
        return pa.table({"query_id": pa.array(asked_ids[q], pa.int64()), "vec_id": pa.array(ids, pa.int64()),
                         "score": pa.array(score, pa.float64())})

    cells = (
        own_and_all(points, "p", parts, "q", groups).groupBy("p", "q")
        .cogroup(own_and_all(asked, "q", groups, "p", parts).groupBy("p", "q"))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
