"""Exact largest inner products of quantized vectors, by no-random-access aggregation.

Every component x becomes floor(256 * x), so scores are whole numbers. A task cuts its rows
into blocks of a bounded size and sorts each block into one list per dimension. A query reads each list from the end that its own
component favours, all lists to the same depth. What has been read of a row, completed by
the last value read from each other list, bounds its score from above; completed by the far
end of those lists, from below. Reading stops as soon as no row outside a few can still
reach the k-th best lower bound, or the k-th best of the blocks the task read before; only then are
the rows that are left looked up whole and scored. Nothing is approximate: a row is left
out only when its upper bound is below k scores already certain.

Queries go to the tasks in rounds of ``round_queries``, whose size bounds what is
broadcast; each round reads the stored rows once and leaves at most k rows per query and
task for the ranking.

Defined results: a row with a null id takes no part; nor does a vector that is null, of
another length than the most frequent one (of equally frequent ones the longest), or holds
a null or non-finite component, nor one with a component so large that a score might not
fit a long. Zero vectors take part. Rows that share a vec_id are rows of their own: each
is a candidate for the others, and each query row has its own k results. Of equal vectors
the smaller vec_id comes first. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.store import stored

K = 5
SCALE = 256
BLOCK = 4096
ROUND_QUERIES = 16384
GROUP = 256
STEPS = 8
FEW = 16


def quantized(vectors: DataFrame, size: int, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): usable rows with whole components. ``row`` numbers the rows."""
    limit = float(math.isqrt((1 << 62) // max(1, size)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < limit))
    return (
        vectors.where("vec_id is not null").where((F.size("embedding") == size) & fit)
        .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


class Lists:
    """The sorted lists of one block, one per dimension, read in steps from both ends."""

    def __init__(self, values: np.ndarray):
        self.values, self.order = values, np.argsort(values, axis=0, kind="stable")
        self.n, self.axis = len(values), np.arange(values.shape[1])
        self.ranked = np.take_along_axis(values, self.order, 0)
        self.least, self.most = self.ranked[0], self.ranked[-1]

    def read(self, depth: int, top: np.ndarray, bottom: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Enter entries ``before``..``depth`` of both ends into ``top`` and ``bottom``.

        Returns the value at which each list was left, from above and from below.
        """
        for filled, part in ((top, slice(self.n - depth, self.n - before)), (bottom, slice(before, depth))):
            filled[self.order[part], self.axis] = self.ranked[part]
        return self.ranked[self.n - depth], self.ranked[depth - 1]


def search(
    lists: Lists, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, steps: int = STEPS, few: int = FEW,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of every row that may be among a query's best k, entries read.

    ``own`` is the place of the query's own row in this block, or -1. ``floor`` is the k-th
    best score each query is already certain of (-inf if of none).
    """
    n, dims = lists.values.shape
    number = lists.values.dtype
    none = np.iinfo(np.int64).min if number == np.int64 else -np.inf
    unread = np.iinfo(np.int64).min if number == np.int64 else np.nan
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    top, bottom = np.full((n, dims), unread, number), np.full((n, dims), unread, number)
    active, read, found = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
    before = 0
    for step in range(1, steps + 1):
        depth = -(-n * step // steps)
        if depth == before:
            continue
        high, low = lists.read(depth, top, bottom, before)
        before = depth
        new_top = np.isnan(top) if number != np.int64 else top == unread
        new_bottom = np.isnan(bottom) if number != np.int64 else bottom == unread
        u, d = up[:, active], down[:, active]
        upper = np.where(new_top, high, top) @ u + np.where(new_bottom, low, bottom) @ d
        lower = np.where(new_top, lists.least, top) @ u + np.where(new_bottom, lists.most, bottom) @ d
        mine = np.flatnonzero(own[active] >= 0)
        upper[own[active[mine]], mine] = none
        lower[own[active[mine]], mine] = none
        sure = floor[active]
        if n >= k:
            sure = np.maximum(sure, np.partition(lower, n - k, axis=0)[n - k])
        left = (upper >= sure) & (upper != none)
        count = left.sum(0)
        done = (count <= few * k) if depth < n else np.ones(len(active), bool)
        ended = np.flatnonzero(done)
        place, which = np.nonzero(left[:, ended])
        which = active[ended[which]]
        found.append((which, place))
        read[active[ended]] = depth * dims
        active = active[~done]
        if not len(active):
            break
    which = np.concatenate([w for w, _ in found]) if found else np.empty(0, np.int64)
    place = np.concatenate([p for _, p in found]) if found else np.empty(0, np.int64)
    # What is left is looked up whole.
    score = np.empty(len(which), number)
    for begin in range(0, len(which), 1 << 15):
        part = slice(begin, begin + (1 << 15))
        score[part] = np.einsum("ij,ij->i", queries[which[part]], lists.values[place[part]])
    return which, place, score, read


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, in order."""
    order = np.lexsort((rows, ids, -score, query))
    sorted_query = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query) < k]


def _searcher(rows: np.ndarray, queries: np.ndarray, k: int, block: int, steps: int, few: int, number: type):
    none = np.iinfo(np.int64).min if number is np.int64 else -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # query, score, vec_id, row
        best = [np.empty(0, np.int64), np.empty(0, number), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            for cut in range(0, len(batch), block):
                part = batch.slice(cut, block)
                ids, held = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                lists = Lists(_matrix(part.column("v")).astype(number))
                by_row = np.argsort(held)
                for begin in range(0, len(queries), GROUP):
                    turn = slice(begin, begin + GROUP)
                    size = len(rows[turn])
                    spot = by_row[np.minimum(np.searchsorted(held, rows[turn], sorter=by_row), len(held) - 1)]
                    own = np.where(held[spot] == rows[turn], spot, -1)
                    known = (best[0] >= begin) & (best[0] < begin + GROUP)
                    at = best[0][known] - begin
                    floor = np.full(size, none, number)
                    floor[at] = best[1][known]  # best first, so the last of each query is its k-th
                    floor[np.bincount(at, minlength=size) < k] = none
                    which, place, score, read = search(lists, queries[turn], own, floor, k, steps, few)
                    merged = [
                        np.concatenate([b[known], new])
                        for b, new in zip(best, (which + begin, score, ids[place], held[place]))
                    ]
                    keep = _best(*merged, k)
                    best = [np.concatenate([b[~known], m[keep]]) for b, m in zip(best, merged)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0], pa.int64()), pa.array(best[1].astype(np.int64), pa.int64()),
             pa.array(best[2], pa.int64()), pa.array(best[3], pa.int64())],
            ["query", "score", "vec_id", "row"],
        )

    return run


def top_products(
    vectors: DataFrame, is_query: str, k: int = K, block: int = BLOCK, round_queries: int = ROUND_QUERIES,
    steps: int = STEPS, few: int = FEW,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``is_query`` the best k others."""
    spark = vectors.sparkSession
    lengths = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count()
    top = lengths.where("n > 0").orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = top[0]["n"] if top else 0
    points = stored(quantized(vectors, size))
    greatest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    most = points.agg(F.coalesce(greatest, F.lit(0))).first()[0]
    number = np.float64 if size * most * most < 1 << 53 else np.int64
    # Of equal vectors only the k + 1 smallest can be among anyone's k best.
    same = Window.partitionBy("v").orderBy("vec_id", "row")
    held = stored(points.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"))

    rounds = -(-points.where(is_query).count() // round_queries)
    asked = stored(points.where(is_query).withColumn("round", F.pmod(F.xxhash64("row"), F.lit(max(1, rounds)))))
    found = None
    for i in range(rounds):
        # One round's queries at a time: round_queries bounds what the driver holds.
        part = asked.where(F.col("round") == i).select("row", "vec_id", "v").toArrow()
        if not len(part):
            continue
        rows, ids = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
        run = _searcher(rows, _matrix(part.column("v")).astype(number), k, block, steps, few, number)
        best = stored(held.mapInArrow(run, "query long, score long, vec_id long, row long"))
        names = spark.createDataFrame(pa.table({"query": np.arange(len(rows)), "query_row": rows, "query_id": ids}))
        named = best.join(F.broadcast(names), "query").drop("query")
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
