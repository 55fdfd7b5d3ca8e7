"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks; each pair of blocks is a tile, and a task multiplies a
tile's int8 codes. A product of codes differs from the true one by at most
|ex| |y'| + |x| |ey| (ex, ey the rounding errors, y' the decoded vector), so it gives each pair a lower
and an upper bound. Only pairs whose upper bound reaches the k-th largest lower bound (or the k-th
score so far) can be among the k nearest: they are recomputed in double precision from the original
vectors and go through the query's heap. The result is exact.

Candidates are blocked by norm, the longest first. Each query first meets one block of the longest, which gives it a
k-th score, and doesn't meet it again; of the other blocks it only goes to those whose longest vector could reach that, and a tile only
returns what does. Where all vectors are equally long, no block can be passed over, and the work is queries times candidates.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.sources.workdir import written

#: Bytes of a block of queries and of candidates, as doubles: a tile holds one of each. The fewest queries of a block.
QUERY_BYTES, CANDIDATE_BYTES, LEAST_QUERIES = 8 << 20, 32 << 20, 512
#: Classes of norms, at most: their bounds are sent with the plan.
CLASSES = 256
#: Vectors of each block that are multiplied at a time.
QUERY_ROWS, CANDIDATE_ROWS = 256, 4096
#: Pairs that are recomputed at a time.
PAIRS = 1 << 17


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Codes:
    """Int8 codes of vectors, with what the error bounds need."""

    def __init__(self, vectors: np.ndarray) -> None:
        largest = np.abs(vectors).max(axis=1, initial=0)
        scale = largest / 127
        self.scale = np.where(scale > 0, scale, 1)
        self.codes = np.clip(np.rint(vectors / self.scale[:, None]), -127, 127).astype(np.int8)
        # lengths are taken of scaled vectors, so that no square is lost below or above the doubles' range
        parts = vectors / np.where(largest > 0, largest, 1)[:, None]
        rest = vectors / self.scale[:, None] - self.codes
        with np.errstate(all="ignore"):
            self.norm = largest * np.sqrt((parts**2).sum(axis=1))
            self.error = np.where(scale > 0, self.scale * np.sqrt((rest**2).sum(axis=1)), self.norm)
            self.decoded_norm = self.scale * np.sqrt((self.codes.astype(np.float64) ** 2).sum(axis=1))

    def floats(self, at: slice) -> np.ndarray:
        """The codes for a matrix product that is exact: integers below 2**24 in single precision."""
        kind = np.float32 if self.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
        return self.codes[at].astype(kind)


def bounds(x: Codes, i: slice, y: Codes, j: slice) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of a tile."""
    with np.errstate(all="ignore"):  # what overflows is bounded by nothing
        lower, upper = _bounds(x, i, y, j)
    return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)


def _bounds(x: Codes, i: slice, y: Codes, j: slice) -> tuple[np.ndarray, np.ndarray]:
    about = (x.floats(i) @ y.floats(j).T).astype(np.float64) * x.scale[i, None] * y.scale[None, j]
    margin = x.error[i, None] * y.decoded_norm[None, j] + x.norm[i, None] * y.error[None, j]
    margin += 1e-12 * x.norm[i, None] * y.norm[None, j] + 1e-300  # rounding of what is computed here
    return about - margin, about + margin


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, component by component: the same whatever rows stand around."""
    out = np.zeros(len(x))
    with np.errstate(all="ignore"):
        for d in range(x.shape[1]):
            out += x[:, d] * y[:, d]
    return out


def tile_nearest(query_ids: np.ndarray, queries: np.ndarray, least_score: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, float, int, int]]:
    """``(position of the query, score, id, position)`` of each query's k nearest in a tile, of those that reach its least score, by heaps.

    A score that overflows to NaN counts as below all others.
    """
    x = Codes(queries)
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in query_ids]  # (score, -id, position): the worst is first
    for start in range(0, len(ids), CANDIDATE_ROWS):
        j = slice(start, min(len(ids), start + CANDIDATE_ROWS))
        y = Codes(vectors[j])
        every = slice(0, j.stop - start)
        for at in range(0, len(query_ids), QUERY_ROWS):
            i = slice(at, min(len(query_ids), at + QUERY_ROWS))
            lower, upper = bounds(x, i, y, every)
            own = query_ids[i, None] == ids[None, j]
            lower[own] = upper[own] = -np.inf
            least = np.full(len(lower), -np.inf)
            if lower.shape[1] > k:
                least = np.partition(lower, -k, axis=1)[:, -k]
            so_far = np.maximum(least_score[i], [h[0][0] if len(h) == k else -np.inf for h in heaps[i]])
            rows, columns = np.nonzero((upper >= np.maximum(least, so_far)[:, None]) & ~own)
            for cut in range(0, len(rows), PAIRS):
                q, c = rows[cut : cut + PAIRS] + at, columns[cut : cut + PAIRS] + start
                scores = inner_products(queries[q], vectors[c])
                reached = ~(scores < least_score[q])
                q, c, scores = q[reached], c[reached], np.where(np.isnan(scores), -np.inf, scores)[reached]
                order = np.lexsort((ids[c], -scores, q))
                q, c, scores = q[order], c[order], scores[order]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
                nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
                q, c, scores = q[nth < k], c[nth < k], scores[nth < k]
                for a, s, b, place in zip(q.tolist(), scores.tolist(), ids[c].tolist(), c.tolist(), strict=True):
                    heap, found = heaps[a], (s, -b, place)
                    if len(heap) < k:
                        heapq.heappush(heap, found)
                    elif found > heap[0]:
                        heapq.heapreplace(heap, found)
    for at, heap in enumerate(heaps):
        for score, minus, place in heap:
            yield at, score, -minus, place


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("vector").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)


def _tiles(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of each tile: queries (``id, vector, least``) and candidates (``id, vector``) of equal ``width, a, b``."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(x) and len(y):
            query_ids, queries = x.column("id").to_numpy(), _matrix(x)
            ids, vectors = y.column("id").to_numpy(), _matrix(y)
            for at, score, found, place in tile_nearest(query_ids, queries, x.column("least").to_numpy(), ids, vectors, k):
                if score == -np.inf:  # the score itself may not be a number
                    score = float(inner_products(queries[at : at + 1], vectors[place : place + 1])[0])
                out["query_id"].append(int(query_ids[at]))
                out["vec_id"].append(found)
                out["score"].append(score)
        return pa.table([pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], names=list(out))

    return left.groupBy("width", "a", "b").cogroup(right.groupBy("width", "a", "b")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")


def _ranked(tops: DataFrame, k: int) -> DataFrame:
    """A tile leaves at most k rows a query; the rank's limit keeps k of a task's before they are sent."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))), "vec_id")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocked(candidates: DataFrame, block: int | None) -> tuple[DataFrame, list[tuple[int, float, int]]]:
    """``candidates`` (``id, vector, norm``) with a block's number ``b``, and ``(first number, longest norm, blocks)`` of each class of norms.

    Classes fall by norm; a class of more than ``block`` rows is dealt over several blocks.
    """
    total, width = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    block = block or max(1, CANDIDATE_BYTES // (8 * max(1, width)))
    classes = min(CLASSES, max(1, math.ceil(total / block)))
    cuts = sorted(set(candidates.approxQuantile("norm", [i / classes for i in range(1, classes)], 0.1 / classes))) if classes > 1 else []
    kind = F.lit(0)
    for cut in cuts:  # the class is the number of cuts that are above
        kind = kind + (F.col("norm") < cut).cast("int")
    classed = candidates.withColumn("class", kind)
    sizes = classed.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).orderBy("class").collect()
    plan, first, at = [], 0, {}
    for r in sizes:
        at[r["class"]] = (first, math.ceil(r.n / block))
        plan.append((first, r.norm, at[r["class"]][1]))
        first += at[r["class"]][1]
    number = F.lit(0)
    for c, (begin, n) in at.items():
        number = F.when(F.col("class") == c, begin + F.pmod(F.xxhash64("id", "vector"), F.lit(n))).otherwise(number)
    return classed.withColumn("b", number.cast("int")).drop("class"), plan


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int | None = None, candidate_block: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k candidates of largest inner product.

    Both tables have ``id, vector``; other columns aren't read. A query's own row (equal id) is none of its
    candidates. Ranks count from 1; equal scores go by the smaller id. Vectors that aren't ``usable`` and rows with a
    null id take no part; vectors are only compared with those of their own length. Candidate rows
    with equal ids are separate candidates; queries with equal ids count as one, that with the
    smallest vector. Scores that overflow are infinite, or NaN, which comes last. No candidates: no rows. Blocks are
    sized by bytes unless their numbers of vectors are given.
    """
    longest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    norm = F.expr("largest * sqrt(aggregate(vector, 0D, (total, x) -> total + pow(x / largest, 2)))")
    queries = queries.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    queries = queries.withColumn("largest", longest)
    queries = written(queries.select("id", "vector", F.size("vector").alias("width"), norm.alias("norm")), "queries")
    candidates = candidates.where(F.col("id").isNotNull() & usable(F.col("vector"))).select("id", "vector", longest.alias("largest")).select("id", "vector", norm.alias("norm"))
    candidates, plan = blocked(candidates, candidate_block)
    candidates = written(candidates.withColumn("width", F.size("vector")), "candidates")
    if not plan:
        return _ranked(_tiles(queries.select("*", F.lit(0.0).alias("least"), *[F.lit(0).alias(c) for c in "ab"]), candidates.withColumn("a", F.lit(0)), k), k).select("query_id", "rank", "vec_id", "score")
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max("width"), F.lit(1))).first()
    rows = query_block or max(1, QUERY_BYTES // (8 * max(1, width)))
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n / rows), 0 if query_block else min(tasks, n // LEAST_QUERIES))
    left = queries.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    # the k-th score among one block of the longest vectors, which is not met again
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("a")
    first = _tiles(left.select("*", F.lit(0).alias("b"), F.lit(float("-inf")).alias("least")), candidates.where("b = 0").select("id", "vector", "width", "b", every), k)
    if plan == [(0, plan[0][1], 1)]:
        return _ranked(first, k).select("query_id", "rank", "vec_id", "score")
    first = written(_ranked(first, k).drop("rank"), "first-tiles")
    reached = _ranked(first.where(~F.isnan("score")), k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    left = left.join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    classes = F.array(*[F.struct(F.lit(b).alias("first"), F.lit(float(top)).alias("longest"), F.lit(number).alias("n")) for b, top, number in plan])
    # with room for rounding; a product that isn't a number could be anything
    bound = lambda c: F.col("norm") * c["longest"] * (1 + 1e-9)
    open_ = F.filter(classes, lambda c: F.isnan(bound(c)) | (bound(c) + 1e-300 >= F.col("least")))
    numbers = F.flatten(F.transform(open_, lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))
    left = written(left.withColumn("b", F.explode(F.filter(numbers, lambda b: b > 0))), "query-tiles")
    needed = written(left.select("a", "b").distinct(), "tiles")
    tops = _tiles(left, candidates.select("id", "vector", "width", "b").join(needed, "b"), k)
    return _ranked(first.unionByName(tops), k).select("query_id", "rank", "vec_id", "score")
