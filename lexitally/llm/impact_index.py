"""The exact k largest integer inner products, score at a time over an impact-ordered index.

1. Of a block of candidates, each dimension has a posting list: all rows by falling component, cut into segments of equal
   quantised impact, each with its smallest and largest component.
2. Some queries at a time order the segments of all dimensions by the most that they can add to one of their scores (for negative weights
   those with the smallest components come first), and add each segment's least gain to the 16-bit accumulators of its rows, in units in which no sum overflows.
3. What a row may still gain is bounded for all rows at once: in each dimension by the next segment's largest gain, or by a
   segment's spread where the row was already met. So each row's score has a lower and an upper bound at any time. Rows whose upper bound
   is below the k-th largest lower bound, or below the k-th score so far, are proven out. Accumulation stops when few
   possible members are left, or at the end; all possible members are then scored exactly.
4. The bounds of a few rows tell beforehand whether accumulation can stop on the way. If not, every segment is to be added, in whatever
   order: then the gains of a row's segments are added a dimension at a time, some thousand rows after others, which stay in the cache.

So the result is exact whatever the data. Where the sums of the bounds may not fit into 64 bits, all rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm import integer_blocks as ib
from lexitally.sources.workdir import discard, written

#: Segments of a dimension.
LEVELS = 32
#: Queries whose scores are accumulated side by side, and how often on the way their bounds are looked at.
QUERIES, LOOKS = 128, 4
#: Components of these queries together, at most.
WIDE = 8192
#: Rows that are accumulated at a time if all segments are added, and rows that tell beforehand whether they are.
ROWS, SAMPLE = 8192, 128
#: The largest accumulator.
FULL = (1 << 16) - 1
#: Possible members at which accumulation stops: that many times k, or one row of so many.
MEMBERS, SHARE = 8, 64

_FOUND = "query_id bigint, found bigint, score bigint"


class Postings:
    """A block's impact-ordered lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, cuts: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        self.ids, self.vectors, self.places, self.cuts, self.least, self.most = ids, vectors, places, cuts, least, most
        self.filled = cuts[:, 1:] > cuts[:, :-1]
        self.segments = np.empty(places.shape, np.uint8 if self.filled.shape[1] <= 256 else np.int32)  # of each row, by dimension
        for d, row in enumerate(places):
            self.segments[d, row] = np.repeat(np.arange(self.filled.shape[1]), np.diff(cuts[d]))

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> Postings:
        rows, width = vectors.shape
        places, cuts = np.zeros((width, rows), np.uint16 if rows <= 1 << 16 else np.int32), np.zeros((width, levels + 1), np.int32)
        least, most = np.zeros((width, levels), np.int64), np.zeros((width, levels), np.int64)
        for d in range(width):
            column = vectors[:, d].astype(np.int64)
            order = np.argsort(-column, kind="stable")
            values = column[order]
            step = (values[0] - values[-1]) // levels + 1
            cuts[d] = np.searchsorted((values[0] - values) // step, np.arange(levels + 1))
            places[d] = order
            for s in range(levels):
                if cuts[d, s] < cuts[d, s + 1]:
                    most[d, s], least[d, s] = values[cuts[d, s]], values[cuts[d, s + 1] - 1]
        return cls(ids, vectors, places, cuts, least, most)

    def arrays(self) -> dict[str, np.ndarray]:
        """What is stored: components in the order of the lists, where equal ones are together."""
        sorted_ = np.take_along_axis(self.vectors.T, self.places.astype(np.intp), axis=1)
        name = "values" if self.vectors.dtype == np.int16 else "large"
        places = "places" if self.places.dtype == np.uint16 else "far"
        return {"ids": self.ids, places: self.places, name: sorted_, "cuts": self.cuts, "least": self.least, "most": self.most}

    @classmethod
    def read(cls, table: pa.Table, levels: int = LEVELS) -> Postings:
        width = table.column("width")[0].as_py()
        kinds = {"ids": np.int64, "places": np.uint16, "far": np.int32, "values": np.int16, "large": np.int32, "cuts": np.int32, "least": np.int64, "most": np.int64}
        at = ib.whole(table, kinds)
        ids, values = at["ids"], at["large"] if at["large"].size else at["values"]
        places = (at["far"] if at["far"].size else at["places"]).reshape(width, len(ids))
        vectors = np.empty((len(ids), width), values.dtype)
        for d, row in enumerate(values.reshape(width, len(ids))):
            vectors[places[d], d] = row
        return cls(ids, vectors, places, at["cuts"].reshape(width, levels + 1), *(at[c].reshape(width, levels) for c in ("least", "most")))

    def possible(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
        """For each row and each of ``queries``, whether the row may be among the query's k best, of those that reach ``least`` and aren't its ``own``."""
        rows, width = self.vectors.shape
        weights = queries.astype(np.int64).T[:, None, :]
        ends = weights * self.least[:, :, None], weights * self.most[:, :, None]
        low, high, filled = np.minimum(*ends), np.maximum(*ends), self.filled[:, :, None]
        base = np.where(filled, low, ib.HIGHEST).min(axis=1, keepdims=True)
        low, high = (np.where(filled, x - base, 0) for x in (low, high))
        spread, base = (high - low).max(axis=1), base.sum(axis=0)[0] if width else np.zeros(len(queries), np.int64)
        unit = low.max(axis=1).sum(axis=0) // FULL + 1
        gains, lost = (low // unit).astype(np.uint16), (unit - 1) * width
        order = np.argsort(-np.where(self.filled, high.max(axis=2), -1).ravel(), kind="stable")[: np.count_nonzero(self.filled)]
        dims, levels = np.divmod(order, self.filled.shape[1])
        looks = np.searchsorted(np.cumsum(self.cuts[dims, levels + 1] - self.cuts[dims, levels]), np.arange(1, LOOKS) * (self.places.size / LOOKS)) + 1
        looks = np.unique(looks[looks < len(order)]).tolist()
        few, unknown = max(MEMBERS * k, rows // SHARE), least <= ib.LOWEST // 4
        kth = k + int(np.count_nonzero(own, axis=0).max(initial=0))  # so that own rows don't count

        def bar(stop: int, bound: np.ndarray) -> np.ndarray:
            """What an accumulator must reach for ``bound``, when ``stop`` segments were added."""
            coming = np.zeros(self.filled.shape, bool)
            coming[dims[stop:], levels[stop:]] = True
            slack = np.maximum(spread, np.where(coming[:, :, None], high, 0).max(axis=1)).sum(axis=0)
            return np.clip(-((base + lost + slack - bound) // unit), 0, FULL).astype(np.uint16)

        def bound(total: np.ndarray, nth: int) -> np.ndarray:
            out = least.copy()
            if unknown.any() and len(total) >= nth:
                some = np.partition(np.ascontiguousarray(total[:, unknown].T), -nth, axis=1)[:, -nth]
                out[unknown] = np.maximum(out[unknown], base[unknown] + unit[unknown] * some.astype(np.int64))
            return out

        def add(total: np.ndarray, segments: np.ndarray, gains: np.ndarray) -> None:
            room = np.empty(total.shape, np.uint16)
            for d in range(width):
                np.take(gains[d], segments[d], axis=0, out=room, mode="clip")
                total += room

        def hopeful(stop: int) -> bool:
            if not unknown.any() and not bar(stop, least).all():
                return False
            done = np.zeros(self.filled.shape, bool)
            done[dims[:stop], levels[:stop]] = True
            some = self.segments[:, :: max(1, rows // SAMPLE)]
            total = np.zeros((some.shape[1], len(queries)), np.uint16)
            add(total, some, np.where(done[:, :, None], gains, 0).astype(np.uint16))
            inside = np.count_nonzero(total >= bar(stop, bound(total, 1)), axis=0).max()
            return inside * rows <= few * len(total)

        total = np.zeros((rows, len(queries)), np.uint16)
        first = next((i for i, stop in enumerate(looks) if hopeful(stop)), None)
        if first is None:
            for begin in range(0, rows, ROWS):
                add(total[begin : begin + ROWS], self.segments[:, begin : begin + ROWS], gains)
            return (total >= bar(len(order), bound(total, kth))) & ~own
        at = 0
        for stop in [*looks[first:], len(order)]:
            for d, s in zip(dims[at:stop].tolist(), levels[at:stop].tolist(), strict=True):
                total[self.places[d, self.cuts[d, s] : self.cuts[d, s + 1]]] += gains[d, s]
            at = stop
            members = (total >= bar(stop, bound(total, kth))) & ~own
            if np.count_nonzero(members, axis=0).max() <= few:
                break
        return members

    def found(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(places of queries, ids, scores)`` of the k largest inner products of each query that reach ``least``, equal ones by the smaller id; some queries at a time."""
        own, twice = np.zeros((len(self.ids), len(queries)), bool), np.flatnonzero(np.isin(self.ids, query_ids))
        own[twice] = self.ids[twice, None] == query_ids
        reach = np.maximum(np.abs(self.least), np.abs(self.most)).max(axis=1)
        if queries.shape[1] and (np.abs(queries.astype(np.float64)) * reach).sum(axis=1).max() < 2.0**60:
            members = self.possible(queries, own, k, np.maximum(least, -(1 << 61)))
        else:
            members = ~own
        parts = np.cumsum(np.count_nonzero(members, axis=0)) // ib.PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(queries)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            rows, at = np.nonzero(members[:, begin:end])
            at += begin
            scores = ib.paired(self.vectors, rows, queries, at)
            kept = scores >= least[at]
            at, ids, scores = at[kept], self.ids[rows[kept]], scores[kept]
            order = np.lexsort((ids, -scores, at))
            order = order[ib.first_of(at[order], k)]
            yield at[order], ids[order], scores[order]

    def best(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query its ``(ids, scores)`` of ``found``."""
        at, ids, scores = (np.concatenate(x) for x in zip(*self.found(queries, query_ids, k, least), strict=True))
        for q in range(len(queries)):
            yield ids[at == q], scores[at == q]


def index(candidates: DataFrame) -> DataFrame:
    """The written index of ``candidates`` (``id, vector, width, b``), in pieces."""

    def build(table: pa.Table) -> pa.Table:
        at = Postings.of(table.column("id").to_numpy(), ib.matrix(table))
        return ib.pieces(table.column("width")[0].as_py(), table.column("b")[0].as_py(), at.arrays())

    return written(candidates.select("id", "vector", "width", "b").groupBy("width", "b").applyInArrow(build, ib.PIECES), "impact-index")


def largest_products(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = ib.SCALE, index_bytes: int = ib.INDEX_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k candidates of largest integer inner product.

    Both tables have ``id, vector``, other columns aren't read. Components x count as floor(scale * x). A query's own row (equal id) is none of its
    candidates. Ranks count from 1; equal scores go by the smaller id. Rows with a null id, and vectors for which ``integers`` gives
    null, take no part; zero vectors do, with scores of 0, and so do empty ones among themselves. Vectors are compared with those of
    their own length. Candidates with equal ids are separate candidates; queries with equal ids count as one, that with the smallest vector. No
    candidates or no queries: no rows. ``index_bytes`` bounds a block of the index; larger ones are sent to fewer tasks.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col("id").cast("long").alias("id"), ib.integers(F.col("vector"), scale).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        block, out = Postings.read(y), [[np.zeros(0, np.int64)] for _ in range(3)]
        query_ids, queries, least = x.column("id").to_numpy(), ib.matrix(x), x.column("least").to_numpy()
        side = max(1, min(QUERIES, WIDE // max(1, queries.shape[1])))
        for begin in range(0, len(x), side):
            some = slice(begin, begin + side)
            for at, ids, scores in block.found(queries[some], query_ids[some], k, least[some]):
                for values, more in zip(out, (query_ids[some][at], ids, scores), strict=True):
                    values.append(more)
        return pa.table([pa.array(np.concatenate(v), pa.int64()) for v in out], names=["query_id", "found", "score"])

    dealt, blocks = ib.dealt(usable(candidates), index_bytes)
    postings = index(dealt)
    discard(dealt)
    asked = written(usable(queries).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    asked, query_blocks = ib.query_blocks(asked, blocks)
    found = ib.in_two_rounds(asked, query_blocks, postings, blocks, ["query_id"], k, run, _FOUND)
    return found.select("query_id", "rank", F.col("found").alias("vec_id"), "score")
