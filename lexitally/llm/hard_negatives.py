"""Hard negatives by branch and bound over ball trees.

1. Candidates are dealt into blocks (``integer_blocks``), and a task builds each block's ball tree: a node has a centre, a radius and the
   only label of its rows, if there is just one. It is cut in halves along the line between two far rows, but between labels first,
   where these have a leaf's rows or more each.
2. An inner product with a row of a node is within |q| * radius of that with its centre: a bound from above and one from below. A search
   asks for the best scores within windows. Some queries go through the tree together, level by level, and each leaves out nodes outside of its
   windows (above or below), strictly beneath their current k-th scores, or of a label that isn't asked for. A query without a k-th score
   first meets its most promising leaf. Leaves are taken in order of their upper bounds, some at a time, and scored for all queries that still need them.
3. An anchor's positives are one search, without bounds and for its own label; its negatives another, with a window for each positive.

The bounds have room for rounding, and scores are exact integers, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm import integer_blocks as ib
from lexitally.sources.workdir import discard, written

#: Rows of a leaf, of leaves that are scored at a time, and queries that go through a tree together.
LEAF, AT_ONCE, QUERIES = 64, 512, 256

_NODE = np.dtype([("begin", "<i4"), ("end", "<i4"), ("first", "<i4"), ("one_label", "?"), ("label", "<i8"), ("radius", "<f8")])


class Window:
    """The k best scores within bounds, equal ones by the smaller id."""

    def __init__(self, low: int, high: int, least: int, k: int) -> None:
        self.low, self.high, self.k = max(low, least), high, k
        self.heap: list[tuple[int, int]] = []  # (score, -id): the worst is first

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        if len(inside) > self.k:
            inside = inside[np.lexsort((ids[inside], -scores[inside]))[: self.k]]
        for found in zip(scores[inside].tolist(), (-ids[inside]).tolist(), strict=True):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, found)
            elif found > self.heap[0]:
                heapq.heapreplace(self.heap, found)
        if len(self.heap) == self.k:
            self.low = max(self.low, self.heap[0][0])


class Windows:
    """The k best scores of many windows; those of one query, a number from 0, stand together, and each query has one."""

    def __init__(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.query, self.low, self.high, self.k = query, low.copy(), high, k
        self.starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        self.number = np.diff(np.r_[self.starts, len(query)])
        self.last = np.maximum.reduceat(high, self.starts)
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))  # what is found
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting = 0
        self.merge()

    def merge(self) -> None:
        """Of all that was added, keeps each window's k best, and nothing below the k-th is let in from now on."""
        if self.pending:
            window, score, ident = (np.concatenate(x) for x in zip((self.window, self.score, self.id), *self.pending, strict=True))
            order = np.lexsort((ident, -score, window))
            order = order[ib.first_of(window[order], self.k)]
            self.window, self.score, self.id = window[order], score[order], ident[order]
            full = np.flatnonzero(np.bincount(self.window, minlength=len(self.low)) == self.k)
            ends = np.searchsorted(self.window, full, "right") - 1
            self.low[full] = np.maximum(self.low[full], self.score[ends])
            self.pending, self._waiting = [], 0
        self.first = np.minimum.reduceat(self.low, self.starts)

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Takes what is in a window of its query."""
        number = self.number[query]
        pair = np.repeat(np.arange(len(query)), number)
        window = np.repeat(self.starts[query] - np.cumsum(number) + number, number) + np.arange(len(pair))
        inside = np.flatnonzero((score[pair] >= self.low[window]) & (score[pair] <= self.high[window]))
        if len(inside):
            pair = pair[inside]
            self.pending.append((window[inside], score[pair], ident[pair]))
            self._waiting += len(inside)
            if self._waiting > max(1024, len(self.low)):
                self.merge()


class BallTree:
    """A block's rows in the order of the leaves, and its nodes; a node's children are ``first`` and the one after, none for 0."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, centres: np.ndarray) -> None:
        self.ids, self.labels, self.vectors, self.nodes, self.centres = ids, labels, vectors, nodes, centres
        self.reach, self.inner = nodes["radius"] * (1 + 1e-9), nodes["first"] > 0
        self.lengths = np.sqrt((centres**2).sum(axis=1)) + nodes["radius"]

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(ids))
        nodes, centres = [(0, len(ids), 0)], []
        heads = []
        at = 0
        while at < len(nodes):
            begin, end, _ = nodes[at]
            rows = order[begin:end]
            some = vectors[rows].astype(np.float64)
            centre = some.mean(axis=0)
            some -= centre
            away = np.einsum("ij,ij->i", some, some)
            known = labels[rows]
            heads.append((bool((known == known[0]).all()), int(known[0]), float(np.sqrt(away.max()))))
            centres.append(centre)
            if end - begin > leaf:
                half = (end - begin) // 2
                by_label = None if heads[-1][0] else np.argsort(known, kind="stable")
                borders = np.zeros(0, np.int64) if by_label is None else np.flatnonzero(np.diff(known[by_label])) + 1
                if len(borders) and (len(borders) + 1) * leaf <= end - begin:
                    order[begin:end] = rows[by_label]
                    half = int(borders[np.abs(borders - half).argmin()])
                else:
                    a = some[away.argmax()]
                    far = some - a
                    b = far[np.einsum("ij,ij->i", far, far).argmax()]
                    order[begin:end] = rows[np.argpartition(far @ b, half)]
                nodes[at] = (begin, end, len(nodes))
                nodes += [(begin, begin + half, 0), (begin + half, end, 0)]
            at += 1
        table = np.array([(*n, *h) for n, h in zip(nodes, heads, strict=True)], _NODE)
        return cls(ids[order], labels[order], vectors[order], table, np.array(centres))

    def arrays(self) -> dict[str, np.ndarray]:
        """What is stored."""
        name = "vectors" if self.vectors.dtype == np.int16 else "large"
        return {"ids": self.ids, "labels": self.labels, name: self.vectors, "nodes": self.nodes, "centres": self.centres}

    @classmethod
    def read(cls, table: pa.Table) -> BallTree:
        width = table.column("width")[0].as_py()
        at = ib.whole(table, {"ids": np.int64, "labels": np.int64, "vectors": np.int16, "large": np.int32, "nodes": _NODE, "centres": np.float64})
        vectors = at["large"] if at["large"].size else at["vectors"]
        return cls(at["ids"], at["labels"], vectors.reshape(len(at["ids"]), width), at["nodes"], at["centres"].reshape(len(at["nodes"]), width))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that the inner products of each node's rows with each of ``queries`` can be."""
        lengths = np.sqrt((queries**2).sum(axis=1))
        about = self.centres @ queries.T
        room = (self.reach + 1e-9 * self.lengths)[:, None] * lengths + 1
        return about - room, about + room

    def search_all(self, queries: np.ndarray, query_ids: np.ndarray, labels: np.ndarray, same: bool, windows: Windows, dive: bool = True) -> int:
        """Fills ``windows`` with the rows of each query's label (or, unless ``same``, of another) but those of its id. Returns how many pairs were scored."""
        low, high = self.bounds(queries.astype(np.float64))
        kind, limit = ib.exact(self.vectors, queries)
        numbers = queries.astype(kind)
        scored = 0

        def needed(at: np.ndarray) -> np.ndarray:
            """Of nodes ``at``, those that each query still needs."""
            return (high[at] >= windows.first) & (low[at] <= windows.last)

        def score(leaves: np.ndarray, asked: np.ndarray) -> None:
            """Of ``leaves``, those that each query asked for; a leaf that one has asked for is multiplied with all."""
            nonlocal scored
            who = np.flatnonzero(asked.any(axis=0))
            rows = np.concatenate([np.arange(self.nodes["begin"][n], self.nodes["end"][n]) for n in leaves.tolist()])
            leaf = np.repeat(np.arange(len(leaves)), self.nodes["end"][leaves] - self.nodes["begin"][leaves])
            scored += len(rows) * len(who)
            found = self.vectors[rows].astype(kind) @ numbers[who].T
            first, last = (np.clip(x[who], -limit, limit).astype(kind) for x in (windows.first, windows.last))
            i, j = np.nonzero((found >= first) & (found <= last))
            rows, some = rows[i], who[j]
            kept = asked[leaf[i], some] & ((self.labels[rows] == labels[some]) == same) & (self.ids[rows] != query_ids[some])
            windows.add(some[kept], found[i[kept], j[kept]].astype(np.int64), self.ids[rows[kept]])

        level, alive, leaves, open_ = np.array([0]), np.ones((1, len(queries)), bool), [], []
        while len(level):
            one, known = self.nodes["one_label"][level], self.nodes["label"][level]
            alive = alive & (~one[:, None] | ((known[:, None] == labels) == same)) & needed(level)
            kept = alive.any(axis=1)
            level, alive = level[kept], alive[kept]
            inner = self.inner[level]
            leaves.append(level[~inner])
            open_.append(alive[~inner])
            level, alive = (self.nodes["first"][level[inner]][:, None] + np.array([0, 1])).ravel(), np.repeat(alive[inner], 2, axis=0)
        left, open_ = np.concatenate(leaves), np.concatenate(open_)
        if dive and len(left):  # the most promising leaf of each query
            best = np.where(open_, high[left], -np.inf).argmax(axis=0)
            for leaf in np.unique(best).tolist():
                who = (best == leaf) & open_[leaf]
                if who.any():
                    score(left[[leaf]], who[None])
                    open_[leaf] &= ~who
            windows.merge()
        most = np.where(open_, high[left], -np.inf).max(axis=1)
        kinds = np.where(self.nodes["one_label"][left], self.nodes["label"][left], 0) if same else np.zeros(len(left))
        order = np.lexsort((-most, kinds))
        for at in range(0, len(left), max(1, AT_ONCE // LEAF)):
            some = order[at : at + max(1, AT_ONCE // LEAF)]
            asked = open_[some] & needed(left[some])
            kept = asked.any(axis=1)
            if kept.any():
                score(left[some[kept]], asked[kept])
        windows.merge()
        return scored

    def search(self, query: np.ndarray, query_id: int, label: int, same: bool, windows: list[Window]) -> int:
        """As ``search_all`` for one query, with its windows."""
        asked = Windows(np.zeros(len(windows), np.int64), np.array([w.low for w in windows]), np.array([w.high for w in windows]), max(w.k for w in windows))
        scored = self.search_all(query[None], np.array([query_id]), np.array([label]), same, asked)
        for at, w in enumerate(windows):
            w.add(asked.score[asked.window == at], asked.id[asked.window == at])
        return scored


def index(candidates: DataFrame) -> DataFrame:
    """The written index of ``candidates`` (``id, label, vector, width, b``): each block's tree, in pieces."""

    def build(table: pa.Table) -> pa.Table:
        tree = BallTree.of(table.column("id").to_numpy(), table.column("label").to_numpy(), ib.matrix(table))
        return ib.pieces(table.column("width")[0].as_py(), table.column("b")[0].as_py(), tree.arrays())

    return written(candidates.select("id", "label", "vector", "width", "b").groupBy("width", "b").applyInArrow(build, ib.PIECES), "ball-trees")


def _search(same: bool, k: int):
    """A tile's search. Queries are rows ``id, label, vector, windows``, an array of ``tag, low, high, least``; those of one label stand together."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        tree, x = BallTree.read(y), x.sort_by("label")
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for begin in range(0, len(x), QUERIES):
            some = x.slice(begin, QUERIES)
            ids, labels, vectors = some.column("id").to_numpy(), some.column("label").to_numpy(), ib.matrix(some)
            lists = some.column("windows").combine_chunks()
            of = lists.flatten()
            tag, low, high, least = (of.field(c).to_numpy() for c in ("tag", "low", "high", "least"))
            query = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy())
            windows = Windows(query, np.maximum(low, least), high, k)
            tree.search_all(vectors, ids, labels, same, windows, dive=bool((least == ib.LOWEST).any()))
            for values, more in zip(out, (ids[query[windows.window]], tag[windows.window], windows.id, windows.score), strict=True):
                values.append(more)
        return pa.table([pa.array(np.concatenate(v), pa.int64()) for v in out], names=["query_id", "tag", "found", "score"])

    return run


def hard_negatives(anchors: DataFrame, candidates: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = ib.SCALE, index_bytes: int = ib.INDEX_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Both tables have ``id, label, vector``; other columns aren't read. Components x count as floor(scale * x), and a row's score is its integer inner
    product with the anchor; higher ones come first, equal ones by the smaller id. An anchor's positives are its first
    ``positives`` other rows (another id) of its label; for each, the negatives are the first ``negatives`` rows of other labels with
    ``low`` * positive score <= 100 * score <= ``high`` * positive score. So positives with scores below 0 have none. Rows with a null id or label, and
    vectors for which ``integers`` gives null, take no part; vectors are compared with those of their own length. Candidates with equal ids are
    separate candidates, also as positives; anchors with equal ids count as one, that with the smallest vector, then label. No
    anchors or no candidates: no rows. ``index_bytes`` bounds a block of the index.
    """

    def usable(df: DataFrame) -> DataFrame:
        columns = [F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), ib.integers(F.col("vector"), scale).alias("vector")]
        return df.select(*columns).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    dealt, blocks = ib.dealt(usable(candidates), index_bytes)
    trees = index(dealt)
    discard(dealt)
    asked = usable(anchors).groupBy("id").agg(F.min(F.struct("vector", "label")).alias("row")).select("id", "row.vector", "row.label")
    asked, query_blocks = ib.query_blocks(written(asked, "anchors"), blocks)
    schema, keys = "query_id bigint, tag bigint, found bigint, score bigint", ["query_id", "tag"]
    every = asked.select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("tag"), F.lit(ib.LOWEST).alias("low"), F.lit(ib.HIGHEST).alias("high"))
    best = written(ib.in_two_rounds(asked, query_blocks, trees, blocks, keys, positives, _search(True, positives), schema, every), "positives")

    # the window of each positive, as whole numbers; in decimals, as 95 times a score may not fit into 64 bits
    score = F.col("score").cast("decimal(20,0)")
    windows = best.select("query_id", F.col("rank").cast("long").alias("tag"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"),
                          F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high")).where("low <= high")
    windows = written(windows, "windows")
    found = ib.in_two_rounds(asked, query_blocks, trees, blocks, keys, negatives, _search(False, negatives), schema, windows.select("query_id", "tag", "low", "high"))
    named = found.join(windows.select("query_id", "tag", "positive_id", "positive_score"), keys)
    return named.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
