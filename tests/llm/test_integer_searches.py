"""The impact-ordered index and the ball trees, against loops over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitally.llm import hard_negatives as negatives
from lexitally.llm import impact_index
from lexitally.llm import integer_blocks as ib
from lexitally.llm.hard_negatives import BallTree, Window, hard_negatives
from lexitally.llm.impact_index import Postings, largest_products
from tests.llm.edge import CLASHING

BAD = [None, [1.0, None, 1.0, 1.0], [math.nan] + [1.0] * 3, [math.inf] + [1.0] * 3, [1e300] * 4]


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector) or sum((abs(256 * x) + 1) * (abs(256 * x) + 1) for x in vector) >= 2**62:
        return None
    return [math.floor(256 * x) for x in vector]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def ordered(query, query_id, rows):
    """``(score, id, label)`` of all rows of another id, best first."""
    found = [(-product(query, v), i, label) for i, label, v in rows if i != query_id and len(v) == len(query)]
    return [(-s, i, label) for s, i, label in sorted(found)]


def brute_products(rows, queries, k):
    rows, queries = ([(i, label, w) for i, label, v in some if i is not None and (w := whole(v)) is not None] for some in (rows, queries))
    return sorted((q, rank, i, s) for q, _, v in queries for rank, (s, i, _) in enumerate(ordered(v, q, rows)[:k], 1))


def brute_negatives(rows, anchors, positives, negatives, low, high):
    rows, anchors = ([(i, label, w) for i, label, v in some if i is not None and label is not None and (w := whole(v)) is not None] for some in (rows, anchors))
    out = []
    for a, mine, v in anchors:
        found = ordered(v, a, rows)
        for p, pos, _ in [f for f in found if f[2] == mine][:positives]:
            inside = [f for f in found if f[2] != mine and low * p <= 100 * f[0] <= high * p]
            out += [(a, pos, rank, i, p, s) for rank, (s, i, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, label bigint, vector array<double>")
    taken = {"score", "vector", "found", "label", "id"}
    return df.withColumns({f"`{c}`" if "." in c else c: F.lit(1) for c in (*CLASHING, "place", "width", "b", "a", "low") if c not in taken and "`" not in c})


def some_rows(seed, n=240):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 1, 2, 3]), [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.7, 1.0]) for _ in range(4)]) for i in range(1, n)]
    rows += [(1000 + i, 1, [0.5, 0.5, -0.25, 1.0]) for i in range(120)]  # one very common vector
    rows += [(2000 + i, i % 2, [rng.gauss(0, 1) for _ in range(3)]) for i in range(4)] + [(2100, 1, []), (2101, 1, []), (2102, 2, [])]
    rows += [(3000 + i, i % 2, [0.0] * 4) for i in range(3)]
    return rows + [(4000 + i, 0, v) for i, v in enumerate(BAD)] + [(None, 1, [9.0] * 4), (5000, None, [0.5] * 4), (77, 1, [1.0] * 4)]


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_products(spark, block, monkeypatch):
    monkeypatch.setattr(impact_index, "MEMBERS", 1)
    monkeypatch.setattr(impact_index, "LOOKS", 40)
    rows = some_rows(1)
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = largest_products(table(spark, queries + queries[:3]), table(spark, rows), 5, index_bytes=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_products(rows, queries, 5)


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_negatives(spark, block):
    rows = some_rows(2)
    anchors = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = hard_negatives(table(spark, anchors + anchors[:3]), table(spark, rows), index_bytes=block)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, anchors, 5, 3, 50, 95) != []


def test_nothing_to_search(spark):
    rows = table(spark, some_rows(3)[:30])
    none = rows.where("false")
    for search in (largest_products, hard_negatives):
        assert search(none, rows).collect() == [] and search(rows, none).collect() == [] and search(none, none).collect() == []
    alone = rows.where("id = 7")
    assert largest_products(alone, alone).collect() == [] and hard_negatives(alone, alone).collect() == []


@pytest.mark.parametrize("size", [1, 1 << 10, 1 << 24, 1 << 29])
def test_scores_beyond_doubles(size):
    """Integers whose products are exact in 64 bits only, and those for which sums of bounds aren't."""
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size + 1, (300, 4))
    ids = rng.permutation(300)
    postings, tree = Postings.of(ids, x), BallTree.of(ids, ids % 3, x, 8)
    again = BallTree(tree.ids, tree.labels, tree.vectors, tree.nodes, tree.centres)
    for q in range(0, 300, 17):
        score = [int(product(map(int, x[q]), map(int, y))) for y in x]
        want = sorted((-s, int(i)) for s, i in zip(score, ids, strict=True) if i != ids[q])
        for found, scores in postings.best(x[[q, q]], ids[[q, q]], 5, np.array([-(1 << 63), want[4][0] * -1])):
            assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == want[:5]
        window = Window(-(1 << 63), want[40][0] * -1, -(1 << 63), 5)
        again.search(x[q], int(ids[q]), int(ids[q] % 3), True, [window])
        same = [w for w in want if w[1] % 3 == ids[q] % 3 and w[0] >= want[40][0]]
        assert sorted((-s, -i) for s, i in window.heap) == same[:5]


def test_accumulation_stops_on_proof():
    """Few rows have large components: the rest is proven out before its segments are added."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 8, (6400, 6))
    x[rng.choice(6400, 30, replace=False)] += rng.integers(800, 1600, (30, 6))
    postings = Postings.of(np.arange(6400), x)
    queries = np.array([[3, 1, 4, 1, 5, 9], [-2, 7, 1, 8, 2, 8]])
    members = postings.possible(queries, np.zeros((6400, 2), bool), 5, np.full(2, -(1 << 61)))
    for some, query in zip(members.T, queries, strict=True):
        assert some.sum() <= 100 and some[np.argsort(-(x @ query))[:5]].all()


def test_trees_pass_over_rows():
    """Clusters apart: a search scores few of the rows, for its label and for the window of a positive."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-3000, 3000, (64, 8))
    x = centres[np.arange(6400) % 64] + rng.integers(-20, 20, (6400, 8))
    tree = BallTree.of(np.arange(6400), np.arange(6400) % 64 // 8, x)
    q, scored = x[11], []
    for same, low, high in ((True, -(1 << 63), (1 << 63) - 1), (False, 1_000_000, 2_000_000)):
        window = Window(low, high, -(1 << 63), 5)
        scored.append(tree.search(q, 11, 1, same, [window]))
        score = x @ q
        labels = np.arange(6400) % 64 // 8
        inside = np.flatnonzero(((labels == 1) == same) & (np.arange(6400) != 11) & (score >= low) & (score <= high))
        want = sorted(zip((-score[inside]).tolist(), inside.tolist(), strict=True))[:5]
        assert sorted((-s, -i) for s, i in window.heap) == want
    assert scored[0] < 1000 and scored[1] < 3200


def many(spark, n=20_000, width=64):
    """Vectors that fill a block, in a table as ``dealt`` takes it."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(513)) - 256)
    return spark.range(n).select("id", F.pmod("id", F.lit(3)).alias("label"), vector.cast("array<bigint>").alias("vector"))


def test_postings_in_small_pieces(spark, monkeypatch):
    """No row of the index is large, however many vectors a block holds: Spark copies, sorts and sends rows as a whole."""
    monkeypatch.setattr(ib, "LEAST_ROWS", 1 << 30)
    dealt, blocks = ib.dealt(many(spark))
    assert blocks == 1
    rows = impact_index.index(dealt)
    assert rows.agg(F.max(F.length("piece"))).first()[0] <= ib.PIECE < rows.agg(F.sum(F.length("piece"))).first()[0]
    again, want = Postings.read(rows.toArrow()), {r.id: r.vector for r in many(spark).where("id < 100").collect()}
    assert sorted(again.ids.tolist()) == list(range(20_000)) and again.vectors.dtype == np.int16
    for i, v in zip(again.ids.tolist(), again.vectors, strict=True):
        assert i >= 100 or v.tolist() == want[i]


def test_few_copies_of_the_index(spark):
    """The index is sent once for each block of queries: with a tile for each task, more blocks would only be more copies."""
    queries = many(spark, 600, 4)
    assert [ib.query_blocks(queries, blocks)[1] for blocks in (1, 2, 4, 40)] == [4, 2, 1, 1]
    assert ib.query_blocks(queries, 40, 600 * 4 * 8 // 3)[1] == 3
    assert dict(ib.query_blocks(queries, 1)[0].dtypes)["vector"] == "array<smallint>"


@pytest.mark.parametrize("seed", range(4))
def test_sums_in_16_bits(seed, monkeypatch):
    """Accumulators in units, all rows at once or segment by segment, lose no member."""
    rng = np.random.default_rng(seed)
    size = [3, 500, 1 << 14, 1 << 20][seed]
    x = np.rint(rng.laplace(0, size, (3000, 5)) * rng.choice([1, 1, 20], (3000, 1))).astype(np.int32)
    ids, q = np.arange(3000), x[:40]
    scores = x.astype(np.int64) @ q.T.astype(np.int64)
    np.fill_diagonal(scores[:40], -(1 << 62))
    fifth = np.sort(scores, axis=0)[-5]
    postings = Postings.of(ids, x)
    for sample in (1, 128, 3000):
        monkeypatch.setattr(impact_index, "SAMPLE", sample)
        for least in (np.full(40, -(1 << 63)), fifth, fifth // 2):
            got = list(postings.best(q, ids[:40], 5, least))
            for at, (found, score) in enumerate(got):
                want = sorted((-s, i) for i, s in enumerate(scores[:, at].tolist()) if i != at)[:5]
                assert list(zip((-score).tolist(), found.tolist(), strict=True)) == want


def test_trees_in_small_pieces(spark, monkeypatch):
    """As the postings: no row is large, and pieces give the tree back."""
    monkeypatch.setattr(ib, "LEAST_ROWS", 1 << 30)
    dealt, _ = ib.dealt(many(spark))
    rows = negatives.index(dealt)
    assert rows.agg(F.max(F.length("piece"))).first()[0] <= ib.PIECE < rows.agg(F.sum(F.length("piece"))).first()[0]
    again, want = BallTree.read(rows.toArrow()), {r.id: (r.label, r.vector) for r in many(spark).where("id < 100").collect()}
    assert sorted(again.ids.tolist()) == list(range(20_000)) and again.vectors.dtype == np.int16
    for i, label, v in zip(again.ids.tolist(), again.labels.tolist(), again.vectors, strict=True):
        assert i >= 100 or (label, v.tolist()) == want[i]
    assert again.nodes["end"][0] == 20_000 and len(again.centres) == len(again.nodes)


def test_labels_apart():
    """Labels are cut apart first, so a search for positives scores hardly more than its label's rows, even where bounds leave out nothing."""
    rng = np.random.default_rng(7)
    x, labels = rng.normal(0, 32, (4000, 32)).astype(np.int16), rng.integers(0, 5, 4000)
    tree = BallTree.of(np.arange(4000), labels, x)
    assert tree.nodes["one_label"][~tree.inner].all()
    alone = BallTree.of(np.arange(4000), np.arange(4000), x)  # too many labels to be cut apart: by place, as before
    assert len(alone.nodes) == len(BallTree.of(np.arange(4000), np.zeros(4000, int), x).nodes)
    windows = negatives.Windows(np.arange(50), np.full(50, -(1 << 63)), np.full(50, (1 << 63) - 1), 5)
    assert tree.search_all(x[:50], np.arange(50), labels[:50], True, windows) < 50 * 4000 / 4


@pytest.mark.parametrize("size", [20, 3000, 1 << 29])
def test_queries_together(size):
    """Queries that go through a tree together find what a loop finds, with windows of their own."""
    rng = np.random.default_rng(size)
    for trial in range(10):
        n = int(rng.integers(1, 400))
        x, ids, labels = rng.integers(-size, size, (n, 3)), rng.permutation(n), rng.integers(0, 4, n)
        tree = BallTree.of(ids, labels, x, 8)
        queries, mine = rng.integers(-size, size, (7, 3)), rng.integers(0, 4, 7)
        of = np.sort(np.r_[np.arange(7), rng.integers(0, 7, 9)])
        low = rng.integers(-size * size, size * size, len(of))
        high = low + rng.integers(0, 2 * size * size, len(of))
        scores = x @ queries.T
        for same in (True, False):
            for dive in (True, False):
                windows = negatives.Windows(of, low, high, 3)
                tree.search_all(queries, np.arange(7), mine, same, windows, dive)
                want = []
                for w, q in enumerate(of.tolist()):
                    fits = (scores[:, q] >= low[w]) & (scores[:, q] <= high[w]) & ((labels == mine[q]) == same) & (ids != q)
                    want += sorted((w, -int(s), int(i)) for s, i in zip(scores[fits, q], ids[fits], strict=True))[:3]
                assert sorted(zip(windows.window.tolist(), (-windows.score).tolist(), windows.id.tolist(), strict=True)) == want, trial
