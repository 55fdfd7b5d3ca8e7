import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexitally.llm import nearest as nearest_module
from lexitally.llm.nearest import Codes, bounds, nearest


def brute(rows, queries, k):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def product(a, b):
        out = 0.0
        for x, y in zip(a, b, strict=True):
            out += x * y
        return out

    out = []
    for key, v in sorted(queries):
        found = [(-product(v, w), other) for other, w in rows if other is not None and other != key and usable(w) and len(w) == len(v)]
        out += [(key, rank, other, -s) for rank, (s, other) in enumerate(sorted(found)[:k], 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vector array<double>")


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-2.0, -1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(1, 300)]
    rows += [(300 + i, [1.0, 1.0, 0.5, 0.0, -1.0, 2.0]) for i in range(150)]  # one very common vector
    rows += [(500 + i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(9)]  # fewer than k
    bad = [(601, None), (602, [0.0] * 6), (603, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (604, [math.nan] + [1.0] * 5), (605, [math.inf] + [1.0] * 5), (606, []), (None, [9.0] * 6)]
    rows = [r for r in rows if any(r[1])]
    queries = [r for r in rows if r[0] % 20 == 0]
    for blocks in ((None, None), (5, 37)):
        got = nearest(table(spark, queries + bad), table(spark, rows + bad), 20, *blocks).collect()
        assert sorted(map(tuple, got)) == sorted((q, r, v, s) for q, r, v, s in brute(rows, queries, 20))


def test_repeated_rows_and_empty(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [0.5, 0.5])]
    got = [tuple(r) for r in nearest(table(spark, [rows[0], rows[0]]), table(spark, rows), 3).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 5.0), (1, 2, 2, 5.0), (1, 3, 3, 1.5)]
    none = table(spark, rows).where("false")
    assert nearest(none, table(spark, rows)).collect() == [] and nearest(table(spark, rows), none).collect() == []


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1.0]), (2, [1e200, 2.0]), (3, [1e-200, -1e-300]), (4, [1.0, 1.0]), (5, [-1e200, 1e200]), (6, [5e-324, 0.0]), (7, [1e308, 1e308])]
    rows = [(r[0], r[1]) for r in rows]
    got = nearest(table(spark, rows), table(spark, rows), 20).collect()
    expected = set()
    for q, v in rows:
        found = [(v[0] * w[0] + v[1] * w[1], i) for i, w in rows if i != q]
        order = sorted(found, key=lambda f: (-f[0] if f[0] == f[0] else math.inf, f[1]))
        expected |= {(q, rank, i, repr(s)) for rank, (s, i) in enumerate(order, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, repr(r.score)) for r in got} == expected and len(got) == 42


def test_short_vectors_are_passed_over(spark):
    """Blocks by norm: queries only go to those that could reach their k-th score, and rows grow with the queries."""
    rng = np.random.default_rng(3)
    sizes = []
    for n in (400, 1600):
        rows = [(i, (rng.normal(size=5) * 2.0 ** -(i % 40)).tolist()) for i in range(1, n)]
        df = table(spark, rows)
        made, kept = [], nearest_module._tiles

        def tiles(left, right, k, made=made, kept=kept):
            made.append((left.count(), kept(left, right, k).count(), left.where("b = 0").count()))
            return kept(left, right, k)

        nearest_module._tiles = tiles
        try:
            got = nearest(df.where("id % 20 = 0"), df, 5, 16, n // 20).collect()
        finally:
            nearest_module._tiles = kept
        assert sorted(map(tuple, got)) == sorted(brute(rows, [r for r in rows if r[0] % 20 == 0], 5))
        queries = made[0][0]
        assert made[1][0] <= 12 * queries  # of 20 blocks
        assert made[1][2] == 0  # the first block is met once
        sizes.append(made[1][1] / queries)
    assert sizes[1] <= sizes[0]  # rows before the rank, a query


def test_one_block_is_one_round(spark, monkeypatch):
    made, kept = [], nearest_module._tiles
    monkeypatch.setattr(nearest_module, "_tiles", lambda *args: made.append(args[0].count()) or kept(*args))
    rows = [(i, [float(i), 1.0]) for i in range(1, 101)]
    got = nearest(table(spark, rows[::20]), table(spark, rows), 3)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, rows[::20], 3)) and made == [5]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 70), st.sampled_from([1e-30, 1e-3, 1.0, 1e20]))
def test_bounds_hold(seed, width, scale):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(7, width)) * scale, rng.normal(size=(9, width)) * rng.choice([1e-3, 1, 50], size=(9, 1))
    lower, upper = bounds(Codes(x), slice(0, 7), Codes(y), slice(0, 9))
    true = x @ y.T
    assert (lower <= true).all() and (true <= upper).all()
