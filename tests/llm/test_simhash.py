import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from lexitally.llm.simhash import _resharded, build_tree, components, fingerprint, groups_within, near_duplicates, route
from tests.llm.edge import LONG, ROWS, documents, no_documents


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute(rows, radius):
    fps, sets = [plain(t) for _, t, *_ in rows], Sets()
    for i, a in enumerate(fps):
        for j in range(i):
            if bin((a ^ fps[j]) & (1 << 64) - 1).count("1") <= radius:
                sets.join(i, j)
    members = defaultdict(list)
    for i, row in enumerate(rows):
        members[sets.find(i)].append(row[0])
    names = {root: min((k for k in keys if k is not None), default=None) for root, keys in members.items()}
    return Counter((row[0], fps[i], names[sets.find(i)]) for i, row in enumerate(rows))


def copies(n, seed=4):
    """Texts of which many are others with a word or two changed."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
        else:
            words = [f"w{rng.randrange(9999)}" for _ in range(rng.randint(30, 200))]
        rows.append((n - i, " ".join(words), "en", "s", 0))
    return rows


def test_against_brute_force(spark):
    rows = copies(400)
    for radius, shard, tile in ((2, 2048, 8192), (4, 10, 40), (7, 5, 8)):
        got = Counter(map(tuple, near_duplicates(documents(spark, rows), radius=radius, shard=shard, tile=tile).collect()))
        assert got == brute(rows, radius), (radius, shard, tile)
    assert len({c for _, _, c in brute(rows, 4)}) < 390


def test_large_shards_get_trees_of_their_own(spark):
    """A first tree that cuts nothing: all points are one shard, larger than a tile."""
    rows = copies(500, 9)
    fps = sorted({plain(t) for _, t, *_ in rows})
    points = spark.createDataFrame([(0, f, i) for i, f in enumerate(fps)], "shard long, fp long, first_id long")
    cut = _resharded(points, 3, 20, 50)
    assert cut.select("sub").distinct().count() > 5
    at = defaultdict(set)
    for r in cut.collect():
        at[r.fp].add((r.shard, r["sub"]))
    assert set(at) == set(fps)
    for i, a in enumerate(fps):
        assert all(at[a] & at[b] for b in fps[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    assert _resharded(points, 3, 20, 5000).select("sub").distinct().count() == 1


def test_edge_rows(spark):
    got = Counter(map(tuple, near_duplicates(documents(spark)).collect()))
    assert got == brute(ROWS, 2)
    assert near_duplicates(no_documents(spark)).collect() == []
    assert fingerprint(LONG.encode()) == plain(LONG)


def test_hot_fingerprint(spark):
    rows = [(i, "same text in a third of all rows", "en", "s", 0) if i % 3 else (i, f"other {i} text of row {i * 7}", "en", "s", 0) for i in range(1500)]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows)).collect()}
    assert len(got) == 1500 and all(got[i] == 1 for i in range(1500) if i % 3)


def test_route_loses_no_pair():
    rng = np.random.default_rng(1)
    centers = rng.integers(0, 2**63, 60, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for c in centers]))
    for radius in (1, 2, 5):
        nodes = build_tree(points[::3], len(points), radius, shard=30)
        assert len(nodes) > 5
        at = [set() for _ in points]
        for shard, members in route(nodes, points, radius):
            for m in members:
                at[m].add(shard)
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
        assert all(at[i] & at[j] for i, j in zip(*np.nonzero(near), strict=True))


def test_groups_within():
    points = np.array([0, 1, 3, 7, 15, 3 << 40, 15 << 40, 2**64 - 1], np.uint64)
    assert groups_within(points, 1).tolist() == [0, 0, 0, 0, 0, 5, 6, 7]
    assert groups_within(points, 2).tolist() == [0, 0, 0, 0, 0, 0, 0, 7]


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(200)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: sets.find(n) for n in list(sets) if sets.find(n) != n}
