import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexitally.llm import near_copies
from lexitally.llm.near_copies import Shingles, drop_near_copies, leeway, similar, sketch
from tests.llm.edge import ROWS, documents, no_documents
from tests.llm.test_simhash import Sets


def edited(n, seed=3):
    """Texts of which many are others with some words changed, below a common line; ids repeat."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, len(words) // 40)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
        else:
            words = [f"common{i}" for i in range(20)] + [f"w{rng.randrange(9999)}" for _ in range(rng.randint(2, 200))]
        rows.append((rng.choice([None, *range(n)]), " ".join(words), "en", "s", 0))
    return rows


def shingles(text):
    words = text.lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def close(a, b):
    return len(a & b) * 10 >= len(a | b) * 8


def brute(rows):
    """Ids and texts that stay, as a set of possible ones for each group."""
    sets, of = Sets(), [shingles((t or "").encode()) for _, t, *_ in rows]
    for i, a in enumerate(of):
        for j in range(i):
            if close(a, of[j]):
                sets.join(i, j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(sets.find(i), []).append(r)
    least = [min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()]
    return Counter(least), list(groups.values())


def check(got, rows):
    ids, groups = brute(rows)
    assert Counter(r.doc_id for r in got) == ids
    texts = Counter(r.text for r in got)
    assert all(sum(texts[t] for t in {r[1] for r in g}) == 1 for g in groups)


def test_stage_against_brute_force(spark):
    """The pipeline's stage; with two bits of a fingerprint most near copies stayed."""
    rows = edited(400)
    assert len(brute(rows)[1]) < 250
    check(corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect(), rows)


def test_any_order_finds_all(spark, monkeypatch):
    rows = edited(250, 8)
    monkeypatch.setattr(near_copies, "SEEN", 10**9)
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    check(drop_near_copies(documents(spark, rows), radius=0).collect(), rows)


def test_shingles(monkeypatch):
    hashes, rng = Shingles(), random.Random(1)
    texts = [rng.choice(" \n\x0b").join(rng.choices(["a", "b", "cd", "dc", "E" * 300], k=rng.randint(0, 40))).encode() for _ in range(200)]
    one_by_one = [hashes.of(t).tolist() for t in texts]
    for piece in (1, 7, 100, 5000, 1 << 20):
        monkeypatch.setattr(near_copies, "PIECE", piece)
        assert [x.tolist() for x in hashes.of_each(texts)] == one_by_one
    for a, b in zip(texts, texts[1:], strict=False):
        assert len(hashes.of(a)) == len(shingles(a))
        assert len({*hashes.of(a).tolist()} & {*hashes.of(b).tolist()}) == len(shingles(a) & shingles(b))
        for least in (0.05, 0.2, 0.8):
            x, y = shingles(a), shingles(b)
            assert similar(hashes.of(a), hashes.of(b), least) == (len(x & y) >= least * len(x | y))


def test_unrelated_texts_of_one_id_stay(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(0, b), (1, b), (1, a), (1, a.replace("a39", "x"))]
    got = drop_near_copies(spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumn("a.row", F.lit(1)).coalesce(1))
    assert got.columns == ["doc_id", "text", "a.row"]
    assert sorted(map(tuple, got.collect())) == [(0, b, 1), (1, a, 1)]


def test_one_group_of_near_copies_and_a_stranger(spark):
    """All share their first shingles: the stranger meets the group, the group's members don't meet each other again."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:i % 80], f"x{i}", *words[i % 80 + 1 :]]), "en", "s", 0) for i in range(300)]
    rows.append((999, " ".join(words[:60] + [f"y{i}" for i in range(200)]), "en", "s", 0))
    check(drop_near_copies(documents(spark, rows)).collect(), rows)


def test_few_pairs_meet_on_their_texts(spark, monkeypatch):
    """A group of texts that share many shingles, most of them not similar, and one of near copies without a common original."""
    rng, pairs, confirmed = random.Random(5), [], near_copies._confirmed
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(240):
        some, changes = list(words), (9, 2)[i % 2]
        for at in rng.sample(range(60), changes):
            some[at] = f"x{i}-{at}"
        rows.append((i, " ".join([f"p{i % 2}-{k}" for k in range(40)] + some), "en", "s", 0))

    def counted(candidates, *rest):
        pairs.append(candidates.count())
        return confirmed(candidates, *rest)

    monkeypatch.setattr(near_copies, "_confirmed", counted)
    check(drop_near_copies(documents(spark, rows)).collect(), rows)
    assert sum(pairs) < 4 * len(rows)


def test_sketches_refuse_no_similar_pair():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 300, 5000):
        for kept in (0.5, 0.7, 0.85, 0.89, 0.9, 1):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.unique(np.concatenate([a[: round(kept * n)], rng.integers(0, 1 << 63, n - round(kept * n) + n // 9, dtype=np.uint64)]))
            a = np.unique(a)
            for most in (0, 1 << 12):
                may = leeway([sketch(a, most), sketch(b, most)], np.array([0]), np.array([1]), 0.8)[0] >= 0
                assert may or not similar(a, b)
                assert not may or kept >= 0.7 or n < 64 or n > most > 0


def test_only_named_texts_are_sent(spark):
    nums = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, 1 << 33, (1 << 33) + 5, 3 << 33]
    texts = spark.createDataFrame([(n, str(n)) for n in nums], "num long, text string")
    for named in ([0, 1], [8, 32769, 65536], [32768, (1 << 33) + 5], [nums[-1]], nums):
        pairs = spark.createDataFrame([(x, named[-1]) for x in named], "a long, b long")
        assert sorted(r.num for r in near_copies._named_in(pairs, texts).collect()) == named
    assert near_copies._named_in(pairs.where("false"), texts).collect() == []


def test_links_are_contracted(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(300)] + [(900, 500), (700, 900), (5, 5)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {(i, 0) for i in range(1, 301)} | {(700, 500), (900, 500)}
    assert {tuple(r) for r in near_copies.grouped(links).collect()} == want
    monkeypatch.setattr(near_copies, "NODES", 10)  # more than a task finishes
    assert {tuple(r) for r in near_copies.grouped(links).collect()} == want
    assert near_copies.grouped(links.where("false")).collect() == []


def test_tiles_are_bounded(spark, monkeypatch):
    """20,000 texts with some shingles in common, and pairs handed on in classes: no tile holds more rows than its bound, and none gets lost."""
    sizes, meetings = [], near_copies._meetings

    def measured(left, right, *rest):
        sizes.append(left.unionByName(right).groupBy("tile").count().agg({"count": "max"}).first()[0] or 0)
        return meetings(left, right, *rest)

    monkeypatch.setattr(near_copies, "_meetings", measured)
    monkeypatch.setattr(near_copies, "SEEN", 10**9)  # a frequent shingle isn't put last
    rows = [(i, f"a b c d e f g w{i} x{i}", "en", "s", 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert drop_near_copies(df).count() == 20_000
    assert 2048 < max(sizes) <= near_copies.TILE
    with monkeypatch.context() as patch:
        for name, value in (("HANDED", 3), ("OWN_TILE", 20), ("BLOCK", 30), ("COPY", 2)):
            patch.setattr(near_copies, name, value)
        some = edited(250, 8)
        sizes.clear()
        check(drop_near_copies(documents(spark, some), radius=0).collect(), some)
        assert len(sizes) > 2


def test_edge_rows(spark):
    df = documents(spark)
    got = drop_near_copies(df)
    assert got.columns == df.columns
    check(got.collect(), ROWS)
    assert drop_near_copies(no_documents(spark)).collect() == []
    bytes_ = spark.sql("SELECT 1L AS doc_id, CAST(x AS STRING) AS text FROM VALUES (X'61FF62'), (X'41FF6220'), (X'61FE62'), (X'61FF62') AS t(x)")
    assert drop_near_copies(bytes_).count() == 2
