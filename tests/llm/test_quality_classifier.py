import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from lexitally.llm.quality_classifier import BITS, MOST_FEATURES, Features, Likelihood, fit, grade, keep_graded, packed, ratings_of, train, unpacked
from tests.llm.edge import ROWS, documents, no_documents

SF = "/root/testdata/sf0.01"


def shares(spark, sf):
    docs, labels = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    model = train(docs, ratings_of(labels.where("doc_id % 3 <> 0")), 2)
    assert model.thresholds[0] < model.thresholds[1]
    held = grade(docs, model, 2, 0.4).join(ratings_of(labels.where("doc_id % 3 = 0")), "doc_id").select("grade", "kept").collect()
    return [np.mean([r.kept for r in held if r.grade == g]) for g in range(3)]


def test_held_out_accuracy(spark):
    junk, _, clean = shares(spark, "sf0.01")  # with 19 toxic texts to learn from
    assert clean >= 0.95 and junk <= 0.1
    junk, toxic, clean = shares(spark, "sf0.1")
    assert clean >= 0.99 and junk <= 0.02 and toxic <= 0.65  # of 0.2 with all labels of a large table


def test_grades_are_ordered():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 4, 600)
    rows = [np.unique(np.r_[np.arange(g), rng.integers(100, 140, 6)]).astype(np.int32) for g in truth]
    model = fit(rows, truth, np.ones(600), 3)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(np.array([model.weights[r].sum() for r in rows]))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.mean(np.rint(tails.sum(axis=1)) == truth) > 0.97


def test_gradient_is_the_likelihoods():
    """One grade boundary is logistic regression: compare with its optimum on one binary feature."""
    grades = np.array([0] * 30 + [1] * 10 + [0] * 10 + [1] * 30)
    rows = [np.array([7], np.int32)] * 40 + [np.array([9], np.int32)] * 40
    model = fit(rows, grades, np.ones(80), 1)
    p = model.tails(np.array([model.weights[7], model.weights[9]], float))[:, 0]
    assert np.allclose(p, [0.25, 0.75], atol=0.03)


def test_gradient_against_differences():
    rng = np.random.default_rng(6)
    rows = [np.flatnonzero(rng.random(9) < 0.4) for _ in range(30)]
    model = Likelihood(rows, 9, rng.integers(0, 4, 30), rng.random(30) + 0.5, 3)
    value = rng.normal(size=12)
    loss, gradient = model.at(value)
    # the loss from its definition
    cuts = np.cumsum(np.r_[value[9], np.exp(value[10:])])
    whole = 0.0
    for row, g, w in zip(rows, model.grades, model.weight, strict=True):
        tails = [1.0, *(1 / (1 + math.exp(c - value[row].sum())) for c in cuts), 0.0]
        whole -= w * math.log(tails[g] - tails[g + 1])
    assert math.isclose(loss, whole + 0.5 / 30 / 2 * (value[:9] ** 2).sum(), rel_tol=1e-9)
    for i in range(12):
        step = np.eye(12)[i] * 1e-5
        assert math.isclose(gradient[i], (model.at(value + step)[0] - model.at(value - step)[0]) / 2e-5, rel_tol=1e-4, abs_tol=1e-8)


def test_packing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2047, 2048, 2049, 32768):
        places = np.sort(rng.choice(MOST_FEATURES, n, replace=False))
        assert len(packed(places)) <= 1 + MOST_FEATURES // 8 and (unpacked(packed(places)) == places).all()


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(("__text", "row", "tail", "a.b", "__kept"))])
    model = train(df, spark.createDataFrame([(1, 2)], "doc_id long, grade int"), 2)
    assert keep_graded(df, model, 2).columns == df.columns and keep_graded(df, model, 2).first()["a.b"] == 3
    assert grade(df, model, 2).columns == [*df.columns, "expected_grade", "tail_probability", "kept"]


def test_features():
    f = Features()
    a, b = set(f.of(b"The cat sat.").tolist()), set(f.of(b"the CAT, sat").tolist())
    assert {f.number(b"wcat"), f.number(b"wsat"), f.number(b"bthe")} <= a & b
    assert len(f.of(b"")) == 0 and len(f.of(b"a a a")) == len(set(f.of(b"a a a").tolist()))


def test_edge_rows(spark):
    df = documents(spark)
    ratings = spark.createDataFrame([(1, 0), (3, 2), (4, 1), (4, 2), (6, None), (None, 1), (99, 2)], "doc_id bigint, grade int")
    for model in (train(df, ratings, 2), train(df, ratings.where("false"), 2), train(no_documents(spark), ratings, 2)):
        got = grade(df, model, 2)
        assert set(got.columns) == set(df.columns) | {"expected_grade", "tail_probability", "kept"}
        assert all(0 <= r.expected_grade <= 2 and r.kept == (r.tail_probability >= 0.5) for r in got.collect()) and got.count() == len(ROWS)
        kept = keep_graded(df, model, 2)
        assert kept.columns == df.columns
        assert kept.count() == sum(r.kept for r in got.collect())
    assert grade(no_documents(spark), model, 2).collect() == []
    assert keep_graded(df, train(df, ratings.where("false"), 2), 2).count() == len(ROWS)  # nothing known: all stay


def test_reruns_agree(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one, two = (train(d, ratings_of(labels), 2) for d in (docs, docs.repartition(5)))
    assert (one.weights == two.weights).all()


def from_the_text(text, model):
    """Expected grade and the tails, from the definition of the features."""
    words, mask = text.split(), (1 << BITS) - 1
    number = lambda feature: zlib.crc32(feature) & mask
    edge, found, shapes = b".,;:!?\"'()[]|*#$%&<>-", set(), []
    for word in words:
        bare = word.strip(edge).lower()
        found |= {number(b"w" + bare), number(b"b" + bare[:4])}
        classes = [b"X" if 65 <= b <= 90 else b"x" if 97 <= b <= 122 or b >= 128 else b"9" if 48 <= b <= 57 else bytes([b]) for b in word]
        shapes.append(b"".join(c for i, c in enumerate(classes) if c not in (b"X", b"x", b"9") or i == 0 or c != classes[i - 1])[-8:])
    for shape in set(shapes):
        found |= {number(b"s%d " % k + shape) for k in (1, 2, 4, 8, 16, 32) if shapes.count(shape) * k >= len(words)}
    same = sum(words[i] == words[i - 1] for i in range(1, len(words)))
    found |= {number(b"r%d" % part) for part in range(1, 9) if 10 * same >= part * max(1, len(words))}
    score = sum(float(model.weights[f]) for f in found)
    tails = [1 / (1 + math.exp(min(50, max(-50, float(c) - score)))) for c in model.thresholds]
    return sum(tails), tails


def test_whole_result_from_the_text(spark):
    """Every row of the query's table, each recomputed from text, weights and thresholds."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, ratings_of(labels), 2)
    for df in (docs.select("doc_id", "text"), documents(spark)):
        got = grade(df, model, 2, 0.4).collect()
        assert len(got) == df.count()
        for r in got:
            expected, tails = from_the_text((r.text or "").encode(), model)
            assert math.isclose(r.expected_grade, expected, abs_tol=1e-4) and math.isclose(r.tail_probability, tails[1], abs_tol=1e-4)
            assert r.kept == (r.tail_probability >= 0.4)
