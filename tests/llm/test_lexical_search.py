import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexitally.llm import lexical_search
from lexitally.llm.lexical_search import accumulated, radix_order, search, terms
from tests.llm.edge import LONG, ROWS, documents, no_documents

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text):
    return PATTERN.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    """``item_id, rank, doc_id, score`` by a loop over all pairs."""
    kept = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(kept), sum(c.total() for _, c in kept)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for doc_id, counts in kept:
            n, score = counts.total(), 0
            for t, times in Counter(words(text)).items():
                if tf := counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in kept) + 1)))
                    score += times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def table(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} bigint, text string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"PIECE": 3, "RANGE": 2, "POSTINGS": 5}, {"ITEM_BYTES": 1}])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(4)
    vocabulary = ["a", "B", "the", "The", "x9", "é", "É", "日本", "İ", "K", "zz"]
    docs = [(rng.choice([i, i // 3, None]), rng.choice([" ", "-", "_", "\n", "\0"]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(7, None), (8, "the zz zz"), (8, "the zz zz"), (9, ""), (10, LONG)]
    items = [(i // 2, " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))) for i in range(12)] + [(None, "zz"), (3, None), (4, "zz zz the"), (4, "zz zz the"), (5, "unheard"), (6, "")]
    found = search(table(spark, docs, "doc_id").repartition(3), table(spark, items, "item_id"), 7, item_bytes=sizes.get("ITEM_BYTES", 1 << 20))
    assert got(found) == brute(docs, items, 7)


def test_edge_rows(spark):
    items = [(1, "one two"), (2, "lorem IPSUM"), (3, "x" * 30_000), (4, "endoftext A 日本語 \U0001f600"), (None, "one two")]
    df = table(spark, items, "item_id").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("s"))
    assert got(search(documents(spark), df, 20)) == brute([r[:2] for r in ROWS], items, 20)
    assert search(no_documents(spark), df).collect() == [] and search(documents(spark), df.where("false")).collect() == []
    wordless = table(spark, [(1, ".,"), (2, None)], "doc_id")
    assert search(wordless, df).collect() == [] and search(documents(spark), wordless.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_bytes_that_are_no_text(spark):
    raw = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'a b'")
    item = spark.sql("SELECT 1L AS item_id, CAST(X'41FF62' AS STRING) AS text")
    assert [r.doc_id for r in search(raw, item).collect()] == [1]


def test_terms():
    for text in ("", "ab", "  ab--CD é", "İK\x85\xa0x"):
        assert [w.decode() for some in terms(text.encode()) for w in some] == words(text)


def test_ties_go_by_id_across_tasks(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(900 + i, "others entirely") for i in range(600)]
    found = search(table(spark, docs, "doc_id").repartition(16), table(spark, [(1, "same")], "item_id"), 20).orderBy("rank").collect()
    assert [r.doc_id for r in found] == list(range(1, 21))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40), st.integers(-5, 2**40)), max_size=200))
def test_sums_of_sorted_keys(pairs):
    keys, values = np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs], np.int64)
    assert (radix_order(keys, 41) == np.argsort(keys, kind="stable")).all()
    want = Counter()
    for k, v in pairs:
        want[k] += v
    got_keys, sums = accumulated(keys, values, 41)
    assert list(zip(got_keys.tolist(), sums.tolist(), strict=True)) == sorted(want.items())
