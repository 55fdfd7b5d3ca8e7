"""The registered queries: columns of the contracts, and results against DuckDB or other rules."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lexitally.llm.queries import ORACLES, QUERIES, rule_labels
from tests.llm.edge import broken_text, documents, no_documents

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    2: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    3: "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    4: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    5: "query_id bigint, rank int, vec_id bigint, score double",
    6: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    7: "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    8: "page_id bigint, host string, path string, rule string, verdict string",
    9: "doc_id bigint, fingerprint string, component_id bigint",
    10: "doc_id bigint, expected_grade double, tail_probability double, kept boolean",
    11: "item_id bigint, rank int, doc_id bigint, score bigint",
    12: "query_id bigint, rank int, vec_id bigint, score bigint",
    13: "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}
#: What asks, each so-manieth row of it, and how many rows each may get.
SEARCHES = {
    "op5_block_matrix_neighbours": ("embeddings", 20, 20, 20),
    "op11_sort_based_search": ("benchmark", 1, 20, 20),
    "op12_impact_ordered_index": ("embeddings", 50, 5, 5),
    "op13_ball_tree_negatives": ("embeddings", 50, 1, 15),
}


def test_one_query_for_each_operator():
    assert sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))


@pytest.mark.parametrize("name", QUERIES)
def test_contract(spark, name):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    number = re.match(r"op(\d+)_", name)
    for column in COLUMNS[int(number[1])].split(", ") if number else ():
        assert types[column.split()[0]] == column.split()[1]
    rows = df.collect()
    if name in SEARCHES:
        asked, step, least, most = SEARCHES[name]
        n = len(range(0, spark.read.parquet(f"{SF}/{asked}.parquet").count(), step))
        assert n * least <= len(rows) <= n * most
    else:
        assert len(rows) == spark.read.parquet(f"{SF}/{'pages' if 'page_id' in types else 'documents'}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        result = con.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r[c] for c in names) for r in rows))) == sorted(map(repr, result.fetchall()))


def test_recall_of_the_neighbours(spark):
    name = next(n for n in QUERIES if n.startswith("op5_"))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    found = {(r.query_id, r.vec_id) for r in QUERIES[name](spark, SF).collect()}
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        assert {(ids[q], v) for v in ids[np.lexsort((ids, -score))[:20]]} <= found


def test_rule_labels(spark):
    urls = ["http://a.net/", "http://example.net/en/x", "http://example.org/de/", "http://b.org/fr/1", "nothing", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.blocked for r in rule_labels(df).collect()] == [1, 0, None, 0, None, None]


def test_the_url_model_is_more_than_a_character(spark):
    """Verdicts of URLs without a rule come from the labels of their sites and the URL's numbers."""
    rows = [r for r in QUERIES["op8_boosted_url_filter"](spark, "/root/testdata/sf0.01").collect() if r.rule is None]
    assert len({("-" in r.host, r.verdict) for r in rows}) > 2


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "mixing", "byte_level_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert docs.count() <= n or name == "mixing"
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in docs.collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last.collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_edge_rows(spark, name, stage):
    for df in (documents(spark), broken_text(spark), no_documents(spark)):
        out = stage(spark, df, SF)
        if name != "byte_level_bpe":
            assert out.columns == df.columns
        assert out.count() <= 3 * df.count()
