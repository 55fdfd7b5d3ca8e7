"""The registered queries of this package, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.llm import bpe, warc
from lexitally.llm.hard_negatives import hard_negatives
from lexitally.llm.impact_index import largest_products
from lexitally.llm.lexical_search import search
from lexitally.llm.mixing import GOLDEN, GRAIN, SLOTS, SLOTS_A_SOURCE, mix
from lexitally.llm.nearest import nearest
from lexitally.llm.quality_classifier import grade, ratings_of, train
from lexitally.llm.quality_rules import BASE, measured, quality_verdicts
from lexitally.llm.sharding import interleaved_shards
from lexitally.llm.simhash import near_duplicates
from lexitally.llm.urls import LOWER, UPPER, UrlModel, filter_urls, host, path, rule_of
from lexitally.plans.queries import table

SHARDS = 40
TOKEN_LIMIT = 1024
NEIGHBOURS, QUERY_STEP = 20, 20
#: Searches with integer vectors: every so-manieth row asks; of the labels, every so-manieth row's is moved on.
ASKING, RELABELLED, LABELS = 50, 7, 10
FOUND_DOCUMENTS, LARGEST, POSITIVES, NEGATIVES, LOW, HIGH = 20, 5, 5, 3, 50, 95
#: Grade 2 is good and not toxic. A clean document lost weighs more than a toxic one kept.
TOP_GRADE, LEAST_TAIL = 2, 0.4

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: The suffix statistics that the trees see: how many URLs a site has. The rules label the URLs by their suffixes, so
#: rates of labels by suffix, and numbers of labelled ones, would only give the rules back.
URL_STATISTICS = ("site_urls",)


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe.decode(encoded, vocabulary, with_bytes=False)


def op2_proportional_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleaved_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id",
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("metadata.refers_to_page").alias("refers_to"),
    )


def op4_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return nearest(vectors.where(F.col("id") % QUERY_STEP == 0), vectors, NEIGHBOURS)


def op6_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_merge_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, TOKEN_LIMIT)


def rule_labels(pages: DataFrame) -> DataFrame:
    """``url, blocked``: URLs that a rule fits have its verdict as label, others none."""
    url = F.col("url")
    verdict = rule_of(host(url), path(url), URL_RULES).getField("verdict")
    return pages.select("url", (verdict == "block").cast("int").alias("blocked"))


def op8_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, UrlModel.fit(rule_labels(pages), statistics=URL_STATISTICS), URL_RULES)


def op9_simhash_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ratings_of(table(spark, sf_dir, "labels")), TOP_GRADE)
    return grade(docs.select("doc_id", "text"), model, TOP_GRADE, LEAST_TAIL).drop("text")


def op11_sort_based_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), FOUND_DOCUMENTS)


def op12_impact_ordered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return largest_products(vectors.where(F.col("id") % ASKING == 0), vectors, LARGEST)


def op13_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(ident % RELABELLED == 0, (label + 1) % LABELS).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(ident.alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows.where(F.col("id") % ASKING == 0), rows, POSITIVES, NEGATIVES, LOW, HIGH)


def rule_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 counts in each text, by itself: SQL can express this part."""
    return measured(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id", *BASE, "base_failed")


def url_parts_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 says of each URL before the trees, by itself: SQL can express this part."""
    at = [host(F.col("url")).alias("host"), path(F.col("url")).alias("path")]
    rule = rule_of(F.col("host"), F.col("path"), URL_RULES)
    return table(spark, sf_dir, "pages").select("page_id", *at).withColumn("rule", rule.getField("rule"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_level_bpe,
        op2_proportional_interleaving,
        op3_warc_transactions,
        op4_risk_controlled_rules,
        op5_block_matrix_neighbours,
        op6_low_discrepancy_mix,
        op7_merge_token_counts,
        op8_boosted_url_filter,
        op9_simhash_vantage_point_trees,
        op10_ordinal_quality,
        op11_sort_based_search,
        op12_impact_ordered_index,
        op13_ball_tree_negatives,
        rule_base_counts,
        url_parts_and_rules,
    )
}

#: A payload below 1000 bytes is always stored; of larger equal ones the last page is.
_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM r
"""

_USABLE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_OP5 = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {NEIGHBOURS}
"""

_OP6 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  coalesce('=' || source, '') AS key,
  CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap,
  CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT key, source_size, least(cap, coalesce(max(level) FILTER (level * weight <= cap) OVER (), 'inf'::DOUBLE) * weight) AS target FROM l),
b AS (SELECT *, CAST(greatest(least({SLOTS_A_SOURCE}, source_size), round(source_size / greatest(1.0, (SELECT sum(source_size) FROM t)::DOUBLE
  / greatest({SLOTS}, {SLOTS_A_SOURCE} * (SELECT count(*) FROM t))))) AS BIGINT) AS blocks FROM t WHERE source_size > 0),
c AS (SELECT *, CAST(round(target * blocks / source_size * {GRAIN}) AS BIGINT) AS parts FROM b),
e AS (SELECT *, CAST(sum(parts) OVER (ORDER BY key) AS DOUBLE) / CAST(sum(parts) OVER () AS DOUBLE) AS high,
  CAST(sum(parts) OVER (ORDER BY key) - parts AS DOUBLE) / CAST(sum(parts) OVER () AS DOUBLE) AS low FROM c),
p AS (SELECT i, i * {GOLDEN!r}::DOUBLE + 0.5 - floor(i * {GOLDEN!r}::DOUBLE + 0.5) AS u
  FROM range(0, (SELECT CAST(round(sum(parts) / {GRAIN}) AS BIGINT) FROM c)) AS r(i)),
k AS (SELECT e.key, e.blocks, row_number() OVER (PARTITION BY e.key ORDER BY i) - 1 AS rank FROM p JOIN e ON u >= low AND u < high),
x AS (SELECT key, rank % blocks AS block, count(*) AS times FROM k WHERE rank < 3 * blocks GROUP BY ALL),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM d),
y AS (SELECT doc_id, o.key, size, first, b.source_size, b.blocks,
  unnest(range(first * b.blocks // b.source_size, (first + size - 1) * b.blocks // b.source_size + 1)) AS block FROM o JOIN b ON o.key = b.key WHERE size > 0),
z AS (SELECT y.key, first, doc_id, size, sum((least(first + size, ((y.block + 1) * source_size + blocks - 1) // blocks)
  - greatest(first, (y.block * source_size + blocks - 1) // blocks)) * coalesce(times, 0)) AS taken
  FROM y LEFT JOIN x ON y.key = x.key AND y.block = x.block GROUP BY ALL)
SELECT o.doc_id, CAST(o.size AS BIGINT) AS size, t.source_size, t.target, CAST(coalesce(z.taken, 0) AS BIGINT) AS taken, o.source
FROM o JOIN t ON o.key = t.key LEFT JOIN z ON o.key = z.key AND o.first = z.first AND o.size = z.size AND o.doc_id IS NOT DISTINCT FROM z.doc_id
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
_BASE_COUNTS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws, {_LINES} AS ls,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents),
x AS (SELECT r, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM d),
y AS (SELECT r, i, a, lead(a) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM x),
z AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM y WHERE c IS NOT NULL),
m AS (SELECT r, count(DISTINCT i + k) AS n FROM z, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN m USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o
"""

_RULE = "\n".join(
    f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{text}'"
    for text, (name, _, rest) in ((t, t.partition("/")) for t in sorted((t for t, _ in URL_RULES), key=len, reverse=True))
)
_URL_RULES = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {_RULE} END AS rule FROM u
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM s),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(ts) AS t FROM i) GROUP BY ALL),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY t, nn),
c AS (SELECT q.item, q.item_id, s.doc_id, s.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN s USING (r), z GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= {FOUND_DOCUMENTS}
"""

_INTEGERS = """vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_FLOORS = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"
_OP12 = f"""
WITH v AS (SELECT vec_id, {_FLOORS} AS e FROM embeddings WHERE {_INTEGERS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % {ASKING} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {LARGEST}
"""

_OP13 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {RELABELLED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, {_FLOORS} AS e
  FROM embeddings WHERE label IS NOT NULL AND {_INTEGERS}),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
FROM v a JOIN v c ON len(a.e) = len(c.e) AND a.vec_id <> c.vec_id WHERE a.vec_id % {ASKING} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * s.score BETWEEN {LOW} * positive_score AND {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""

ORACLES: dict[str, str] = {
    "op11_sort_based_search": _OP11,
    "op12_impact_ordered_index": _OP12,
    "op13_ball_tree_negatives": _OP13,
    "op3_warc_transactions": _OP3,
    "op5_block_matrix_neighbours": _OP5,
    "op6_low_discrepancy_mix": _OP6,
    "rule_base_counts": _BASE_COUNTS,
    "url_parts_and_rules": _URL_RULES,
}
