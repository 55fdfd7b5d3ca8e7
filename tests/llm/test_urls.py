import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexitally.llm.queries import URL_RULES
from lexitally.llm.urls import BINS, DEPTH, FOLDS, LEAST_ROWS, RATE, TREES, UrlModel, filter_urls, grow, lexical
from tests.llm.edge import CLASHING

NUMBERS = tuple("abcdefghij")
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1", "http://example.net/en/", "http://example.net/e", "http://notexample.net/en/x",
    "http://net", "http://net/", "http://a.net?x=1&y=2", "http://a.example.com/de/1?q#f", "http://org/fr/", "https://x.org/fr/a/b/", "https://x.org/en/",
    "http://a://b.net/c", "http://ÄÖ.net/ü", "x\ny://h.net/\np", "http://a.net/" + "z" * 50_000, "http://a.net/", "http://a.net/",
]


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not found else ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2])


def rule(host, path):
    fits = [(len(r), r, v) for r, v in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def table(spark, urls, labels=None):
    rows = list(zip(range(len(urls)), urls, labels or [None] * len(urls), strict=True))
    return spark.createDataFrame(rows, "page_id bigint, url string, blocked int").withColumns({n: F.lit(1) for n in CLASHING})


def made(n, seed):
    rng = random.Random(seed)
    urls, labels = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        urls.append(f"http://{name}-{rng.randint(0, 99)}.top/{rng.randint(10**6, 10**9)}?a=1&b=2&c=3" if bad else f"http://{name}.example.com/docs/page")
        labels.append(int(bad))
    return urls, labels


def test_rules_and_parts(spark):
    model = UrlModel.fit(table(spark, *made(300, 1)))
    got = filter_urls(table(spark, URLS), model, URL_RULES).orderBy("page_id").collect()
    assert len(got) == len(URLS)
    for r, url in zip(got, URLS, strict=True):
        host, path = parts(url)
        fits, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, fits), url
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_held_out_accuracy(spark):
    model = UrlModel.fit(table(spark, *made(1500, 1)))
    urls, labels = made(500, 2)
    got = filter_urls(table(spark, urls), model, []).orderBy("page_id").collect()
    assert sum((r.verdict == "block") == bool(y) for r, y in zip(got, labels, strict=True)) >= 490


def test_plan_is_native(spark):
    df = filter_urls(table(spark, URLS), UrlModel.fit(table(spark, *made(200, 1))), URL_RULES)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_numbers(spark):
    text = "http://a-b.example.com/x/y9?k=1&m=2"
    row = lexical(table(spark, [text]), "url").select("__url.*").first()
    counts = Counter(text)
    entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
    assert math.isclose(row.entropy, entropy) and (row.depth, row.parameters, row.host_hyphens, row.host_labels) == (2, 2, 1, 3)
    assert math.isclose(row.digit_ratio, 3 / len(text)) and (row.domain, row.site) == ("example.com", "a-b.example.com")


def test_trees_are_their_expression(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (300, len(NUMBERS))).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    trees = grow(x, y, np.ones(300), NUMBERS)

    def walk(node, row):
        return node if isinstance(node, float) else walk(node[2] if row[NUMBERS.index(node[0])] <= node[1] else node[3], row)

    df = spark.createDataFrame(x.tolist(), list(NUMBERS))
    got = [r.m for r in df.select(trees.margin({n: F.col(n) for n in NUMBERS}).alias("m")).collect()]
    expected = [trees.base + sum(walk(t, row) for t in trees.trees) for row in x]
    assert np.allclose(got, expected) and np.mean((np.array(got) > 0) == y) > 0.95


def test_without_labels_or_rows(spark):
    model = UrlModel.fit(table(spark, URLS))
    assert filter_urls(table(spark, URLS), model, []).count() == len(URLS)
    assert filter_urls(table(spark, URLS).where("false"), model, URL_RULES).collect() == []


def test_statistics_cover_all_labelled_urls(spark):
    """The sample is for the trees only."""
    urls = [f"http://a{i % 40}.site{i % 40}.com/{i}" for i in range(400)]
    labels = [int(i % 40 < 10) for i in range(400)]
    model = UrlModel.fit(table(spark, urls, labels), rows=15)
    got = {r.suffix: r for r in model.table.where("level = 'domain'").collect()}
    assert len(got) == 40 and all(round(math.expm1(r.rows)) == 10 for r in got.values())
    assert all(math.isclose(got[f"site{k}.com"].rate, (10 * (k < 10) + model.prior) / 11) for k in range(40))
    assert all(round(math.expm1(r.urls)) == 10 for r in got.values())
    labels[::2] = [None] * 200
    half = UrlModel.fit(table(spark, urls, labels), rows=15, statistics=("domain_rows", "domain_urls")).table.collect()
    assert {(round(math.expm1(r.rows)), round(math.expm1(r.urls))) for r in half} == {(0, 10), (10, 10)}
    score = model.score(lexical(table(spark, urls), "url"))
    assert score.count() == len(urls)


def plain_trees(x, y, weight):
    """Boosting from its definition: every cut of every column, loss by loss."""
    cuts = []
    for column in x.T:
        values = sorted(set(column))
        if len(values) > BINS:
            ranked = sorted(column)
            values = sorted({ranked[round(q * (len(ranked) - 1))] for q in np.linspace(0, 1, BINS)})
        cuts.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)])
    share = sum(w for w, v in zip(weight, y, strict=True) if v) / sum(weight)
    margin, trees = [math.log(share / (1 - share))] * len(y), []

    def gain(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)

    def node(rows, g, h, depth):
        best, where = 1e-6, None
        for f in range(x.shape[1]) if depth and len(rows) >= 2 * LEAST_ROWS else ():
            for cut in cuts[f]:
                low, high = [i for i in rows if x[i, f] <= cut], [i for i in rows if x[i, f] > cut]
                if min(len(low), len(high)) >= LEAST_ROWS:
                    found = gain(low, g, h) + gain(high, g, h) - gain(rows, g, h)
                    if found > best + 1e-12:
                        best, where = found, (f, cut)
        if where is None:
            leaf = -RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
            for i in rows:
                margin[i] += leaf
            return leaf
        f, cut = where
        return NUMBERS[f], cut, node([i for i in rows if x[i, f] <= cut], g, h, depth - 1), node([i for i in rows if x[i, f] > cut], g, h, depth - 1)

    for _ in range(TREES):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        trees.append(node(range(len(y)), [w * (a - b) for w, a, b in zip(weight, p, y, strict=True)], [w * a * (1 - a) for w, a in zip(weight, p, strict=True)], DEPTH))
    return trees


def flat(tree):
    return [tree] if isinstance(tree, float) else [tree[0], float(tree[1]), *flat(tree[2]), *flat(tree[3])]


def test_fit_against_brute_force():
    rng = np.random.default_rng(4)
    x = np.c_[rng.random(90), rng.integers(0, 4, 90), rng.integers(0, 50, 90)].astype(float)
    y = ((x[:, 0] + x[:, 1] / 4 + rng.random(90) / 2) > 1.1).astype(float)
    weight = rng.integers(1, 4, 90).astype(float)
    for a, b in zip(grow(x, y, weight, NUMBERS[:3]).trees, plain_trees(x, y, weight), strict=True):
        a, b = flat(a), flat(b)
        assert [v for v in a if isinstance(v, str)] == [v for v in b if isinstance(v, str)]
        assert np.allclose([v for v in a if not isinstance(v, str)], [v for v in b if not isinstance(v, str)])


def test_training_rates_come_from_other_folds(spark):
    """One site, one blocked URL: its own label is not among its own numbers, so no tree can read it there."""
    urls = [f"http://a.b{i}.com/" for i in range(60)]
    fold = {r.url: r.f for r in table(spark, urls).select("url", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).alias("f")).collect()}
    assert len(set(fold.values())) == FOLDS
    model = UrlModel.fit(table(spark, urls, [i % 2 for i in range(60)]), statistics=("site_rate", "site_rows"))
    assert model.names[-2:] == ("site_rate", "site_rows")
    assert "site_rate" not in {v for tree in model.trees.trees for v in flat(tree)}
