"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

All columns are built-in expressions. The trees are grown on the driver, on a bounded sample of
labelled URLs, and become one expression of comparisons.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import join_counted, named
from lexitally.sources.workdir import written

#: Labelled URLs that the trees are grown from, of each label, and folds of the suffix statistics for these.
TRAINING_ROWS, FOLDS = 8000, 8
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 24, 3, 0.3, 32, 10

LEXICAL = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "query_length", "host_hyphens")
#: Statistics of a URL's suffixes, the last two parts of its host (``domain``) or the last three (``site``): the rate of
#: blocked ones among its labelled URLs, and the logarithms of the numbers of labelled and of all its URLs.
LEVELS = ("domain", "site")
STATISTICS = tuple(f"{level}_{what}" for level in LEVELS for what in ("rate", "rows", "urls"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; none: empty."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (``host/path``, verdict) that fits as a struct ``rule, verdict``, else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character: log2(n) less the mean of log2 of each character's count."""
    n = F.length(text)
    letters = F.array_distinct(F.split(text, ""))

    def add(total: Column, c: Column) -> Column:
        times = n - F.length(F.replace(text, c, F.lit("")))
        return total + F.when((c != "") & (times > 0), times * F.log2(times)).otherwise(0.0)

    return F.when(n > 0, F.log2(n) - F.aggregate(letters, F.lit(0.0), add) / n).otherwise(0.0)


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with a struct ``__url`` of host, path, domain, site and the lexical numbers."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at_host, at_path = host(url), path(url)
    parts = F.split(at_host, r"\.")

    def last(n: int) -> Column:
        return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")

    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    columns = {
        "host": at_host,
        "path": at_path,
        "domain": last(2),
        "site": last(3),
        "url_length": F.length(url),
        "host_length": F.length(at_host),
        "path_length": F.length(at_path),
        "depth": F.regexp_count(at_path, F.lit("/[^/]")),
        "host_labels": F.size(parts),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
        "entropy": entropy(url),
        "parameters": F.regexp_count(query, F.lit("[^&]+")),
        "query_length": F.length(query),
        "host_hyphens": F.regexp_count(at_host, F.lit("-")),
    }
    numbers = {k: v.cast("double") if k in LEXICAL else v for k, v in columns.items()}
    return df.withColumn("__url", F.struct(*[v.alias(k) for k, v in numbers.items()]))


class Trees:
    """Boosted regression trees on the logistic loss, as nested comparisons."""

    def __init__(self, base: float, trees: list) -> None:
        self.base, self.trees = base, trees

    def margin(self, value: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, low, high = node
            return F.when(value[name] <= cut, walk(low)).otherwise(walk(high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + walk(tree)
        return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, names: tuple[str, ...]) -> Trees:
    """Trees for rows ``x`` with labels 0 or 1; cuts are midway between the values of some quantiles."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        cuts.append((values[1:] + values[:-1]) / 2)
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    base = math.log(share / (1 - share))
    margin, trees = np.full(len(y), base), []

    def split(rows: np.ndarray, gradient: np.ndarray, curve: np.ndarray, depth: int):
        g, h = gradient[rows].sum(), curve[rows].sum()
        best = (1e-6, None)
        for f in range(x.shape[1]) if depth and len(rows) >= 2 * LEAST_ROWS else ():
            column = x[rows, f]
            for cut in cuts[f]:
                low = column <= cut
                if LEAST_ROWS <= low.sum() <= len(rows) - LEAST_ROWS:
                    gl, hl = gradient[rows][low].sum(), curve[rows][low].sum()
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, float(cut)))
        if best[1] is None:
            leaf = float(-RATE * g / (h + 1))
            margin[rows] += leaf
            return leaf
        f, cut = best[1]
        low = x[rows, f] <= cut
        return (names[f], cut, split(rows[low], gradient, curve, depth - 1), split(rows[~low], gradient, curve, depth - 1))

    for _ in range(TREES if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        trees.append(split(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), DEPTH))
    return Trees(base, trees)


class UrlModel:
    """Trees and the suffix statistics that they look at; ``prior`` is the share of blocked URLs."""

    def __init__(self, trees: Trees, table: DataFrame, prior: float, statistics: tuple[str, ...] = STATISTICS) -> None:
        self.trees, self.table, self.prior, self.statistics = trees, table, prior, statistics

    @property
    def names(self) -> tuple[str, ...]:
        """The numbers that the trees see."""
        return LEXICAL + self.statistics

    @property
    def levels(self) -> list[str]:
        return [level for level in LEVELS if any(s.startswith(f"{level}_") for s in self.statistics)]

    @staticmethod
    def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", rows: int = TRAINING_ROWS, statistics: tuple[str, ...] = STATISTICS) -> UrlModel:
        """From the ``labelled`` URLs of a table (null: not labelled), at most ``rows`` of each label, by hash.

        All URLs give the suffixes' statistics; only the trees use the sample. Its URLs take their rates
        from the other folds, so that no URL's label is among its own numbers. Weights restore the
        labels' shares in the whole table. Without labels the score is even. ``statistics`` are those that the
        trees see.
        """
        every = labelled.select(named(url_col).cast("string").alias("url"), named(label_col).cast("int").alias("label"))
        known = every.where("label IS NOT NULL")
        totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        order = F.xxhash64(F.lit("sample"), "url")
        parts = [known.where(F.col("label") == v).orderBy(order, "url").limit(rows) for v in (0, 1)]
        weight = F.when(F.col("label") == 1, totals.get(1, 0) / max(1, min(rows, totals.get(1, 0)))).otherwise(totals.get(0, 0) / max(1, min(rows, totals.get(0, 0))))
        fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))
        sample = written(lexical(parts[0].unionByName(parts[1]), "url").withColumns({"weight": weight, "fold": fold}), "url-sample")
        model = UrlModel(Trees(math.log(prior / (1 - prior)), []), None, prior, statistics)
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(f"__url.{v}").alias("suffix")) for v in model.levels or LEVELS[:1]])).alias("s")
        suffixes = lexical(every, "url").withColumn("fold", fold).select("label", "fold", each)
        sums = suffixes.groupBy("s.level", "s.suffix", "fold").agg(F.coalesce(F.sum("label"), F.lit(0)).alias("hits"), F.count("label").alias("n"), F.count(F.lit(1)).alias("urls"))
        folds = written(sums, "url-folds")
        numbers = {"rate": (F.col("hits") + prior) / (F.col("n") + 1), "rows": F.log1p("n"), "urls": F.log1p("urls")}
        whole = folds.groupBy("level", "suffix").agg(*[F.sum(c).alias(c) for c in ("hits", "n", "urls")])
        model.table = written(whole.select("level", "suffix", *[v.alias(k) for k, v in numbers.items()]), "url-suffixes")
        training = sample
        for level in model.levels:
            of = sample.select(F.col(f"__url.{level}").alias("suffix"), F.col("fold").alias("own")).distinct()
            mine = of.join(folds.where(F.col("level") == level), "suffix").groupBy("suffix", "own")
            other = F.col("fold") != F.col("own")
            seen = mine.agg(*[F.coalesce(F.sum(F.when(other, F.col(c))), F.lit(0)).alias(c) for c in ("hits", "n")], F.sum("urls").alias("urls"))
            seen = seen.select(F.col("suffix").alias("__s"), F.col("own").alias("__f"), *[v.alias(f"__{level}_{k}") for k, v in numbers.items()])
            # at most a row for each URL of the bounded sample
            training = training.join(F.broadcast(seen), (F.col(f"__url.{level}") == F.col("__s")) & (F.col("fold") == F.col("__f")), "left").drop("__s", "__f")
        value = model.values()
        taken = training.select("label", "weight", *[value[n].alias(n) for n in model.names]).collect()
        if taken:
            table = np.array(sorted(tuple(r) for r in taken), float)
            model.trees = grow(table[:, 2:], table[:, 0], table[:, 1], model.names)
        return model

    def values(self) -> dict[str, Column]:
        """The expression of each number; a suffix without labels has the prior and no rows."""
        value = {n: F.col(f"__url.{n}") for n in LEXICAL}
        for name in self.statistics:
            value[name] = F.coalesce(F.col(f"__{name}"), F.lit(float(self.prior) if name.endswith("_rate") else 0.0))
        return value

    def numbers(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """``df`` (as ``lexical`` gives it) with its suffixes' statistics, and the expression of each number."""
        df = written(df.withColumns({f"__{level}": F.col(f"__url.{level}") for level in self.levels}), "url-numbers")
        total = df.count()
        for level in self.levels:
            of = self.table.where(F.col("level") == level)
            of = of.select(F.col("suffix").alias(f"__{level}"), *[F.col(s.partition("_")[2]).alias(f"__{s}") for s in self.statistics if s.startswith(f"{level}_")])
            # every suffix of df has a row, so a hot one without statistics is broadcast too
            of = df.groupBy(f"__{level}").agg(F.count(F.lit(1)).alias("__times")).join(of, f"__{level}", "left")
            df = join_counted(df, written(of, "url-rates"), f"__{level}", "__times", total)
        return df.drop(*[f"__{level}" for level in self.levels]), self.values()

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__score``, the chance that a URL is to be blocked."""
        with_numbers, value = self.numbers(df)
        scored = with_numbers.withColumn("__score", 1 / (1 + F.exp(-self.trees.margin(value))))
        return scored.drop(*[f"__{s}" for s in self.statistics])


def filter_urls(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", cutoff: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages``.

    A rule's verdict comes first; URLs that no rule fits are blocked from ``cutoff`` of the trees' score
    on. A null URL, or one without ``://``, has an empty host and path and goes by its score like others. Repeated
    rows and repeated or null ids stay separate rows; URLs of any length are taken whole; an empty table gives an
    empty one; other columns of ``pages`` aren't read.
    """
    scored = model.score(lexical(pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url")), "url"))
    ruled = scored.withColumn("__rule", rule_of(F.col("__url.host"), F.col("__url.path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__score") >= cutoff, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.select("page_id", F.col("__url.host").alias("host"), F.col("__url.path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), F.col("__score").alias("score"))
