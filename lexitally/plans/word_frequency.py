"""The whole query: dump or table in, totals and most frequent words out."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from lexitally.operators import counting
from lexitally.operators.report import TaskCounter, format_report


@dataclass
class WordFrequencies:
    total_articles: int
    total_words: int
    unique_words: int
    k: int
    top: list[tuple[int, str, int]]
    mb: float
    seconds: float

    def __str__(self) -> str:
        return format_report(self.mb, self.seconds, self.total_articles, self.total_words, self.unique_words, self.k, self.top)


def frequencies(marked: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """Totals and top-k of ``marked_counts`` as DataFrames; each reads the texts once, as both hang on one aggregate."""
    return counting.summary(marked), counting.top_k(counting.words_only(marked), k)


def observed(marked: DataFrame, k: int) -> tuple[dict[str, int], list[tuple[int, str, int]]]:
    """Totals and top-k of ``marked_counts`` in one job: the totals are observed on the rows that the top-k is taken from.

    The counts aren't kept. The final aggregate and each task's own top-k are one stage, whose tasks Spark counts
    once each, however often they run; the driver numbers the k rows.
    """
    if not counting.whole_number(k):
        return counting.summary(marked).first().asDict(), []
    seen = Observation("totals")
    best = counting.most_frequent(counting.words_only(marked.observe(seen, *counting.totals())), k).collect()
    return seen.get, [(rank, r.word, r.cnt) for rank, r in enumerate(best, 1)]


def analyze(spark: SparkSession, path: str | list[str], k: int = 100, seen: TaskCounter | None = None) -> WordFrequencies:
    """Reads the dump once, in one job."""
    began = time.perf_counter()
    n, top = observed(counting.dump_counts(spark, path, seen=seen), k)
    return WordFrequencies(n["total_articles"], n["total_words"], n["unique_words"], k, top, _megabytes(spark, path), time.perf_counter() - began)


def _megabytes(spark: SparkSession, path: str | list[str]) -> float:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for one in [path] if isinstance(path, str) else path:
        p = jvm.org.apache.hadoop.fs.Path(one)
        fs = p.getFileSystem(conf)
        total += sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(p) or [])
    return total / (1024 * 1024)
