"""Exact word counts, the stop filter, totals and the most frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.functions.stopwords import STOP_WORDS
from lexitally.operators.batch_counting import edge_counts, partial_counts, partial_page_counts
from lexitally.operators.report import TaskCounter
from lexitally.sources.dump import in_order, pieces

#: The largest limit that Spark takes.
LARGEST_K = 2**31 - 1


def without_stop_words(words: DataFrame) -> DataFrame:
    """Rows whose ``word`` isn't on the stop list. On counts Catalyst moves it below the aggregate."""
    return words.where(~F.col("word").isin(*STOP_WORDS))


def without_listed(words: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``words`` whose ``word`` isn't in the table ``listed`` (``word``, lower case; others in it, nulls and repeated ones change nothing).

    Spark broadcasts a list whose size it knows to be below its limit, and filters where the counts are made; a longer one is
    met in the shuffle by word that the counts need anyway.
    """
    return words.join(listed.select("word").where("word IS NOT NULL"), "word", "left_anti")


def only_stop_words(words: DataFrame) -> DataFrame:
    return words.where(F.col("word").isin(*STOP_WORDS))


def count_words(words: DataFrame) -> DataFrame:
    """``word, cnt``: partial counts in each task, one shuffle by word."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def summed(partial: DataFrame) -> DataFrame:
    """``word, cnt`` of partial counts: one shuffle by word."""
    return partial.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def kept(counts: DataFrame, stop: bool | DataFrame) -> DataFrame:
    """``counts`` without the words of the stop list, or of a table; the row with a NULL word stays."""
    if isinstance(stop, DataFrame):
        return without_listed(counts, stop)
    return counts.where(F.col("word").isNull() | ~F.col("word").isin(*STOP_WORDS)) if stop else counts


def marked_counts(texts: DataFrame, col: str = "text", stop: bool | DataFrame = True) -> DataFrame:
    """``word, cnt`` of all texts; the row with a NULL word counts the texts themselves.

    One scan, counts within each task (``partial_counts``), one shuffle by word. The stop list, or a table of words in its place, is
    applied before the shuffle.
    """
    return summed(kept(partial_counts(texts, col), stop))


def dump_counts(spark: SparkSession, path: str | list[str], stop: bool | DataFrame = True, seen: TaskCounter | None = None) -> DataFrame:
    """``marked_counts`` of a dump's articles: the first text bodies of its closed pages.

    One reading of the files, whatever their number and compression, by tasks alone. Counts and the edges of splits go through one
    aggregate; the edges' pages are counted from it (they are few: a page for each split), and added. Where the same file is
    named twice it counts twice.
    """
    every = summed(kept(partial_page_counts(pieces(spark, path), seen), stop))
    edges = edge_counts(in_order(every.where("cnt < 0"), "word"), seen)
    return summed(every.where("cnt >= 0").unionByName(kept(edges, stop)))


def words_only(marked: DataFrame) -> DataFrame:
    return marked.where(F.col("word").isNotNull())


def word_counts(df: DataFrame, col: str = "text", stop: bool | DataFrame = True) -> DataFrame:
    """``word, cnt``, without the stop words, those of a table, or, if ``stop`` is off, with all."""
    return words_only(marked_counts(df, col, stop))


def totals() -> list[Column]:
    """``total_articles, total_words, unique_words`` of ``marked_counts``, as aggregates. Articles without words count too."""
    is_word = F.col("word").isNotNull()
    return [
        F.coalesce(F.sum(F.when(~is_word, F.col("cnt"))), F.lit(0)).cast("long").alias("total_articles"),
        F.coalesce(F.sum(F.when(is_word, F.col("cnt"))), F.lit(0)).cast("long").alias("total_words"),
        F.count("word").alias("unique_words"),
    ]


def summary(marked: DataFrame) -> DataFrame:
    """The totals as one row."""
    return marked.agg(*totals())


def most_frequent(counts: DataFrame, k: int) -> DataFrame:
    """``word, cnt`` of the k most frequent words, in order; equal counts go by word."""
    return counts.orderBy(F.desc("cnt"), F.asc("word")).limit(whole_number(k))


def whole_number(k: int) -> int:
    """``k`` if it is a number of rows, else a ValueError."""
    if isinstance(k, bool) or not isinstance(k, int) or not 0 <= k <= LARGEST_K:
        raise ValueError(f"k must be a whole number from 0 to {LARGEST_K}, not {k!r}")
    return k


def top_k(counts: DataFrame, k: int = 100) -> DataFrame:
    """``rank, word, cnt`` of the k most frequent words; equal counts go by word.

    The limit comes first, so the numbering only sees k rows.
    """
    order = [F.desc("cnt"), F.asc("word")]
    return most_frequent(counts, k).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "word", "cnt")
