"""The k most frequent words without a shuffle of all words: an exact top-k in three rounds, by a threshold.

Partial counts are written where the tasks made them, and never move as a whole.

1. The best words of each part are added up. The k-th of these sums is a bound: k words have at least that count.
2. Each part has a share of the bound, by the words in it, and sends what reaches its share. A word that no part sends
   stays below the bound. For the others the sums of what was sent give a better bound, from below, and the shares of the parts
   that sent nothing say what can be missing.
3. Only words that can still reach the better bound are counted out.

A part sends in the second round at most twice as many rows as the bound goes into all words, however many different words it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.functions.stopwords import STOP_WORDS
from lexitally.operators.batch_counting import edge_counts, partial_counts, partial_page_counts
from lexitally.operators.counting import kept, most_frequent, summed, top_k, whole_number, words_only
from lexitally.sources.dump import in_order, pieces
from lexitally.sources.workdir import written


def ranked_parts(texts: DataFrame, col: str = "text", k: int = 100, stop: bool = True) -> DataFrame:
    """The partial counts of texts, written with the columns of ``ranked``: one scan, no shuffle.

    ``k`` is the number of words to be looked for later; others get right results too, but larger ones send more.
    """
    return written(kept(partial_counts(texts, col, best=_best(k, stop)), stop), "ranked-parts")


def ranked_dump_parts(spark: SparkSession, path: str | list[str], k: int = 100, stop: bool = True) -> DataFrame:
    """The same of a dump's articles. The edges of splits, a page for each, are put together as in ``dump_counts``."""
    every = written(kept(partial_page_counts(pieces(spark, path), best=_best(k, stop)), stop), "ranked-parts")
    edges = in_order(summed(every.where("cnt < 0")), "word")
    more = written(kept(edge_counts(edges, best=_best(k, stop)), stop), "ranked-parts")
    return every.where("cnt >= 0").unionByName(more)


def _best(k: int, stop: bool) -> int:
    """Stop words are taken out after the best words are marked."""
    return max(1, whole_number(k)) + (len(STOP_WORDS) if stop else 0)


def _kth(counts: DataFrame, k: int) -> int:
    """The k-th largest count, 0 if there are fewer."""
    found = most_frequent(counts, k).agg(F.count("cnt").alias("n"), F.min("cnt").alias("least")).first()
    return found.least if found.n == k else 0


def reaching(parts: DataFrame, bound: int) -> DataFrame:
    """``word, cnt, share``: the rows of ``parts`` that reach their part's share of ``bound``. The shares of all parts add up to ``bound`` at most."""
    all_words = parts.where("word IS NULL").agg(F.sum("mass")).first()[0] or 1
    share = f"CAST({bound} AS DECIMAL(19, 0)) * CAST(mass AS DECIMAL(19, 0)) div CAST({all_words} AS DECIMAL(19, 0))"
    return words_only(parts).select("word", "cnt", F.expr(share).alias("share")).where("cnt >= share")


def candidates(parts: DataFrame, k: int) -> DataFrame:
    """``word``: all words that can be among the k most frequent, ties of the last included, and few others. Written, so that its size is known."""
    bound = _kth(summed(words_only(parts).where("best")), k)
    sums = [F.sum("cnt").alias("cnt"), F.sum("share").alias("share")]
    sent = written(reaching(parts, bound).groupBy("word").agg(*sums), "threshold-sent")
    return written(sent.where(F.col("cnt") - F.col("share") + bound >= _kth(sent, k)).select("word"), "threshold-candidates")


def threshold_top_k(parts: DataFrame, k: int = 100) -> DataFrame:
    """``rank, word, cnt``, as ``top_k`` gives it, from ``ranked_parts`` or ``ranked_dump_parts``.

    Without words there are no rows, and with fewer than k all words are sent. Equal counts go by word.
    Candidates meet the parts by broadcast where Spark knows them to be below its limit, else in a shuffle.
    """
    if not whole_number(k):
        return top_k(summed(words_only(parts)), k)
    return top_k(summed(words_only(parts).join(candidates(parts, k), "word", "left_semi")), k)
