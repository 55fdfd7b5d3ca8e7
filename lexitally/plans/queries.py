"""The registered queries of the word-frequency engine, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.functions.stopwords import STOP_WORDS
from lexitally.functions.text import positional_tokens, tokens
from lexitally.operators import counting
from lexitally.operators.stored_counts import merged, stored
from lexitally.operators.threshold_top import ranked_dump_parts, ranked_parts, threshold_top_k
from lexitally.plans.word_frequency import frequencies
from lexitally.sources.dump import articles_from
from lexitally.sources.workdir import shared_folder, until_exit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escaped(col: str) -> Column:
    out = F.col(col)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def page_markup(body: Column) -> Column:
    return F.concat(F.lit('<page><title>t</title><text xml:space="preserve">'), body, F.lit("</text></page>"))


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies(counting.marked_counts(table(spark, sf_dir, "documents")))[1]


def threshold_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``top_words`` by rounds, in which only words that can be among them are moved."""
    return threshold_top_k(ranked_parts(table(spark, sf_dir, "documents")))


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies(counting.marked_counts(table(spark, sf_dir, "documents")))[0]


def word_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.word_counts(table(spark, sf_dir, "documents"), stop=False)


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.word_counts(table(spark, sf_dir, "documents"))


def _benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "benchmark"))


def listed_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop list as a table: all words of the benchmark."""
    return counting.word_counts(table(spark, sf_dir, "documents"), stop=_benchmark_words(spark, sf_dir))


def merged_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the documents are stored, and those of the conversations merged into them."""
    before = stored(counting.marked_counts(table(spark, sf_dir, "documents")))
    return counting.words_only(merged(before, counting.marked_counts(table(spark, sf_dir, "conversations"))))


def threshold_dump_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words of a dump by rounds."""
    return threshold_top_k(ranked_dump_parts(spark, _dump(spark, sf_dir, "documents", "text")))


def listed_dump_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counting.dump_counts(spark, _dump(spark, sf_dir, "documents", "text"), stop=_benchmark_words(spark, sf_dir))
    return counting.without_stop_words(found)  # the names of entities are words of the dump


def stop_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_words(counting.only_stop_words(tokens(table(spark, sf_dir, "documents"))))


def tokens_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_tokens(table(spark, sf_dir, "documents"), "doc_id")


def extract_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "pages").where(F.col("html").isNotNull())
    marked = some.select("page_id", page_markup(escaped("html")).alias("markup"))
    return articles_from(marked, "markup").select("page_id", "text")


def page_markup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.word_counts(table(spark, sf_dir, "pages"), "html")


def conversation_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.word_counts(table(spark, sf_dir, "conversations"))


def _dump(spark: SparkSession, sf_dir: str, name: str, col: str) -> str:
    """A dump that is written from a column."""
    path = shared_folder(spark, "dump")
    some = table(spark, sf_dir, name).where(F.col(col).isNotNull())
    some.select(page_markup(escaped(col))).write.text(path)
    until_exit(spark, path)
    return path


def dump_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.words_only(counting.dump_counts(spark, _dump(spark, sf_dir, "documents", "text")))


def dump_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.summary(counting.dump_counts(spark, _dump(spark, sf_dir, "pages", "html")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        top_words,
        corpus_summary,
        word_counts_all,
        word_counts,
        stop_word_counts,
        listed_word_counts,
        tokens_positional,
        extract_page_text,
        page_markup_counts,
        conversation_word_counts,
        dump_scan_counts,
        dump_scan_summary,
        listed_dump_counts,
        merged_word_counts,
        threshold_top_words,
        threshold_dump_words,
    )
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _counts_sql(name: str, col: str = "text", where: str = "") -> str:
    words = f"SELECT lower(w) AS word FROM (SELECT unnest(regexp_extract_all({col}, '[A-Za-z]+')) AS w FROM {name})"
    return f"SELECT word, count(*) AS cnt FROM ({words}) {where} GROUP BY word"


def _summary_sql(name: str, col: str) -> str:
    counts = _counts_sql(name, col, f"WHERE word NOT IN ({_STOP})")
    return (
        f"SELECT (SELECT count(*) FROM {name}) AS total_articles, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total_words, "
        f"count(*) AS unique_words FROM ({counts})"
    )


_KEPT = f"WHERE word NOT IN ({_STOP})"
_UNLISTED = "WHERE word NOT IN (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM benchmark)"
_ESCAPED = "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_MARKUP = f"('<page><title>t</title><text xml:space=\"preserve\">' || {_ESCAPED} || '</text></page>')"
_BODY = "'(?s)<text[^>]*>(.*?)</text>'"

_TOP_SQL = f"SELECT CAST(row_number() OVER (ORDER BY cnt DESC, word) AS BIGINT) AS rank, word, cnt FROM ({_counts_sql('documents', where=_KEPT)}) ORDER BY cnt DESC, word LIMIT 100"

ORACLES: dict[str, str] = {
    "top_words": _TOP_SQL,
    "threshold_top_words": _TOP_SQL,
    "threshold_dump_words": _TOP_SQL,
    "corpus_summary": _summary_sql("documents", "text"),
    "word_counts_all": _counts_sql("documents"),
    "word_counts": _counts_sql("documents", where=_KEPT),
    "listed_word_counts": _counts_sql("documents", where=_UNLISTED),
    "listed_dump_counts": _counts_sql("documents", where=f"{_UNLISTED} AND word NOT IN ({_STOP})"),
    "merged_word_counts": _counts_sql("(SELECT text FROM documents UNION ALL SELECT text FROM conversations)", where=_KEPT),
    "stop_word_counts": _counts_sql("documents", where=f"WHERE word IN ({_STOP})"),
    "tokens_positional": "SELECT doc_id, CAST(unnest(range(1, len(ws) + 1)) AS BIGINT) AS pos, lower(unnest(ws)) AS word "
    "FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents)",
    "extract_page_text": f"SELECT page_id, regexp_extract({_MARKUP}, {_BODY}, 1) AS text FROM pages WHERE regexp_matches({_MARKUP}, {_BODY})",
    "page_markup_counts": _counts_sql("pages", "html", _KEPT),
    "conversation_word_counts": _counts_sql("conversations", where=_KEPT),
    "dump_scan_counts": _counts_sql("documents", where=_KEPT),
    "dump_scan_summary": _summary_sql("pages", "html"),
}
