"""Awkward rows that every operator must take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (None, None, None, None, None),
    (None, "no id here", "en", None, 10),
    (1, "", "en", "a", 0),
    (2, " \t\n\r\x0b\x0c ", None, "a", 7),
    (3, "one", "en", "a", 3),
    (4, "one two three four", "en", "b", 18),
    (4, "one two three four", "en", "b", 18),
    (5, "one two three four", "de", "b", 18),
    (6, LONG, "en", "c", len(LONG)),
    (7, "naïve café 日本語 \U0001f600  x don't  stop\n\n!", "fr", "c", 40),
    (8, "x" * 30_000, "en", "c", 30_000),
    (9, "<|endoftext|> a<|endoftext|>b", "en", None, 29),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for columns of their own.
CLASHING = ("fp", "component_id", "kept", "size", "shard", "slot", "taken", "key", "bucket", "h", "ids", "n_tokens", "block", "host", "path", "rule", "score", "vector", "expected_grade", "payload", "sha1", "first", "steps", "stratum", "row", "order", "point", "num", "tail", "__row", "__times", "__time", "__text", "__stratum", "__keep", "__salt", "__part", "a.b", "a`b")


def documents(spark: SparkSession, rows=ROWS) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit(i) for i, n in enumerate(CLASHING)})


def no_documents(spark: SparkSession) -> DataFrame:
    return documents(spark).where("false")


def broken_text(spark: SparkSession) -> DataFrame:
    """The awkward rows and one that is no valid UTF-8; such a text can't be collected."""
    broken = documents(spark).limit(1).withColumns({"doc_id": F.lit(10).cast("long"), "text": F.expr("CAST(X'61FF6220C3' AS STRING)")})
    return documents(spark).unionByName(broken)
