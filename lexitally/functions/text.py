"""ASCII word expressions.

A word is a maximal run of ``[A-Za-z]``, folded to lower case; every other character separates.
The letters are matched *before* folding: folding first would turn U+212A into ``k`` and U+0130
into ``i``, and so invent letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_WORD = "[A-Za-z]+"


def ascii_words(col: Column | str) -> Column:
    """The words of a text, in order, case kept. NULL gives NULL."""
    return F.regexp_extract_all(col, F.lit(ASCII_WORD), F.lit(0))


def tokens(df: DataFrame, col: str = "text") -> DataFrame:
    """One row ``word`` for each word of ``col``; a text without words, or NULL, gives none."""
    return df.select(F.explode(ascii_words(F.col(col))).alias("raw")).select(F.lower("raw").alias("word"))


def positional_tokens(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """``key, pos, word`` with positions from 1 within the text."""
    exploded = df.select(key, F.posexplode(ascii_words(F.col(col))).alias("at", "raw"))
    return exploded.select(key, (F.col("at") + 1).cast("long").alias("pos"), F.lower("raw").alias("word"))
