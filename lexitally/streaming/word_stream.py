"""Beyond the reference: the same counts over a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexitally.functions.text import tokens
from lexitally.operators.counting import count_words, without_stop_words


def streaming_word_counts(texts: DataFrame, col: str = "text") -> DataFrame:
    """Running ``word, cnt`` of a streaming DataFrame; write it in ``complete`` or ``update`` mode.

    The state holds one row for each distinct word, as the batch aggregate does.
    """
    return count_words(without_stop_words(tokens(texts, col)))
