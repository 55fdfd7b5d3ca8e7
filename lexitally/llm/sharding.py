"""Shards that each match the mixture of sources: proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's place is its fractional
rank (rank + 1/2) / (rows of its source). Sorted by place, any run of rows holds each source in its
share of the whole, so cutting the order into equal runs gives shards that all match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import named, running_start, source_key
from lexitally.sources.workdir import written

#: What a stored row takes besides its text.
ROW_BYTES = 16


def interleaved_shards(docs: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, source, shard, slot`` for each row of ``docs``.

    Shards hold equally many rows, give or take one; ``slot`` numbers a shard's rows from 0. Null
    sources are a source of their own. A null text has no bytes and checksum 0. Rows with equal ids
    are separate rows; equal rows may swap places with each other. With fewer rows than shards some
    shards are empty; an empty table gives an empty one. Texts of any length are only sized and summed; columns
    besides these three aren't read. No task sorts a source, or all rows of one place.
    """
    text = named(text_col).cast("string")
    slim = docs.select(
        named(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        named(source_col).cast("string").alias("source"),
    )
    key = source_key(F.col("source"))
    slim = written(slim.withColumns({"key": key, "h": F.xxhash64(F.lit(seed), "doc_id", "text_crc32")}), "shard-rows")
    total = slim.count()
    rows = ["h", "doc_id", "text_crc32", "size"]
    ranked = running_start(slim, ["key"], rows, F.lit(1), "rank")
    # one row for each source, written, so that Spark knows its size and only broadcasts it below its limit
    per_source = written(slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "shard-sources")
    placed = written(ranked.join(per_source, "key").withColumn("place", (F.col("rank") + 0.5) / F.col("n")), "shard-places")
    at = running_start(placed, [], ["place", "key", *rows], F.lit(1), "at")
    shard = F.expr(f"at * {shards} div {max(total, 1)}")
    return at.select("doc_id", "size", "text_crc32", "source", shard.cast("int").alias("shard"), "at").select(
        "doc_id", "size", "text_crc32", "source", "shard", (F.col("at") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).alias("slot")
    )
