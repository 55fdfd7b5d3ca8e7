"""Counts that are kept, and that later ones are merged into without moving them.

Stored counts lie in buckets by word, each sorted. A merge sends the new counts to the buckets and joins them with what lies there,
so the stored ones, however many there are by then, are read where they are: no shuffle and no sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.sources.workdir import shared_folder, until_exit

#: Stands for the NULL word of ``marked_counts``, whose row counts texts: joins don't match nulls, and no word is empty.
TEXTS = ""


def stored(counts: DataFrame, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``word, cnt`` of ``counts``, written in ``buckets`` by word, as many as there are shuffle partitions unless given.

    With fewer buckets than shuffle partitions Spark may rather shuffle than read them as they are. The table is a catalog's, by the name of its
    folder. It is kept at ``path``; without one it goes to the shared folder and is deleted when the driver ends.
    """
    spark = counts.sparkSession
    place = path or shared_folder(spark, "stored-counts")
    name = "counts_" + "".join(c if c.isalnum() else "_" for c in place.rstrip("/").rsplit("/", 1)[-1])
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.select(F.coalesce("word", F.lit(TEXTS)).alias("word"), "cnt").repartition(n, "word")
    dealt.write.bucketBy(n, "word").sortBy("word").option("path", place).saveAsTable(name)
    if path is None:
        until_exit(spark, place)
    return spark.table(name)


def merged(before: DataFrame, counts: DataFrame) -> DataFrame:
    """``word, cnt`` of what ``stored`` gave and of other counts (``marked_counts``, or words only) together, the NULL word among them if it was.

    It can be stored again, as the next state.
    """
    more = counts.select(F.coalesce("word", F.lit(TEXTS)).alias("word"), F.col("cnt").alias("more"))
    both = before.join(more, "word", "full")
    total = F.coalesce("cnt", F.lit(0)) + F.coalesce("more", F.lit(0))
    return both.select(F.when(F.col("word") != TEXTS, F.col("word")).alias("word"), total.alias("cnt"))
