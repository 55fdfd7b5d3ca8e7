"""Mixing sources to target weights by a low-discrepancy schedule.

1. Each source's documents are shuffled by a seeded hash and laid end to end, and the stream is cut
   into equal-token blocks (equal to within a word).
2. The points frac(i * g + 1/2), g the inverse golden ratio, go through the sources' cumulative shares: the source
   whose interval holds the i-th point gets the i-th slot. Any stretch of the schedule gives a source
   its share to within a few slots.
3. Slots are ranked within their source; slot r takes the source's block r modulo its blocks, in
   epoch r div its blocks. No source goes round more often than the repeat limit.
4. A document is taken as many words as its parts in the blocks taken, repeats counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import named, nested, row_id, running_start, source_key, unnested
from lexitally.sources.workdir import written

#: Words of a text. Fixed by the definition of a document's size.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of all sources, and of each, at least: they set the grain, not the size, of a mix. A small source's blocks are
#: smaller, so that its target too is many slots.
SLOTS, SLOTS_A_SOURCE = 1 << 17, 64
#: Slots are shared out in such parts of one, as whole numbers.
GRAIN = 1 << 20
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled_by(seed: int, ident: Column, text: Column) -> Column:
    """A seeded place below 2**60 for a row: the first 15 digits of an MD5 of its id and its text's MD5."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substr(F.md5(whole.cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """``sources`` (``key, source, source_size``, a row for each source) with ``weight`` and ``target``.

    Sources by code point, null last, weigh 1, 2, 3 and so on again. The targets add up to ``share``
    of all sizes, but none is above ``limit`` times its source; the rest goes to the others by weight.
    With water level x, a source gets min(cap, weight * x): in order of cap / weight the first ones
    are full and the level follows from the rest, which running sums over the sources give at once.
    """
    order = sources.withColumn("none", F.col("source").isNull())
    weighed = running_start(order, [], ["none", "source"], F.lit(1), "place").withColumn("weight", F.pmod("place", F.lit(3)) + 1)
    weighed = written(weighed.withColumns({"cap": F.col("source_size") * limit, "fills": F.col("source_size") * limit / F.col("weight")}).drop("none", "place"), "mix-weights")
    words, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    fuller = running_start(weighed, [], ["fills", "key"], F.col("source_size"), "words_before")
    fuller = running_start(written(fuller, "mix-fuller"), [], ["fills", "key"], F.col("weight"), "weight_before")
    level = (F.lit(float(words)) * share - F.col("words_before") * limit) / (F.lit(weights) - F.col("weight_before"))
    leveled = written(fuller.withColumn("level", level), "mix-levels")
    # the first source that its level doesn't fill sets it; further on the levels only fall
    fits = leveled.agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))).first()[0]
    target = F.least(F.col("cap"), F.lit(float("inf") if fits is None else fits) * F.col("weight"))
    return leveled.select("key", "source", "source_size", F.col("weight").cast("double").alias("weight"), target.alias("target"))


def schedule(blocks: DataFrame, slots: int, cells: int = 1024) -> DataFrame:
    """``slot, key, rank``: each slot's source and the slot's rank in it.

    ``blocks`` has ``key, low, high``: the sources' intervals of [0, 1), which are cut by ``cells`` of it,
    so that a point only meets those near it.
    """
    spark = blocks.sparkSession
    cell = F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell")
    intervals = blocks.select("key", "low", "high", cell)
    u = F.col("id") * GOLDEN + 0.5
    points = spark.range(slots).select(F.col("id").alias("slot"), (u - F.floor(u)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    hit = points.join(intervals, "cell").where("u >= low AND u < high").select("slot", "key")
    return running_start(hit, ["key"], ["slot"], F.lit(1), "rank").select("slot", "key", "rank")


def mix(docs: DataFrame, share: float = 1.0, limit: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for each row of ``docs``.

    ``size`` counts words; null and wordless texts have none and are never taken; a very long text lies in many
    blocks. Null sources are a source of their own. Rows with equal ids, and equal rows, are mixed as separate
    rows. Reruns agree. An empty table gives an empty one. Columns besides these three aren't read.
    """
    text = named(text_col).cast("string")
    slim = docs.select(
        named(id_col).cast("long").alias("doc_id"),
        word_count(text).alias("size"),
        shuffled_by(seed, named(id_col).cast("long"), text).alias("h"),
        named(source_col).cast("string").alias("source"),
    )
    slim = written(slim.withColumn("key", source_key(F.col("source"))), "mix-rows")
    sources = written(slim.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "mix-sources")
    aimed = written(targets(sources, share, limit), "mix-targets")
    words, kinds = aimed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    aim = max(1.0, words / max(SLOTS, SLOTS_A_SOURCE * kinds))  # words of a block
    blocks = F.greatest(F.least(F.lit(SLOTS_A_SOURCE), F.col("source_size")), F.round(F.col("source_size") / aim)).cast("long")
    cut = aimed.where("source_size > 0").withColumn("blocks", blocks)
    cut = written(cut.withColumn("parts", F.round(F.col("target") * F.col("blocks") / F.col("source_size") * GRAIN).cast("long")), "mix-blocks")
    parts = cut.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    edges = running_start(cut.select("key", "parts"), [], ["key"], F.col("parts"), "begin")
    edges = edges.select("key", (F.col("begin") / F.lit(parts)).alias("low"), ((F.col("begin") + F.col("parts")) / F.lit(parts)).alias("high"))
    taken = schedule(written(edges, "mix-edges"), round(parts / GRAIN), max(1024, kinds)).join(cut.select("key", "blocks"), "key")
    taken = taken.where(F.col("rank") < F.col("blocks") * limit)
    taken = taken.groupBy("key", F.expr("rank % blocks").alias("block")).agg(F.count(F.lit(1)).alias("times"))

    laid = running_start(slim.where("size > 0"), ["key"], ["h", "doc_id", "size"], F.col("size"), "first")
    # block b of a source is [ceil(b * words / blocks), ceil((b + 1) * words / blocks)) of its stream
    inside = cut.select("key", "source_size", "blocks")
    parts = laid.join(inside, "key").withColumn("block", F.explode(F.expr("sequence(first * blocks div source_size, (first + size - 1) * blocks div source_size)")))
    begin = F.expr("(block * source_size + blocks - 1) div blocks")
    end = F.expr("((block + 1) * source_size + blocks - 1) div blocks")
    part = F.least(F.col("first") + F.col("size"), end) - F.greatest(F.col("first"), begin)
    parts = parts.withColumn("part", part).join(taken, ["key", "block"], "left")
    words_taken = parts.groupBy("key", "first", "doc_id", "size").agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    everyone = words_taken.select("key", "doc_id", "size", "taken").unionByName(slim.where("size = 0").select("key", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    about = aimed.select("key", "source", "source_size", "target")
    return everyone.join(about, "key").select("doc_id", "size", "source", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents: a row is repeated by the words taken of it over its size, rounded.

    Rows of one id share what is taken of them equally; rows without an id are told apart by text, so equal ones
    share as well. Null, empty and wordless texts have no words to take and go. Texts of any length are repeated
    whole. An empty table gives an empty one. All columns are kept, whatever their names.
    """
    text = named(text_col).cast("string")
    ident = row_id(named(id_col), F.lit("row"), text).alias("id")
    found = mix(docs.select(ident, text.alias("text"), named(source_col).alias("source")), id_col="id", text_col="text", source_col="source", **how)
    times = found.groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).where("size > 0")
    times = times.select(F.col("doc_id").alias("id"), F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    repeated = docs.select(nested(docs), ident).join(times, "id").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select(*unnested(docs))
