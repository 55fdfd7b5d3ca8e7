"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.sources.workdir import written

#: Of a join's left rows, a key that holds more than one in so many is hot.
HOT_SHARE = 1000


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The bytes of each value of a text column; null counts as empty. A few values at a time are copied, not the column."""
    column = column.cast(pa.binary())
    for at in range(0, len(column), 64):
        yield from (b"" if x is None else x for x in column.slice(at, 64).to_pylist())


def named(column: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def kept_columns(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def nested(df: DataFrame) -> Column:
    """A whole row as one struct ``row``, so that no name in it can clash with an operator's own."""
    return F.struct(*kept_columns(df)).alias("row")


def unnested(df: DataFrame) -> list[Column]:
    """The columns of what ``nested(df)`` made."""
    return [F.col("row").getField(c).alias(c) for c in df.columns]


def source_key(col: Column) -> Column:
    """A non-null form of a text key, different for null and for every text."""
    return F.coalesce(F.concat(F.lit("="), col), F.lit(""))


def row_id(id_col: Column, *content: Column) -> Column:
    """A non-null id: the row's own, else a large one from its content (so own ids come first)."""
    return F.coalesce(id_col.cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(*content), 2))


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and the key's number of left rows in ``count``.

    Keys with over 1 / HOT_SHARE of all left rows are HOT_SHARE at most, whatever the input: these
    are broadcast and their left rows stay where they are. No other key can fill a task.
    """
    limit = total / HOT_SHARE
    value = [c for c in right.columns if c != count]
    hot, cold = F.broadcast(right.where(F.col(count) > limit).select(*value)), right.where(F.col(count) <= limit).select(*value)
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return left.join(hot, key, "inner").unionByName(rest)


def running_start(df: DataFrame, groups: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (integers) over the rows before each one, in its group's order.

    All rows are dealt by ranges of groups and order, taken from Spark's sample of them, so parts are even
    whatever the keys: a group may fill many parts, and rows that are equal in all of these go by a salt, which
    nothing but their order among themselves depends on. The ranged table is written, so its parts are fixed. A window orders
    a part at a time; what the parts before it hold, and where a group begins, comes from small tables of sums.
    ``df`` must give the same rows when it is read again, as written tables do.
    """
    keys = [*groups, *order, "__salt"]
    salted = df.withColumns({"__value": value.cast("long"), "__salt": F.xxhash64(F.monotonically_increasing_id())})
    ranged = written(salted.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = ranged.groupBy("__part").agg(F.sum("__value").alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__inner", F.coalesce(F.sum("__value").over(within), F.lit(0))).join(offsets, "__part")
    placed = placed.withColumn(name, F.col("__inner") + F.col("__offset")).drop("__value", "__salt", "__part", "__inner", "__offset")
    if not groups:
        return placed
    placed = written(placed, "places")
    begins = written(placed.groupBy(*groups).agg(F.min(name).alias("__begin")), "group-begins")
    return placed.join(begins, groups).withColumn(name, F.col(name) - F.col("__begin")).drop("__begin")


Batches = Iterator[pa.RecordBatch]
