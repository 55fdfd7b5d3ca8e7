"""Integer vectors in blocks, and the tiles in which queries meet them: what the exact searches by inner product share.

Rows are written once and dealt into blocks of bounded bytes by their place in that table, so that no id, vector or label,
however often it is repeated, makes a block larger than others. A block becomes some rows of an index, pieces of at most PIECE
bytes of its arrays, which is written too; a tile is a block of queries and one of the index, and a task holds one of each. Each query first
meets one block, another one for each share of the queries, which gives it a k-th score; the others are searched for what reaches it. Tiles return at
most k rows a query, and the rank's limit merges them.

The index is sent once for each block of queries, the queries once for each block of the index. So queries are dealt by bytes, and into more
blocks only where there are fewer tiles than tasks; components go as 16-bit integers where they fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.sources.workdir import written

#: A vector's component x becomes floor(SCALE * x).
SCALE = 256
#: Bytes of a block of the index and of queries, as 64-bit integers, and the fewest rows and queries of a block that is there for a task's sake.
INDEX_BYTES, QUERY_BYTES, LEAST_ROWS, LEAST_QUERIES = 16 << 20, 16 << 20, 8192, 64
#: Bytes of a row of the index.
PIECE = 1 << 20
#: Pairs that are scored or kept at a time.
PAIRS = 1 << 17
#: Tasks of a round.
MOST_TASKS = 10_000
#: Squared lengths from which inner products may not fit into 64 bits.
LONGEST = float(1 << 62)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``vector`` as integers, floor(scale * x) of each component in double precision; null if it takes no part.

    That are null vectors, those with a null or non-finite component, and those whose squared length, a one more in
    each component, is 2**62 or more, as their inner products may not fit into 64 bits.
    """
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    length = F.aggregate(scaled, F.lit(0.0), lambda total, x: total + (F.abs(x) + 1) * (F.abs(x) + 1))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(finite, F.lit(False)) & (length < LONGEST), F.transform(scaled, lambda x: F.floor(x)))


def _measured(rows: DataFrame) -> tuple[int, int, str]:
    """How many ``rows`` there are, their longest vector, and the array type that holds their components: all are within 32 bits."""
    largest = F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))))
    total, width, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1)), F.coalesce(largest, F.lit(0))).first()
    return total, max(1, width), "array<smallint>" if most < 1 << 15 else "array<int>"


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, index_bytes: int = INDEX_BYTES) -> tuple[DataFrame, int]:
    """``rows`` (with ``vector``) with ``width, b``, and how many blocks ``b`` there are; ``discard`` deletes the table that it reads."""
    rows = written(rows.select("*", F.monotonically_increasing_id().alias("place")), "vectors")
    total, width, kind = _measured(rows)
    blocks = max(1, math.ceil(total * width * 8 / index_bytes), min(_tasks(rows), total // LEAST_ROWS))
    b = F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")
    out = rows.withColumns({"vector": F.col("vector").cast(kind), "width": F.size("vector"), "b": b}).drop("place")
    out.folder = rows.folder
    return out, blocks


def query_blocks(queries: DataFrame, blocks: int, query_bytes: int = QUERY_BYTES) -> tuple[DataFrame, int]:
    """``queries`` (a written table with ``id, vector``) with ``width, a``, and how many blocks ``a`` there are: with ``blocks`` of the index
    there are at least as many tiles as tasks, if they would have queries enough."""
    total, width, kind = _measured(queries)
    number = max(1, math.ceil(total * width * 8 / query_bytes), math.ceil(min(_tasks(queries), total // LEAST_QUERIES) / blocks))
    a = F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")
    return queries.withColumns({"vector": F.col("vector").cast(kind), "width": F.size("vector"), "a": a}), number


def matrix(table: pa.Table) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(table), -1)


#: A block's arrays in pieces, as rows of an index.
PIECES = "width int, b int, name string, part int, piece binary"


def pieces(width: int, b: int, arrays: dict[str, np.ndarray]) -> pa.Table:
    """Index rows of a block, in the schema ``PIECES``."""
    out = []
    for name, values in arrays.items():
        flat = memoryview(np.ascontiguousarray(values).reshape(-1).view(np.uint8))
        out += [(name, at // PIECE, flat[at : at + PIECE]) for at in range(0, len(flat), PIECE)]
    names, parts, data = zip(*out, strict=True)
    head = [pa.array([x] * len(out), pa.int32()) for x in (width, b)]
    return pa.table([*head, pa.array(names), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["width", "b", "name", "part", "piece"])


def whole(table: pa.Table, kinds: dict[str, np.dtype]) -> dict[str, np.ndarray]:
    """The arrays of a block from its index rows, in any order; those without a piece are empty."""
    found: dict[str, list[tuple[int, int]]] = {name: [] for name in kinds}
    data = table.column("piece").combine_chunks()
    for row, (name, part) in enumerate(zip(table.column("name").to_pylist(), table.column("part").to_pylist(), strict=True)):
        found[name].append((part, row))
    return {name: np.frombuffer(b"".join(memoryview(data[row].as_buffer()) for _, row in sorted(rows)), kinds[name]) for name, rows in found.items()}


def exact(x: np.ndarray, y: np.ndarray) -> tuple[type, int]:
    """The quickest type in which inner products of rows of ``x`` and ``y`` and all their sums are exact, and a number that is above them all."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).sum(axis=1, dtype=np.float64).max(initial=0))
    return (np.float32, 1 << 24) if most < 1 << 23 else (np.float64, 1 << 53) if most < 1 << 52 else (np.int64, HIGHEST)


def paired(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``x`` with rows ``j`` of ``y``, pair by pair."""
    kind, _ = exact(x, y)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS // 8):
        some = slice(at, at + PAIRS // 8)
        out[some] = np.einsum("ij,ij->i", x[i[some]].astype(kind), y[j[some]].astype(kind))
    return out


def ranked(tops: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best ``score`` of each ``keys``, equal ones by the smaller ``found``, with ``rank``; a task's k are taken before they are sent."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_of(keys: np.ndarray, k: int) -> np.ndarray:
    """Which of the rows with these keys, equal ones together, are among the first k of their key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)])) < k


def in_two_rounds(queries: DataFrame, query_blocks: int, index: DataFrame, blocks: int, keys: list[str], k: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, windows: DataFrame | None = None) -> DataFrame:
    """``keys, found, score, rank``: the k best of each query (``keys``) over all blocks of ``index``.

    ``run`` gets a block of queries and the index rows of a block. Queries have ``least``, a score that a result must reach; with ``windows`` (a
    table of ``query_id``, the other keys and more) they have these instead, each with its ``least``, as an array ``windows``. ``run`` returns
    ``schema``: keys, ``found`` and ``score``, at most k rows of each keys and all that could be among their k best.
    """
    tasks, on = _tasks(queries), ("width", "a", "b")
    home = F.pmod(F.xxhash64(F.lit("home"), "id"), F.lit(blocks)).cast("int")
    empty = pa.table({f.name: pa.array([], f.type) for f in _arrow(schema)})

    def asking(least: DataFrame | None) -> DataFrame:
        asks = queries.select(F.col("id").alias("query_id")) if windows is None else windows
        asks = asks.join(least, keys, "left") if least is not None else asks.withColumn("least", F.lit(LOWEST))
        asks = asks.withColumn("least", F.coalesce("least", F.lit(LOWEST)))
        if windows is not None:
            asks = asks.groupBy("query_id").agg(F.collect_list(F.struct(*[c for c in asks.columns if c != "query_id"])).alias("windows"))
        return queries.join(asks.withColumnRenamed("query_id", "id"), "id")

    def tile(left: DataFrame, copies: int) -> DataFrame:
        # a number of its own: small tiles are much work all the same, so none are put together
        n = max(1, min(copies * blocks, MOST_TASKS))
        right = index.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        left, right = (x.repartition(n, *on).groupBy(*on) for x in (left, right))
        return left.cogroup(right).applyInArrow(lambda x, y: run(x, y) if len(x) and len(y) else empty, schema)

    # each block of the index meets its share of the queries
    some = max(1, math.ceil(query_blocks / blocks))
    first = ranked(tile(asking(None).withColumns({"b": home, "a": F.pmod("a", F.lit(some))}), some), keys, k)
    if blocks == 1:
        return first
    first = written(first, "first-tiles")
    least = first.where(F.col("rank") == k).select(*keys, F.col("score").alias("least"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != home)).alias("b")
    rest = tile(asking(least).repartition(tasks, "id").select("*", others), query_blocks)
    return ranked(first.drop("rank").unionByName(rest), keys, k)


def _arrow(schema: str) -> list[pa.Field]:
    return [pa.field(part.split()[0], pa.int64()) for part in schema.split(", ")]
