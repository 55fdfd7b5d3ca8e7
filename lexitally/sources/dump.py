"""MediaWiki-style XML dumps as a table of article texts, in one reading.

The scan cuts files at ``<page>``, so that Spark splits them like lines: a piece belongs to the split in which it begins, and
the reader follows it past the split's end. A piece shows by itself whether its page is closed, so nothing else has to look
at a file's end, compressed or not, and the driver opens no file. What comes before a file's first ``<page>`` is no page; pieces without a
``</page>`` begin a page that the next piece goes on with; what is still open at a file's end is no page either. The first text body
of a page is taken from it. No entities are decoded.

A task can't know whether the split before its own ended within a page. So it holds back a split's first page, and an open end
with a text tag, as edges: some bytes for each split, that are put together file by file, in order of the splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_START, PAGE_END = "<page>", "</page>"
#: Fixed by the dump format: the opening tag is matched by its prefix and ends at the first ``>``.
TEXT_START, TAG_END, TEXT_END = "<text", ">", "</text>"
_START, _END, _TEXT, _CLOSE, _TEXT_END = (t.encode() for t in (PAGE_START, PAGE_END, TEXT_START, TAG_END, TEXT_END))


def body_within(raw: bytes, begin: int, end: int) -> tuple[int, int] | None:
    """Where the first text body of ``raw[begin:end]`` is, as ``articles_from`` finds it; None if there is none."""
    opened = raw.find(_TEXT, begin, end)
    start = raw.find(_CLOSE, opened, end) + 1 if opened >= 0 else 0
    stop = raw.find(_TEXT_END, start, end) if start else -1
    return (start, stop) if stop >= 0 else None


def articles_from(df: DataFrame, col: str) -> DataFrame:
    """``df`` with ``text``, the first text body of the page markup in ``col``; others are dropped.

    The markup may hold text before ``<page>``; a value without ``<page>`` is no article. Each tag is looked for behind the one before.
    """
    out = df.withColumn("__from", F.instr(F.col(col), PAGE_START)).where("__from > 0")
    for tag in (TEXT_START, TAG_END):
        out = out.withColumn("__from", F.expr(f"locate('{tag}', `{col}`, __from)")).where("__from > 0")
    out = out.withColumn("__to", F.expr(f"locate('{TEXT_END}', `{col}`, __from)")).where("__to > 0")
    return out.withColumn("text", F.expr(f"substring(`{col}`, __from + 1, __to - __from - 1)")).drop("__from", "__to")


@dataclass
class Edge:
    """What a task holds back of a split: its first page without ``<page>`` and ``</page>``, or what is open at its end, from ``<page>`` on."""

    file: str
    block: int
    opens: bool
    raw: bytes

    def name(self) -> bytes:
        """As one value; ascending values go by file, by split and by place in it."""
        return b"\0" + self.file.encode() + b"\0%016x\0%d" % (self.block, self.opens) + self.raw

    @classmethod
    def named(cls, name: bytes) -> Edge:
        _, file, block, rest = name.split(b"\0", 3)
        return cls(file.decode(), int(block, 16), rest[:1] == b"1", rest[1:])


class Pages:
    """The text bodies of a task's pieces, and the edges of its splits."""

    def __init__(self) -> None:
        self.split: tuple[str, int] | None = None
        self.open: list[bytes] = []
        self.first = False  # whether the split's first page is still to come
        self.edges: list[Edge] = []

    def leave(self) -> None:
        """The split ends here."""
        if self.open:
            raw = b"".join(self.open)
            if self.first or _TEXT in raw:
                self.edges.append(Edge(*self.split, True, raw))
        self.open, self.first = [], False

    def bodies(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        """The bodies in a batch of ``value binary, file, block``."""
        files, blocks = batch.column(1), batch.column(2).to_pylist()
        for at, (raw, begin, end) in enumerate(values(batch.column(0))):
            if self.split is None or blocks[at] != self.split[1] or files[at].as_py() != self.split[0]:
                self.leave()
                self.split, self.first = (files[at].as_py(), blocks[at]), blocks[at] > 0
                if not self.first:
                    continue  # what is before the first page
            close = raw.find(_END, begin, end)
            if close < 0:
                self.open += [_START, raw[begin:end]]
                continue
            if self.first:
                self.edges.append(Edge(*self.split, False, b"".join([*self.open, _START, raw[begin:close]])))
                self.open, self.first = [], False
                continue
            if self.open:
                raw = b"".join([*self.open, _START, raw[begin:close]])
                begin, close, self.open = 0, len(raw), []
            if (found := body_within(raw, begin, close)) is not None:
                yield raw[found[0] : found[1]]


class Seams:
    """The bodies of pages that splits held back, from their edges in order."""

    def __init__(self) -> None:
        self.file, self.open = "", []

    def body(self, edge: Edge) -> bytes | None:
        if edge.file != self.file:
            self.file, self.open = edge.file, []
        if edge.opens:
            self.open.append(edge.raw)
            return None
        raw = b"".join([*self.open, edge.raw])
        self.open = []
        found = body_within(raw, 0, len(raw))
        return None if found is None else raw[found[0] : found[1]]


def values(column: pa.Array) -> Iterator[tuple[bytes, int, int]]:
    """``(buffer, begin, end)`` of each value of a text or binary column; a null is empty."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = memoryview(offsets).cast("q" if wide else "i")[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    for begin, end in zip(ends, ends[1:], strict=False):
        yield raw, begin, end


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value, file, block``: the pieces of files between ``<page>``, as ``Pages`` takes them. Nothing is read yet."""
    scan = spark.read.text(path, lineSep=PAGE_START)
    return scan.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def in_order(edges: DataFrame, name: str) -> DataFrame:
    """Edges, named by ``name``, with each file's in one task, in order."""
    return edges.repartition(F.substring_index(name, "\0", 2)).sortWithinPartitions(name)


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The articles of a dump: one row ``text`` for each closed page that has a text body.

    As rows can't be taken from one reading twice, the edges of splits come from another one; ``counting.dump_counts`` needs
    one reading only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = Pages()
        for batch in batches:
            found = list(pages.bodies(batch))
            yield both(found, pages)
        pages.leave()
        yield both([], pages)

    def both(found: list[bytes], pages: Pages) -> pa.RecordBatch:
        edges, pages.edges = [e.name() for e in pages.edges], []
        return pa.RecordBatch.from_arrays([pa.array(found + [None] * len(edges), pa.binary()), pa.array([None] * len(found) + edges, pa.binary())], names=["text", "edge"])

    def sewn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seams = Seams()
        for batch in batches:
            found = [b for name in batch.column(0).to_pylist() if (b := seams.body(Edge.named(name))) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["text"])

    rows = pieces(spark, path).mapInArrow(run, "text binary, edge binary")
    edges = in_order(rows.where("edge IS NOT NULL").select(F.col("edge").cast("string").alias("edge")), "edge")
    late = edges.select(F.col("edge").cast("binary")).mapInArrow(sewn, "text binary")
    return rows.where("edge IS NULL").select("text").unionByName(late).select(F.col("text").cast("string").alias("text"))
