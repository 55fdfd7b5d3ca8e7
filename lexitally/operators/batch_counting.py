"""Word counts over Arrow batches: whole buffers at a time, only counts leave a task.

A batch's bytes are folded to lower-case letters and zeros, and the edges of the zeros are the words. A word of up to eight
letters is a 64-bit number, read off the buffer where the word begins and masked by its length; numbers are sorted and their runs counted.
Longer words are counted as Arrow strings. No object is made for a word.

Across batches a task keeps a bounded table of words, frequent ones for long; what doesn't fit goes straight to the output.
Every text also counts one row with a NULL word: the number of texts is another group of the same aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.operators.report import TaskCounter
from lexitally.sources.dump import Edge, Pages, Seams, values

#: Bytes of texts that are counted at a time.
PIECE = 1 << 21
#: Words that a task's table holds, and new ones that it takes in at a time: once for short words and once for long ones.
TABLE, NEW = 1 << 19, 1 << 18
#: Letters of a short word: those of a 64-bit number.
SHORT = 8

_FOLD = bytes(b | 0x20 if chr(b).isalpha() and b < 128 else 0 for b in range(256))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)], np.uint64)
_COUNTS = pa.schema([("word", pa.string()), ("cnt", pa.int64())])
_RANKED = pa.schema([*_COUNTS, ("mass", pa.int64()), ("best", pa.bool_())])

Counted = tuple[np.ndarray, np.ndarray]


def counted(text: bytes) -> tuple[Counted, pa.Table]:
    """The short words of a text, as ascending numbers, with their counts, and its long ones as ``word, cnt``.

    Words are maximal runs of ASCII letters, folded to lower case.
    """
    folded = text.translate(_FOLD) + bytes(SHORT)
    data = np.frombuffer(folded, np.uint8)
    inside = data != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    short = lengths <= SHORT
    at_each_byte = np.ndarray((len(data) - SHORT + 1,), "<u8", folded, strides=(1,))
    keys = np.sort(at_each_byte[begins[short]] & _MASKS[lengths[short]])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return (keys[first], np.diff(first, append=len(keys))), _strings(data, begins[~short], lengths[~short])


def _strings(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> pa.Table:
    """``word, cnt`` of the slices of ``data``."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    offsets = np.zeros(len(ends) + 1, np.int32 if total < 1 << 31 else np.int64)
    offsets[1:] = ends
    letters = data[np.repeat(begins - (ends - lengths), lengths) + np.arange(total)]
    kind = pa.StringArray if offsets.dtype == np.int32 else pa.LargeStringArray
    found = kind.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(letters)).value_counts()
    return pa.table([found.field("values").cast(pa.string()), found.field("counts")], schema=_COUNTS)


def spelled(keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """``word, cnt`` of short words given as numbers."""
    letters = keys.astype("<u8").view(np.uint8).reshape(-1, SHORT)
    offsets = np.zeros(len(keys) + 1, np.int32)
    offsets[1:] = np.cumsum(np.count_nonzero(letters, axis=1))
    words = pa.StringArray.from_buffers(len(keys), pa.py_buffer(offsets), pa.py_buffer(letters[letters != 0]))
    return pa.table([words, pa.array(counts, pa.int64())], schema=_COUNTS)


def summed(parts: list[Counted]) -> Counted:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


class ShortWords:
    """A task's table of short words, in order. Words that it has are added up in place; others wait, and are taken in when they are many.

    A table without room for them sends on all but its most frequent half.
    """

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[Counted] = []
        self.many = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.Table]:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == keys[inner]
        self.counts[at[known]] += counts[known]
        if not known.all():
            self.waiting.append((keys[~known], counts[~known]))
            self.many += len(keys) - np.count_nonzero(known)
        if self.many > NEW:
            yield from self._take_in()

    def _take_in(self) -> Iterator[pa.Table]:
        self.keys, self.counts = summed([(self.keys, self.counts), *self.waiting])
        self.waiting, self.many = [], 0
        if len(self.keys) > TABLE:
            keep = np.zeros(len(self.keys), bool)
            keep[np.argpartition(self.counts, -(TABLE // 2))[-(TABLE // 2) :]] = True
            yield spelled(self.keys[~keep], self.counts[~keep])
            self.keys, self.counts = self.keys[keep], self.counts[keep]

    def rest(self) -> Iterator[pa.Table]:
        yield from self._take_in()
        yield spelled(self.keys, self.counts)


class LongWords:
    """The same for long words, as Arrow tables: new ones are merged when they are many."""

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []
        self.many = 0

    def add(self, found: pa.Table) -> Iterator[pa.Table]:
        self.parts.append(found)
        self.many += len(found)
        if self.many > NEW:
            yield from self._take_in()

    def _take_in(self) -> Iterator[pa.Table]:
        table = pa.concat_tables(self.parts).group_by("word").aggregate([("cnt", "sum")])
        table, self.many = pa.table([table.column("word"), table.column("cnt_sum")], schema=_COUNTS), 0
        if len(table) > TABLE:
            order = pc.array_sort_indices(table.column("cnt").combine_chunks(), order="descending")
            yield table.take(order[TABLE // 2 :])
            table = table.take(order[: TABLE // 2])
        self.parts = [table]

    def rest(self) -> Iterator[pa.Table]:
        if self.parts:
            yield from self._take_in()
            yield self.parts[0]


def _side_by_side(texts: Iterable[bytes]) -> Iterator[bytes]:
    """Texts cut off from one another, some at a time; a longer one is a piece of its own."""
    piece, size = [], 0
    for text in texts:
        if piece and size + len(text) > PIECE:
            yield b"\n".join(piece)
            piece, size = [], 0
        piece.append(text)
        size += len(text)
    if piece:
        yield b"\n".join(piece)


class Tally:
    """A task's counts of words and texts."""

    def __init__(self, seen: TaskCounter | None = None) -> None:
        self.short, self.long, self.texts, self.seen = ShortWords(), LongWords(), 0, seen

    def add(self, texts: list[bytes], number: int) -> Iterator[pa.RecordBatch]:
        for piece in _side_by_side(texts):
            short, long = counted(piece)
            for some in (*self.short.add(*short), *self.long.add(long)):
                yield from some.to_batches()
        self.texts += number
        if self.seen is not None:
            self.seen.reached(self.texts)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for some in (*self.short.rest(), *self.long.rest()):
            yield from some.to_batches()
        yield rows([None], [self.texts])


def rows(words: list, counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).view(pa.string()), pa.array(counts, pa.int64())], schema=_COUNTS)


def ranked(batches: Iterator[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """``word, cnt, mass, best`` of batches that hold a word once each: ``mass`` is the sum of a batch's words, ``best`` marks the ``best`` most frequent.

    A row with a NULL word and no count follows each batch with words. So the masses of all batches can be added up, whichever words are taken out later.
    """
    for batch in batches:
        counts = batch.column(1).to_numpy()
        words = np.where(batch.column(0).is_valid().to_numpy(zero_copy_only=False) & (counts > 0), counts, 0)
        mass, marks = int(words.sum()), words > 0
        if len(words) > best:
            marks[np.argpartition(words, len(words) - best)[: len(words) - best]] = False
        columns = [*batch.columns, pa.array(np.full(len(words), mass)), pa.array(marks)]
        yield pa.RecordBatch.from_arrays(columns, schema=_RANKED)
        if mass:
            yield pa.RecordBatch.from_pylist([{"word": None, "cnt": 0, "mass": mass, "best": False}], schema=_RANKED)


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], best: int | None) -> DataFrame:
    if best is None:
        return df.mapInArrow(run, "word string, cnt long")
    return df.mapInArrow(lambda batches: ranked(run(batches), best), "word string, cnt long, mass long, best boolean")


def partial_counts(texts: DataFrame, col: str = "text", seen: TaskCounter | None = None, best: int | None = None) -> DataFrame:
    """``word, cnt``: a row for each word that a task's table has at the end or has sent on before.

    Rows with a NULL word count texts; a NULL text is a text without words. ``seen`` is told the number of texts, for a progress
    line. With ``best`` the rows have the columns of ``ranked`` besides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(seen)
        for batch in batches:
            yield from tally.add([raw[begin:end] for raw, begin, end in values(batch.column(0))], len(batch))
        yield from tally.rest()

    return _mapped(texts.select(F.col(col).cast("string")), run, best)


def partial_page_counts(pieces: DataFrame, seen: TaskCounter | None = None, best: int | None = None) -> DataFrame:
    """The same for the first text bodies of a dump's pages. A ``word`` that begins with a zero byte names an edge of a split, with a ``cnt`` of -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, pages = Tally(seen), Pages()
        for batch in batches:
            found = list(pages.bodies(batch))
            yield from tally.add(found, len(found))
        pages.leave()
        yield from tally.rest()
        yield rows([e.name() for e in pages.edges], [-1] * len(pages.edges))

    return _mapped(pieces.select("value", "file", "block"), run, best)


def edge_counts(edges: DataFrame, seen: TaskCounter | None = None, best: int | None = None) -> DataFrame:
    """``word, cnt`` of the pages that the edges of splits make up: ``word, cnt`` with -1 for each time that the file is read, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, seams = Tally(seen), Seams()
        for batch in batches:
            for (raw, begin, end), times in zip(values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if (body := seams.body(Edge.named(raw[begin:end]))) is not None:
                    yield from tally.add([body] * -times, -times)
        yield from tally.rest()

    return _mapped(edges.select("word", "cnt"), run, best)
