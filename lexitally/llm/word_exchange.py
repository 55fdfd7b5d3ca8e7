"""A global exchange of distinct words, for work that depends on a word alone.

1. Texts are cut into words. A task collects whole documents into a block and numbers the block's
   distinct words; a document becomes the list of its words' numbers, in order of position. The
   block's words go out in packets by hash bucket, each distinct word of a block once.
2. A bucket's task answers packets one after another and works each distinct word out once.
3. A block's positions and answers meet again, and each document is put together by position.

A block is bounded by words and positions, a packet by its block, so no task ever holds a group that
grows with the data. A word in every document makes one entry for each block, however frequent it
is. Blocks are named by their content: a re-run task can't mix answers of another block in, and a
missing packet is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import Batches, named, utf8

#: Positions and distinct words at which a block is full.
BLOCK_POSITIONS, BLOCK_WORDS = 4_500_000, 450_000
#: Distinct words whose answers a task keeps in each of two halves. When the newer is full the older one is forgotten,
#: and its words that come again are worked out again: frequent words stay.
KEPT_ANSWERS = 1_000_000

#: Numbers, or bytes of them, that are packed or unpacked at a time.
_AT_ONCE = 1 << 18
#: Long arrays may repeat far back (copies of texts).
_LONG = zstandard.ZstdCompressionParameters.from_level(3, window_log=23, enable_ldm=True)

_SCHEMA = pa.schema(
    [
        ("block", pa.string()),
        ("bucket", pa.int32()),
        ("dest", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())),
        ("data", pa.binary()),
    ]
)
_DDL = "block string, bucket int, dest int, ids array<bigint>, sizes array<bigint>, lengths array<int>, data binary"


class _Numbering(dict):
    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _to_bytes(numbers: np.ndarray) -> bytes:
    numbers = numbers.astype(np.uint32)
    lengths = 1 + sum((numbers >> (7 * k) > 0).astype(np.int8) for k in (1, 2, 3))
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    out = np.zeros(int(lengths.sum(dtype=np.int64)), np.uint8)
    for k in range(4):
        some = lengths > k
        out[starts[some] + k] = (numbers[some] >> (7 * k)) & 127 | np.where(lengths[some] > k + 1, 128, 0)
    return out.tobytes()


def _to_numbers(packed: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(packed < 128)
    lengths = np.diff(last, prepend=-1)
    out = np.zeros(len(last), np.uint32)
    for k in range(4):
        some = lengths > k
        out[some] |= (packed[last[some] - lengths[some] + 1 + k].astype(np.uint32) & 127) << (7 * k)
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Compressed bytes of numbers below 2**28: 7 bits to a byte, the lowest first, the last one unmarked."""
    if len(numbers) <= _AT_ONCE:
        return zstandard.compress(_to_bytes(numbers), 3)
    packer = zstandard.ZstdCompressor(compression_params=_LONG).compressobj()
    return b"".join([*(packer.compress(_to_bytes(numbers[at : at + _AT_ONCE])) for at in range(0, len(numbers), _AT_ONCE)), packer.flush()])


def unpack(data: bytes) -> np.ndarray:
    packed = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data), np.uint8)
    out, filled, at = np.empty(int(np.count_nonzero(packed < 128)), np.uint32), 0, 0
    while at < len(packed):
        to = min(len(packed), at + _AT_ONCE)
        while packed[to - 1] >= 128:  # a number ends where a byte isn't marked
            to += 1
        some = _to_numbers(packed[at:to])
        out[filled : filled + len(some)] = some
        filled, at = filled + len(some), to
    return out


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[s : s + n]`` one after another."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[shift + np.arange(len(shift))]


class _Block:
    def __init__(self) -> None:
        self.words = _Numbering()
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.lengths: list[int] = []
        self.positions: list[np.ndarray] = []
        self.filled = 0

    def add(self, key: int | None, size: int, words: list[str]) -> None:
        numbers = np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))
        self.ids.append(key)
        self.sizes.append(size)
        self.lengths.append(len(words))
        self.positions.append(numbers)
        self.filled += len(words)

    def full(self) -> bool:
        return self.filled >= BLOCK_POSITIONS or len(self.words) >= BLOCK_WORDS or len(self.ids) >= BLOCK_WORDS

    def rows(self, buckets: int) -> pa.RecordBatch:
        """The block's own row and its packets. Empties the block: words are the larger part of a task's memory."""
        positions = np.concatenate(self.positions) if self.positions else np.zeros(0, np.uint32)
        words = [word.encode() for word in self.words]
        self.words, self.positions = _Numbering(), []
        bucket_of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        by_bucket = np.argsort(bucket_of, kind="stable")
        filled, starts = np.unique(bucket_of[by_bucket], return_index=True)
        order, packets = [], []
        for bucket, start, end in zip(filled.tolist(), starts, np.append(starts, len(words))[1:], strict=True):
            here = sorted(by_bucket[start:end].tolist(), key=words.__getitem__)
            order += here
            packets.append((bucket, framed(np.array([len(words[i]) for i in here]), zstandard.compress(b"".join([words[i] for i in here]), 3))))
        # numbers by frequency, then as the packets list the words: the most frequent have the shortest
        # codes, and the counts alone tell the reader which word has which number
        listed = np.array(order, np.int64)
        counts = np.bincount(positions, minlength=len(words))[listed]
        rank = np.empty(len(words), np.uint32)
        rank[listed[by_frequency(counts)]] = np.arange(len(words), dtype=np.uint32)
        data = framed(counts, pack(rank[positions]))
        whole = repr((self.ids, self.sizes, self.lengths)).encode()
        name = hashlib.blake2b(b"".join([*(len(p).to_bytes(8, "little") + p for p in (whole, data, *(p[1] for p in packets)))]), digest_size=16).hexdigest()
        rows = [(name, -1, zlib.crc32(name.encode()) % buckets, self.ids, self.sizes, self.lengths, data)]
        rows += [(name, b, b, None, None, None, data) for b, data in packets]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA, strict=True)], schema=_SCHEMA)


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """Positions in the packets' order by falling count; equals keep that order."""
    return np.argsort(-counts, kind="stable")


def framed(numbers: np.ndarray, rest: bytes) -> bytes:
    """Packed numbers and, behind them, other bytes."""
    head = pack(numbers)
    return len(head).to_bytes(8, "little") + head + rest


def unframed(data: bytes) -> tuple[np.ndarray, bytes]:
    cut = 8 + int.from_bytes(data[:8], "little")
    return unpack(data[8:cut]), data[cut:]


def words_of(packet: bytes) -> list[bytes]:
    lengths, data = unframed(packet)
    text, ends = zstandard.decompress(data), np.cumsum(lengths).tolist()
    return [text[e - n : e] for n, e in zip(lengths.tolist(), ends, strict=True)]


def exchange(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    split: Callable[[str], list[str]],
    answerer: Callable[[], Callable[[bytes], bytes]],
    finish: Callable[[list, list, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray], Iterator[dict]],
    ddl: str,
) -> DataFrame:
    """``split`` cuts a text; ``answerer()`` gives a task's function from a word to numbers
    below 2**28, as bytes of 32-bit integers; ``finish`` gets a block and yields rows as dicts of columns, typed by ``ddl``.

    A block is: ids, sizes in bytes, words of each document, positions, ``(start, length)`` of the answer
    to each of the block's words, and the flat array of answers that these cut.
    """
    buckets = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def blocks(batches: Batches) -> Batches:
        block = _Block()
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                block.add(key, len(raw), split(str(raw, "utf-8", "replace")))
                if block.full():
                    yield block.rows(buckets)
                    block = _Block()
        if block.ids:
            yield block.rows(buckets)

    def answers(batches: Batches) -> Batches:
        answer, known, older = answerer(), {}, {}
        for batch in batches:
            data_out = []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if bucket >= 0:
                    if len(known) > KEPT_ANSWERS:
                        known, older = {}, known
                    found = []
                    for word in words_of(data):
                        numbers = known.get(word)
                        if numbers is None:
                            numbers = known[word] = older.get(word) or answer(word)
                        found.append(numbers)
                    data = framed(np.array([len(x) // 4 for x in found]), pack(np.frombuffer(b"".join(found), np.uint32)))
                data_out.append(data)
            kept = [batch.column(n) for n in ("block", "bucket", "dest", "ids", "sizes", "lengths")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(data_out, pa.binary())], schema=_SCHEMA)

    out_names = [part.split()[0] for part in ddl.split(", ")]

    def assemble(table: pa.Table) -> Iterator[pa.RecordBatch]:
        packets = table.sort_by("bucket").to_pylist()
        blocks_here, packets = [p for p in packets if p["bucket"] < 0], [p for p in packets if p["bucket"] >= 0]
        # repeated blocks have one name and the same packets, each of them as often as the block
        times = len(blocks_here)
        packets = packets[::times] if times else []
        head = blocks_here[0]
        counts, body = unframed(head["data"])
        answers = [unframed(p["data"]) for p in packets]
        lengths = np.concatenate([np.zeros(0, np.int64), *[n for n, _ in answers]]).astype(np.int64)
        if len(lengths) != len(counts):
            raise RuntimeError(f"block {head['block']}: {len(lengths)} answers for {len(counts)} words")
        flat = np.concatenate([np.zeros(0, np.uint32), *[unpack(data) for _, data in answers]])
        of_rank = by_frequency(counts.astype(np.int64))
        cuts = ((np.cumsum(lengths) - lengths)[of_rank], lengths[of_rank])
        positions = unpack(body)
        for _ in range(times):
            for rows in finish(head["ids"], head["sizes"], np.array(head["lengths"], np.int64), positions, cuts, flat):
                yield pa.RecordBatch.from_arrays([rows[n] for n in out_names], names=out_names)

    slim = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    packets = slim.mapInArrow(blocks, _DDL).repartition("dest")
    answered = packets.mapInArrow(answers, _DDL).select("block", "bucket", "ids", "sizes", "lengths", "data")
    return answered.groupBy("block").applyInArrow(lambda table: pa.Table.from_batches(list(assemble(table))), ddl)
