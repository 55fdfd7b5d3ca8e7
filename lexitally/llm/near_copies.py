"""Near copies: groups of texts linked by a Jaccard similarity of word shingles, exactly.

1. Equal texts (by words, A-Z lower-cased) become one text, that of the smallest id.
2. SimHash fingerprints and their vantage-point shards (``simhash``) propose the closest texts: each with its
   component's first. No radius is sure to hold all similar texts, and at one that holds most the trees hardly
   cut, so the rest comes from a prefix filter.
3. Each text's distinct shingles are put in one order for all texts, those of a bounded list of frequent ones
   last. Two sets with similarity s share one of their first n - ceil(s * n) + 1 shingles, so
   candidates meet at these. The order decides how many candidates there are, never which pairs are found.
4. Candidates meet by sketches, a bit for each shingle: these bound from below in how many shingles two sets differ, so
   they refuse no similar pair and nearly all others, and few texts are sent. What is left is confirmed on the texts: first
   each with its shingle's first text, then the likeliest pairs that connect groups, which both join large groups by few
   pairs, then all those that aren't in one group yet.
5. One text of each connected group stays.

Rare shingles are sent in packed buckets, once, and only those that texts share come back as rows. No task gets a frequent
shingle's texts as a group: counts and first texts are aggregates with a part in each task, and rows meet them by joins, of
which Spark splits the skewed ones; pairs are made within tasks, in tiles. Shingles are compared as 64-bit hashes: two sets of a
thousand shingles get a wrong common one with a chance of about 1e-13.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lexitally.llm.common import Batches, named, nested, unnested, utf8
from lexitally.llm.simhash import components, near_duplicates
from lexitally.sources.workdir import discard, written

SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which fingerprints may differ that propose a link; the prefix filter finds what they leave.
RADIUS = 2
#: Texts whose shingles are counted to find frequent ones, times that such a one is seen at least, and the longest
#: list of them. They bound the list that delays shingles, not the shingles that are compared.
SAMPLE, SEEN, FREQUENT = 1 << 13, 4, 1 << 16
#: Texts of a shingle that meet others in a task.
BLOCK = 2048
#: Bytes of texts whose first shingles make a bucket, rows of shingles that a task compares, and bits of the sketches there.
BUCKET, TILE, TILE_BITS = 4 << 20, 1 << 14, 1 << 12
#: Texts of a shingle from which each pair of its blocks is a tile of its own, and pairs that a tile hands on at a time.
OWN_TILE, HANDED = 256, 1 << 18
#: Pairs that get one copy of a text.
COPY = 4096
#: Bytes of texts that are hashed, and numbers that are compared, at a time.
PIECE = 1 << 18
#: Nodes of links that a task joins at a time, and links that one task finishes.
NODES = 1 << 20
#: Buckets of packets that hold no rare shingles.
LISTED, SKETCHES = -1, -2

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scattered(numbers: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit number for each number (the finaliser of splitmix64)."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = scattered(np.arange(1, 257))


def _cuts(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of some PIECE bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


class Shingles:
    """The distinct shingles of texts as ascending hashes; fewer words than a shingle are the one shingle, no words have none."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.of_word = size, scattered(np.arange(1000, 1000 + size)) | np.uint64(1)
        self.of_place = scattered(np.arange(2000, 2256))

    def words(self, piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``(hash, begin)`` of each word: the sum of what its bytes stand for at their places."""
        data = np.frombuffer(piece, np.uint8)
        inside = ~_SPACE[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        begins, lengths = edges[::2], edges[1::2] - edges[::2]
        if not len(begins):
            return np.zeros(0, np.uint64), begins
        if lengths.max() > len(self.of_place):
            self.of_place = scattered(np.arange(2000, 2000 + lengths.max()))
        heads = np.cumsum(lengths) - lengths
        places = np.arange(heads[-1] + lengths[-1]) - np.repeat(heads, lengths)
        return scattered(np.add.reduceat(_OF_BYTE[data[inside]] * self.of_place[places], heads)), begins

    def joined(self, words: np.ndarray) -> np.ndarray:
        width = min(self.size, len(words))
        out = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            out += words[i : i + len(out)] * self.of_word[i]
        return np.unique(scattered(out)) if width else out[:0]

    def of(self, text: bytes) -> np.ndarray:
        return self.joined(np.concatenate([np.zeros(0, np.uint64), *(self.words(part)[0] for part in _cuts(text.lower()))]))

    def of_each(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """``of`` for each text; short ones are hashed side by side."""
        some, size = [], 0
        for text in texts:
            if some and size + len(text) > PIECE:
                yield from self._side_by_side(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            yield from self._side_by_side(some)

    def _side_by_side(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(texts) == 1:
            yield self.of(texts[0])
        else:
            hashes, begins = self.words(b"\n".join(texts).lower())
            ends = np.cumsum([len(t) + 1 for t in texts])
            yield from map(self.joined, np.split(hashes, np.searchsorted(begins, ends[:-1])))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets, as ascending arrays, have a Jaccard similarity of at least ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-6:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    both = int(np.count_nonzero(both[1:] == both[:-1]))
    return both >= least * (len(a) + len(b) - both)


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1


def _frequent(texts: DataFrame, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many of a sample of texts have, in order, and how often they were seen."""

    def run(batches: Batches) -> Batches:
        hashes = Shingles(size)
        for batch in batches:
            for found in hashes.of_each(utf8(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.xxhash64(F.lit("frequent"), "num"), F.lit(max(1, total // SAMPLE))) == 0)
    seen = some.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    table = seen.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def sketch(h: np.ndarray, most: int = 0) -> bytes:
    """The number of a set's hashes, then a bit for each class of them: whether the set has an odd number of that class.

    Two sets differ in at least as many hashes as bits. There are as many classes as hashes, rounded up to a power of two
    (at least 64, and ``most`` if that isn't 0), so sketches of unlike sets fold to one size.
    """
    bits = 1 << max(6, (len(h) - 1).bit_length())
    bits = min(bits, most or bits)
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(h).to_bytes(8, "little") + np.packbits(odd.astype(bool)).tobytes()


def leeway(sketches: list[bytes], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """For each pair of places in ``sketches``: by how much of their hashes the sets can differ beyond what the sketches show and
    still have a similarity of at least ``least``. Below 0: they don't have it."""
    sizes, n = np.array([len(s) - 8 for s in sketches], np.int64), np.array([int.from_bytes(s[:8], "little") for s in sketches], np.int64)
    fits = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-6
    most = (1 - least) / (1 + least) * (n[a] + n[b]) + 1e-6
    out = np.full(len(a), -1.0)
    shorter = np.minimum(sizes[a], sizes[b])
    for size in np.unique(shorter[fits]):
        at = np.flatnonzero(fits & (shorter == size))
        used, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64, offset=8).reshape(-1, size // 8)) for i in used])
        for some in np.array_split(np.arange(len(at)), 1 + len(at) * size // PIECE):
            differ = np.bitwise_count(bits[place[some]] ^ bits[place[len(at) + some]]).sum(axis=1, dtype=np.int64)
            out[at[some]] = (most[at[some]] - differ) / (n[a] + n[b])[at[some]]
    return out


def _top(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[up]
    return x


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges that, taken in this order, join what wasn't joined yet."""
    parent: dict[int, int] = {}
    out = []
    for at, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = _top(parent, x), _top(parent, y)
        if x != y:
            parent[x] = y
            out.append(at)
    return np.array(out, np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """``h, num, n, at`` of packets."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))]
    for row in table.select(["base", "h", "num", "n", "at"]).to_pylist():
        num, n, at = (np.frombuffer(row[c], f"<u{row[c][0]}", offset=1).astype(np.int64) for c in ("num", "n", "at"))
        for some, found in zip(out, (np.frombuffer(row["h"], "<u8"), num + row["base"], n, at), strict=True):
            some.append(found)
    return [np.concatenate(x) for x in out]


def _packets(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, least: float, buckets: int) -> DataFrame:
    """The first shingles of each text (``h, num, n, at``: ``n`` of all, ``at`` counts from 0), many in a row, by buckets of ``h``.

    Those of the frequent list are in bucket LISTED, so that no bucket holds a frequent one. Rows of bucket SKETCHES have a
    text's ``num`` as ``base``, its sketch as ``h`` and one of bounded size as ``num``.
    """
    known, seen = frequent
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 4)

    def packed(rows: list[tuple], nums: list[int], ns: list[int], found: list[np.ndarray], delayed: list[np.ndarray]) -> pa.RecordBatch:
        lengths, base, h = [len(x) for x in found], min(nums), np.concatenate(found)
        num, n = np.repeat(np.array(nums, np.int64) - base, lengths), np.repeat(np.array(ns, np.int64), lengths)
        at = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        bucket = np.where(np.concatenate(delayed), LISTED, ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        for name, part in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
            rows.append((name, base, h[part].tobytes(), *(_packed(x[part]) for x in (num, n, at))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "base", "h", "num", "n", "at"])

    def run(batches: Batches) -> Batches:
        hashes = Shingles(size)
        for batch in batches:
            some: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for num, h in zip(batch.column(0).to_pylist(), hashes.of_each(utf8(batch.column(1))), strict=True):
                if not len(h):
                    continue
                row, often, k = (SKETCHES, num, sketch(h), sketch(h, TILE_BITS), b"", b""), np.zeros(len(h), np.int64), prefix_length(len(h), least)
                if len(known):
                    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    often = np.where(known[place] == h, seen[place], 0)
                    order = np.lexsort((h, often))
                    h, often = h[order], often[order]
                for values, value in zip(some, (row, num, len(h), h[:k].copy(), often[:k] > 0), strict=True):
                    values.append(value)
                held += k
                if held > PIECE:
                    yield packed(*some)
                    some, held = ([], [], [], [], []), 0
            if held:
                yield packed(*some)

    return texts.select("num", "text").mapInArrow(run, "bucket int, base long, h binary, num binary, n binary, at binary")


def _shared(packets: DataFrame) -> DataFrame:
    """``h, num, n, at, lead, lead_n, lead_at`` of shingles that several texts have among their first; the lead is the smallest ``num``."""

    def meet(table: pa.Table) -> pa.Table:
        h, num, n, at = _unpacked(table)
        order = np.lexsort((num, h))
        h, num, n, at = (x[order] for x in (h, num, n, at))
        _, starts, members = np.unique(h, return_index=True, return_counts=True)
        keep = np.repeat(members > 1, members)
        lead = np.repeat(starts, members)[keep]
        columns = [h[keep].view(np.int64), num[keep], n[keep].astype(np.int32), at[keep].astype(np.int32), num[lead], n[lead].astype(np.int32), at[lead].astype(np.int32)]
        return pa.table([pa.array(c) for c in columns], names=["h", "num", "n", "at", "lead", "lead_n", "lead_at"])

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(len(batch)):
                h, num, n, at = _unpacked(batch.slice(i, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), num, n.astype(np.int32), at.astype(np.int32))], names=["h", "num", "n", "at"])

    schema = "h long, num long, n int, at int, lead long, lead_n int, lead_at int"
    rare = packets.where("bucket >= 0").groupBy("bucket").applyInArrow(meet, schema)
    listed = packets.where(F.col("bucket") == LISTED).drop("bucket").mapInArrow(rows, "h long, num long, n int, at int")
    heads = listed.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("num", "n", "at")).alias("lead")).where("members > 1")
    heads = heads.select("h", F.col("lead.num").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.at").alias("lead_at"))
    return rare.unionByName(listed.join(heads, "h"))


def _possible(least: float) -> Column:
    """Whether a text and its shingle's lead can be similar, by size and place, if it is their first common shingle."""
    both = F.least(F.col("n") - F.col("at"), F.col("lead_n") - F.col("lead_at"))
    return both >= least / (1 + least) * (F.col("n") + F.col("lead_n")) - 1e-6


def _contracted(links: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect what ``links`` connect: in each task every node with its part's smallest one, so few rounds are left."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        pairs = [(x, _top(parent, x)) for x in parent if parent[x] != x]
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Batches) -> Batches:
        parent: dict[int, int] = {}
        for batch in batches:
            for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = _top(parent, x), _top(parent, y)
                parent[max(x, y)] = min(x, y)
            if len(parent) > NODES:
                yield stars(parent)
                parent = {}
        yield stars(parent)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def grouped(links: DataFrame) -> DataFrame:
    """``node, root`` of a graph of edges ``a, b``, as ``components`` gives it.

    Tasks contract what they hold. If what is left fits into one, a task finishes it, as each edge names its
    group's smallest node once all are in one part; else rounds of stars do.
    """
    edges = written(_contracted(links.where("a != b")), "contracted")
    if edges.count() > NODES // 2:
        return components(edges)
    return written(_contracted(edges.coalesce(1)), "groups").select(F.col("a").alias("node"), F.col("b").alias("root"))


def _meetings(left: DataFrame, right: DataFrame, least: float, all_pairs: bool, classes: int = 1, of: int = 0) -> DataFrame:
    """``tile, a, b``: texts of ``left`` and ``right`` that share ``h, i, j``, aren't in one group and may be similar.

    Pairs are made and compared by their sketches within a task. All that may be similar leave it, or of those only
    enough to connect what they connect, the likeliest first. A tile with more than HANDED pairs hands none on, but a row with
    ``a`` -1 and their number, at least, as ``b``; with ``classes`` of pairs by hash, class ``of`` alone is handed on.
    """

    def key(table: pa.Table) -> np.ndarray:
        i, j = (table.column(c).to_numpy().astype(np.uint64) for c in ("i", "j"))
        return table.column("h").to_numpy().view(np.uint64) ^ scattered((i << np.uint64(32)) + j + np.uint64(1))

    def run(tile: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        mine, keys = key(x), key(y)
        order = np.argsort(keys, kind="stable")
        y, keys = y.take(pa.array(order)), keys[order]
        begins, ends = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
        (num, n, at, root), (other_num, other_n, other_at, other_root) = ([t.column(c).to_numpy() for c in ("num", "n", "at", "root")] for t in (x, y))
        names, first = np.unique(np.concatenate([num, other_num]), return_index=True)
        group_of = np.concatenate([root, other_root])[first]
        sketches = pa.chunked_array([*x.column("sketch").chunks, *y.column("sketch").chunks], pa.binary()).take(pa.array(first)).to_pylist()
        met, room, beyond = np.zeros(0, np.int64), np.zeros(0), 0
        upto = np.cumsum(ends - begins)
        cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, PIECE), "left"))
        for some in np.split(np.arange(len(x)), cuts[cuts > 0]):
            lengths = ends[some] - begins[some]
            i = np.repeat(some, lengths)
            j = np.arange(len(i)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins[some], lengths)
            apart = root[i] != other_root[j]
            i, j = i[apart], j[apart]
            both = np.minimum(n[i] - at[i], other_n[j] - other_at[j])
            possible = both >= least / (1 + least) * (n[i].astype(np.int64) + other_n[j]) - 1e-6
            p, q = np.searchsorted(names, num[i[possible]]), np.searchsorted(names, other_num[j[possible]])
            pairs = np.unique(np.minimum(p, q) * len(names) + np.maximum(p, q))
            if classes > 1:
                pairs = pairs[scattered(pairs) % np.uint64(classes) == np.uint64(of)]
            found = leeway(sketches, *np.divmod(pairs, len(names)), least)
            if beyond:
                beyond += np.count_nonzero(found >= 0)
                continue
            met, first = np.unique(np.concatenate([met, pairs[found >= 0]]), return_index=True)
            room = np.concatenate([room, found[found >= 0]])[first]
            if not all_pairs:
                order = np.argsort(-room, kind="stable")
                order = order[forest(*(group_of[x] for x in np.divmod(met[order], len(names))))]
                met, room = met[order], room[order]
            elif len(met) > HANDED:
                met, room, beyond = met[:0], room[:0], len(met)
        a, b = (names[x] for x in np.divmod(met, max(1, len(names))))
        if beyond:
            a, b = np.array([-1]), np.array([beyond])
        return pa.table([pa.array(np.full(len(a), tile[0].as_py()), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["tile", "a", "b"])

    return left.groupBy("tile").cogroup(right.groupBy("tile")).applyInArrow(run, "tile long, a long, b long")


def _plausible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` that may be similar by their texts' sketches."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                both = [*some.column(2).to_pylist(), *some.column(3).to_pylist()]
                near = leeway(both, np.arange(len(some)), np.arange(len(some)) + len(some), least) >= 0
                yield some.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("num").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _named_in(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``texts`` that ``pairs`` name, by a bit for each text, so that others aren't sent anywhere."""
    word, bit = F.shiftright("num", 6).alias("word"), F.pmod("num", F.lit(64)).cast("int")
    nums = pairs.select(F.explode(F.array("a", "b")).alias("num"))
    bits = nums.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    bits = written(bits, "named-texts")  # Spark knows its size, and only broadcasts it below its limit
    return texts.withColumns({"word": word, "bit": bit}).join(bits, "word").where(F.getbit("bits", F.col("bit")) == 1).select(*texts.columns)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` (distinct, a written table) whose texts are similar."""

    def run(batches: Batches) -> Batches:
        hashes = Shingles(size)
        last, of = None, np.zeros(0, np.uint64)
        for batch in batches:
            near = []
            for a, x, y in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), hashes.of_each(utf8(batch.column(3))), strict=True):
                if a != last:
                    last, of = a, hashes.of(x)
                near.append(similar(of, y, least))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    named_texts = _named_in(pairs, texts)
    for side, other in (("b", "a"), ("a", "b")):
        # a text in many pairs is copied, so that none of its copies has many
        copies = F.floor(F.count(F.lit(1)) / COPY).cast("int").alias("copies")
        hot = written(pairs.groupBy(side).agg(copies).where("copies > 0"), "frequent-candidates")
        copies = F.coalesce("copies", F.lit(0))
        dealt = pairs.join(hot, side, "left").withColumn("copy", F.pmod(F.xxhash64(other), copies + 1).cast("int")).drop("copies")
        one = named_texts.select(F.col("num").alias(side), F.col("text").alias(f"text_{side}")).join(hot, side, "left")
        pairs = dealt.join(one.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("copies"), [side, "copy"]).drop("copy")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _links(texts: DataFrame, size: int, least: float, radius: int) -> DataFrame:
    """``a, b``: pairs of similar texts, enough of them to connect all that are connected."""
    total, length = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    packets = written(_packets(texts, _frequent(texts, total, size), size, least, 1 + length // BUCKET), "shingle-packets")
    shared = written(_shared(packets), "shared-shingles")
    both = written(packets.where(F.col("bucket") == SKETCHES).select(F.col("base").alias("num"), F.col("h").alias("sketch"), F.col("num").alias("small")), "sketches")
    discard(packets)
    sketches = both.select("num", "sketch")

    close = near_duplicates(texts, "num", "text", size, radius).where("doc_id != component_id")
    close = close.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    led = shared.where("num != lead").where(_possible(least)).select(F.col("lead").alias("a"), F.col("num").alias("b"))
    met = written(_plausible(close.unionByName(led).distinct(), sketches, least), "led-candidates")
    first = written(_confirmed(met, texts, size, least), "led-links")

    roots = grouped(first)
    placed = shared.select("h", "num", "n", "at").join(roots.withColumnRenamed("node", "num"), "num", "left")
    placed = written(placed.withColumn("root", F.coalesce("root", "num")), "placed-shingles")
    discard(shared)
    # where texts of several groups share a shingle, those outside its largest group meet all others
    sizes = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("groups"))
    outside = F.col("members") - F.col("most.n")
    mixed = sizes.where("groups > 1").select("h", F.col("most.root").alias("major"), "members", outside.alias("minor"), F.ceil((F.col("members") / BLOCK)).cast("int").alias("blocks"), F.ceil(outside / BLOCK).cast("int").alias("minor_blocks"))
    mixed = written(mixed, "mixed-shingles")
    open_ = placed.join(mixed, "h").join(both.select("num", F.col("small").alias("sketch")), "num")
    open_ = written(open_, "open-shingles")

    def block(number: str) -> Column:
        return F.pmod(F.xxhash64("num"), F.col(number)).cast("int")

    def every(number: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    # rows of shingles that few texts have share tiles by hash; each pair of a frequent one's blocks is a tile, with a number below 0
    rows = F.when(F.col("members") < OWN_TILE, F.col("minor") + F.col("members"))
    tiles = 1 + (mixed.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]) * 4 // TILE
    tile = F.when(F.col("members") < OWN_TILE, F.pmod(F.xxhash64("h"), F.lit(tiles))).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("h", "i", "j"), 1)).alias("tile")
    columns = ["h", "num", "n", "at", "root", "sketch"]

    def sides() -> tuple[DataFrame, DataFrame]:
        now = open_.withColumn("outside", F.col("root") != F.col("major")).drop("root").join(roots.withColumnRenamed("node", "num"), "num", "left")
        now = now.withColumn("root", F.coalesce("root", "num"))
        left = now.where("outside").withColumns({"i": block("minor_blocks"), "j": every("blocks")})
        right = now.withColumns({"j": block("blocks"), "i": every("minor_blocks")})
        return left.select(*columns, "i", "j", tile), right.select(*[F.col(c).alias(c) for c in columns], "i", "j", tile)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links of ``pairs`` that haven't been confirmed or refused before."""
        more = pairs.select("a", "b").distinct().join(met, ["a", "b"], "left_anti")
        return _confirmed(written(_plausible(more, sketches, least), "candidates"), texts, size, least)

    def all_links(new: DataFrame) -> DataFrame:
        return written(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new), "links")

    # first what connects most, as large groups of near copies have many pairs
    first = _meetings(*sides(), least, False).select("a", "b").distinct().join(met, ["a", "b"], "left_anti")
    first = written(_plausible(first, sketches, least), "candidates")
    roots = grouped(all_links(_confirmed(first, texts, size, least)))
    met = met.unionByName(first)
    left, right = sides()
    handed = written(_meetings(left, right, least, True), "meetings")
    links = all_links(confirmed(handed.where("a >= 0")))
    full = handed.where("a < 0").select("tile", F.col("b").alias("pairs"))
    classes = -(-(full.agg(F.max("pairs")).first()[0] or 0) * 2 // HANDED)
    for of in range(classes):  # tiles with more pairs hand on a class of them at a time, and what is linked by then isn't met again
        roots = grouped(links)
        left, right = (x.join(full.select("tile"), "tile", "left_semi") for x in sides())
        links = all_links(confirmed(_meetings(left, right, least, True, classes, of)))
    discard(placed, open_)
    return links


def _point(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


@F.arrow_udf(BinaryType())
def _points(texts: pa.Array) -> pa.Array:
    return pa.array(map(_point, utf8(texts)), pa.binary())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group of rows that are linked by texts with a similarity of at least ``least``.

    The row with the smallest id stays, of rows with that id one by a hash of the text; rows without an id
    come last. Rows are told apart by their texts, so unrelated texts under one id all stay. Null, empty
    and wordless texts are one group. Texts of any length are compared whole, as the bytes they are, valid UTF-8 or not. Repeated rows are one. An
    empty table gives an empty one. All columns are kept, whatever their names.
    """
    text, ident = named(text_col).cast("string"), named(id_col).cast("long")
    order = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.xxhash64(text).alias("text"))
    rows = written(docs.select(nested(docs), _points(text).alias("point"), order.alias("order"), F.monotonically_increasing_id().alias("num")), "numbered-texts")
    # of equal texts all but the first go, by their numbers: no text is sent for it
    keyed = rows.select("point", F.struct("order.none", "order.id", "order.text", "num").alias("order"))
    best = keyed.groupBy("point").agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("times")).where("times > 1")
    copies = written(keyed.join(best, "point").where("order.num != best.num").select("order.num"), "copies")
    unique = written(rows.join(copies, "num", "left_anti").select("row", "num"), "distinct-texts")
    discard(rows)
    ident, text = F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col).cast("string")
    texts = unique.select("num", text.alias("text"))
    roots = grouped(_links(texts, shingle, least, radius))
    members = roots.select(F.col("node").alias("num"), "root").unionByName(roots.select(F.col("root").alias("num"), "root").distinct())
    order = F.struct(ident.isNull().alias("none"), ident.alias("id"), F.xxhash64(text).alias("text"), "num")
    members = written(unique.select("num", order.alias("order")).join(members, "num").select("root", "order"), "near-groups")
    best = members.groupBy("root").agg(F.min("order").alias("best"))
    dropped = written(members.join(best, "root").where("order.num != best.num").select("order.num"), "near-dropped")
    return unique.join(dropped, "num", "left_anti").select(*unnested(docs))
