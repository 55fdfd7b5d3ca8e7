"""Byte-level BPE: encoding and decoding over a global exchange of distinct words, and token counts.

The vocabularies are files of public tokenizers; their paths are parameters.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import Batches
from lexitally.llm.word_exchange import exchange, ragged

#: Positions of a block whose tokens are laid out at a time.
CHUNK_POSITIONS = 500_000
#: From this length on a word is merged with a heap.
LONG_WORD = 128
_NEVER = 1 << 60
_DECODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def heap_merge(symbols: list, lookup: Callable) -> list:
    """Merges the lowest-ranked adjacent pair, the leftmost of equals, until none is left.

    ``lookup(left, right)`` gives ``(rank, merged)`` or None. Neighbours are a linked list over
    positions; the heap holds ``(rank, position)`` and stale entries are passed over.
    """
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at = [_NEVER] * n
    merged_at: list = [None] * n
    heap = []

    def look(i: int) -> None:
        j = after[i]
        found = lookup(symbols[i], symbols[j]) if j < n else None
        if found is None:
            rank_at[i] = _NEVER
        else:
            rank_at[i], merged_at[i] = found
            heapq.heappush(heap, (found[0], i))

    for i in range(n - 1):
        look(i)
    while heap:
        rank, i = heapq.heappop(heap)
        if symbols[i] is None or rank_at[i] != rank:
            continue
        j = after[i]
        symbols[i], symbols[j] = merged_at[i], None
        rank_at[j] = _NEVER
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return [s for s in symbols if s is not None]


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: its own rank if it has one, else byte-pair merges by rank."""
    own = ranks.get(word)
    if own is not None:
        return [own]
    get = ranks.get
    if len(word) >= LONG_WORD:

        def lookup(left: bytes, right: bytes):
            rank = get(left + right)
            return None if rank is None else (rank, left + right)

        return [ranks[p] for p in heap_merge([word[i : i + 1] for i in range(len(word))], lookup)]
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < _NEVER:
        i = pairs.index(best)
        parts[i] += parts[i + 1]
        del parts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], _NEVER)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
    return [ranks[p] for p in parts]


@functools.lru_cache(4)
def _matcher(pattern: str):
    return regex.compile(pattern)


def splitter(pattern: str, special: str = "") -> Callable[[str], list[str]]:
    """Cuts a text into pre-tokens; ``special`` is cut out first and stands for itself."""

    def plain(text: str) -> list[str]:
        return _matcher(pattern).findall(text)

    def around(text: str) -> list[str]:
        if special not in text:
            return _matcher(pattern).findall(text)
        first, *others = text.split(special)
        out = plain(first)
        for part in others:
            out.append(special)
            out += plain(part)
        return out

    return around if special else plain


def _laid_out(ids, sizes, lengths, positions, answers, flat) -> Iterator[dict]:
    """``doc_id`` and ``ids`` of a block's documents, some at a time."""
    start_of, length_of = answers
    ends = np.cumsum(lengths)
    at = 0
    while at < len(ids):
        first = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, first + CHUNK_POSITIONS, "right")))
        words = positions[first : int(ends[to - 1])]
        counts = length_of[words]
        tokens = ragged(flat, start_of[words], counts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        offsets = upto[np.concatenate([[first], ends[at:to]]) - first]
        array = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.astype(np.int32)))
        yield {"doc_id": pa.array(ids[at:to], pa.int64()), "ids": array}
        at = to


def _answerer(content: bytes) -> Callable[[], Callable[[bytes], bytes]]:
    def answerer() -> Callable[[bytes], bytes]:
        ranks = read_ranks(content)
        return lambda word: array("I", encode_word(word, ranks)).tobytes()

    return answerer


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, ids array<int>`` for each row of ``docs``, without special tokens.

    Each match of ``pattern`` is encoded by itself, each distinct one once (again, if a task has forgotten it).
    Null and empty texts have no ids; what isn't valid UTF-8 counts as U+FFFD. Texts of any length are encoded whole: one too long for a block is a block of its own.
    Rows with equal or null ids, and equal rows, stay apart. An empty table gives an empty one. Only the id and
    text columns are read, whatever others are called.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()

    return exchange(docs, id_col, text_col, splitter(pattern), _answerer(content), _laid_out, "doc_id bigint, ids array<int>")


class TokenBytes:
    """A vocabulary's token bytes by id."""

    def __init__(self, content: bytes) -> None:
        by_id = {rank: token for token, rank in read_ranks(content).items()}
        self.lengths = np.zeros(max(by_id) + 1, np.int64)
        for i, token in by_id.items():
            self.lengths[i] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return ragged(self.table, self.starts[ids], self.lengths[ids]).tobytes()

    def columns(self, lists: pa.ListArray, with_bytes: bool) -> dict[str, pa.Array]:
        """What ``decode`` gives of each list of ids."""
        out: dict[str, list] = {"n": [], "ids": [], "text": [], "raw": []}
        for at in range(len(lists)):
            value = lists[at].values
            ids = np.zeros(0, np.int32) if value is None else value.to_numpy(zero_copy_only=False)
            raw = self.of(ids)
            out["n"].append(len(ids))
            out["ids"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["text"].append(hashlib.sha256(raw).hexdigest())
            if with_bytes:
                out["raw"].append(raw)
        columns = {"n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["ids"], pa.string()), "decoded_sha256": pa.array(out["text"], pa.string())}
        return columns | ({"decoded": pa.array(out["raw"], pa.binary())} if with_bytes else {})


@functools.lru_cache(1)
def _token_bytes(content: bytes) -> TokenBytes:
    return TokenBytes(content)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` without the bytes, in the task that lays a block's ids out.

    Two Python functions in one stage need two workers for each task, which an executor keeps from then on.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()

    def finish(*block) -> Iterator[dict]:
        for rows in _laid_out(*block):
            yield {"doc_id": rows["doc_id"]} | _token_bytes(content).columns(rows["ids"], False)

    return exchange(docs, id_col, text_col, splitter(pattern), _answerer(content), finish, _DECODED)


def decode(encoded: DataFrame, vocabulary: str, with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``decoded binary``.

    Ids meet the table of token bytes, which the vocabulary bounds, by position in it. An id that
    isn't in the table is an error. Digests are of the ids as little-endian 32-bit integers and of the
    decoded bytes; a null list counts as empty.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()

    def run(batches: Batches) -> Batches:
        tokens = TokenBytes(content)
        for batch in batches:
            columns = {"doc_id": batch.column(0)} | tokens.columns(batch.column(1), with_bytes)
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, _DECODED + ", decoded binary" * with_bytes)


class MergeCounter:
    """Counts a byte-level BPE's tokens: initial symbols less merges; no ids are made for texts."""

    def __init__(self, content: bytes) -> None:
        model = json.loads(content)
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        self.byte_symbol = [vocabulary[c] for c in byte_letters()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.pairs = {(vocabulary[a] << 32) | vocabulary[b]: (rank << 32) | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"].encode() for t in model["added_tokens"]}

    def __call__(self, word: bytes) -> int:
        """Pops the lowest-ranked adjacent pair off a heap, leftmost first, over a linked list of symbols."""
        if word in self.special:
            return 1
        get, n = self.pairs.get, len(word)
        symbols = [self.byte_symbol[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found >> 32, i, found) for i in range(n - 1) if (found := get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, merge = heapq.heappop(heap)
            if symbols[i] < 0 or (j := after[i]) >= n or get(symbols[i] << 32 | symbols[j]) != merge:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = merge & 0xFFFFFFFF, -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, (found >> 32, i, found))
            if (h := before[i]) >= 0 and (found := get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, (found >> 32, h, found))
        return left


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    A special token's string inside a text is one token, as the library has it by default. Null
    counts as empty: no bytes, no tokens; what isn't valid UTF-8 as U+FFFD, but for ``n_bytes``. The merges of each distinct word are counted once (again, if a task
    has forgotten it). Texts of any length are counted whole; equal ids and equal rows stay separate rows; an
    empty table gives an empty one; columns besides id and text aren't read.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()
    added = [t["content"] for t in json.loads(content)["added_tokens"]]
    if len(added) > 1:
        raise ValueError("more than one added token isn't handled")

    def answerer() -> Callable[[bytes], bytes]:
        count = MergeCounter(content)
        return lambda word: array("I", [count(word)]).tobytes()

    def finish(ids, sizes, lengths, positions, answers, flat) -> Iterator[dict]:
        upto = np.concatenate([[0], np.cumsum(flat[answers[0]].astype(np.int64)[positions])])
        ends = np.cumsum(lengths)
        totals = upto[ends] - upto[ends - lengths]
        yield {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(totals), "over_limit": pa.array(totals > limit)}

    return exchange(docs, id_col, text_col, splitter(pattern, "".join(added)), answerer, finish, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
