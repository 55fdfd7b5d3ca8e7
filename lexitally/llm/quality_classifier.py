"""A quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are hashed words and word beginnings (each once) and hashed shapes of words with the
share they have in the text. All grades share one weight a feature; ordered thresholds t(1) < t(2) < ... cut the score s
into grades: P(grade >= k) = 1 / (1 + exp(t(k) - s)). The expected grade is the sum of these tails.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import Batches, named, nested, utf8
from lexitally.sources.workdir import written

BITS = 18
#: Bytes of a word's beginning.
BEGINNING = 4
#: Labelled rows that are used of each grade, at most: the fit's only bound.
ROWS_A_GRADE = 4000
#: The L2 penalty is PRIOR over the rows of the sample. Rounds of the fit at most, pairs of steps that it remembers, and
#: the length of the gradient, against that at the start, at which it ends.
PRIOR, ROUNDS, REMEMBERED, SETTLED = 0.5, 120, 12, 1e-3
#: A feature must occur in so many rows of the sample, and in so large a share of them; of more such features than
#: MOST_FEATURES the most frequent are used.
LEAST_ROWS, LEAST_SHARE, MOST_FEATURES = 3, 1 / 300, 1 << 15
#: Numbers of rows that the fit works on at a time.
PART = 1 << 19
#: Words whose features a task remembers.
KEPT_WORDS = 120_000

_EDGES = b".,;:!?\"'()[]|*#$%&<>-"
_SHAPE = bytes(0x58 if 0x41 <= b <= 0x5A else 0x78 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUN = re.compile(rb"([Xx9])\1+")


class Features(dict):
    """A text's features as distinct numbers below 2**BITS. Remembers words: ``word -> (numbers, shape)``."""

    def __missing__(self, word: bytes) -> tuple[tuple[int, int], bytes]:
        if len(self) > KEPT_WORDS:
            self.clear()
        bare = word.strip(_EDGES).lower()
        if word.isalpha() and (word.islower() or word.isupper()):  # ASCII letters of one case: no need to look closer
            shape = b"x" if word.islower() else b"X"
        else:
            shape = _RUN.sub(rb"\1", word.translate(_SHAPE))[-8:]
        self[word] = value = ((self.number(b"w" + bare), self.number(b"b" + bare[:BEGINNING])), shape)
        return value

    @staticmethod
    def number(feature: bytes) -> int:
        return zlib.crc32(feature) & ((1 << BITS) - 1)

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        found, shapes = set(), Counter()
        for word, times in Counter(words).items():
            numbers, shape = self[word]
            found.update(numbers)
            shapes[shape] += times
        n = max(1, len(words))
        for shape, times in shapes.items():
            # a shape counts once it makes up a 32nd of the text, at each doubling of its share again
            share = 1 / 32
            while times >= share * n and share <= 1:
                found.add(self.number(b"s%d " % round(1 / share) + shape))
                share *= 2
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        for part in range(1, 9):
            if same * 10 >= part * n:
                found.add(self.number(b"r%d" % part))
        return np.fromiter(found, np.int32, len(found))


@dataclass
class OrdinalModel:
    """``weights`` of the features and the ascending ``thresholds`` of grades 1, 2 and so on."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """A row for each score: P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


class Likelihood:
    """The penalised negative log-likelihood of graded rows, which hold numbers below ``size``.

    Parameters: a weight for each number, the first threshold and the logarithms of the gaps between thresholds.
    """

    def __init__(self, rows: list[np.ndarray], size: int, grades: np.ndarray, weight: np.ndarray, top: int) -> None:
        self.size, self.top, self.grades, self.weight, self.decay = size, top, grades, weight / weight.sum(), PRIOR / len(rows)
        # some rows at a time: their numbers, which of them hold any, and where each one's begin
        self.parts, at = [], 0
        lengths = np.array([len(r) for r in rows])
        upto = np.cumsum(lengths)
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] - lengths[at] + PART, "right")))
            filled = at + np.flatnonzero(lengths[at:to])
            if len(filled):
                self.parts.append((np.concatenate(rows[at:to]).astype(np.int32), filled, (upto - lengths)[filled] - (upto - lengths)[at], lengths[filled]))
            at = to

    def thresholds(self, value: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[value[self.size], np.exp(value[self.size + 1 :])])

    def at(self, value: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and its gradient."""
        grades, n = self.grades, np.arange(len(self.grades))
        score, by_number = np.zeros(len(n)), np.zeros(self.size)
        for flat, filled, begins, _ in self.parts:
            score[filled] = np.add.reduceat(value[flat], begins)
        tail = 1 / (1 + np.exp(np.clip(self.thresholds(value)[None, :] - score[:, None], -50, 50)))
        full = np.c_[np.ones(len(n)), tail, np.zeros(len(n))]
        p = np.maximum(full[n, grades] - full[n, grades + 1], 1e-12)
        slope = full * (1 - full)  # of each tail by the score; 0 at both ends
        by_score = -self.weight * (slope[n, grades] - slope[n, grades + 1]) / p
        by_cut = np.zeros((len(n), self.top + 2))
        by_cut[n, grades] += self.weight * slope[n, grades] / p
        by_cut[n, grades + 1] -= self.weight * slope[n, grades + 1] / p
        onward = np.cumsum(by_cut[:, 1:-1].sum(axis=0)[::-1])[::-1]  # a gap moves all later thresholds
        weights = value[: self.size]
        loss = -(self.weight * np.log(p)).sum() + self.decay / 2 * (weights**2).sum()
        for flat, filled, _, lengths in self.parts:
            by_number += np.bincount(flat, weights=np.repeat(by_score[filled], lengths), minlength=self.size)
        return float(loss), np.r_[by_number + self.decay * weights, onward[0], onward[1:] * np.exp(value[self.size + 1 :])]


def minimised(function, value: np.ndarray) -> np.ndarray:
    """Limited-memory BFGS with a step that is halved until the loss falls enough."""
    loss, gradient = function(value)
    start, steps = np.linalg.norm(gradient), []
    for _ in range(ROUNDS):
        if np.linalg.norm(gradient) <= SETTLED * start:
            break
        direction, shares = -gradient, []
        for s, y in reversed(steps):
            shares.append((s @ direction) / (s @ y))
            direction = direction - shares[-1] * y
        if steps:
            direction = direction * (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), share in zip(steps, reversed(shares), strict=True):
            direction = direction + (share - (y @ direction) / (s @ y)) * s
        slope, length = gradient @ direction, 1.0 if steps else 1 / max(1e-12, start)
        while True:
            new = value + length * direction
            new_loss, new_gradient = function(new)
            if new_loss <= loss + 1e-4 * length * slope or length < 1e-12:
                break
            length /= 2
        s, y = new - value, new_gradient - gradient
        if s @ y > 1e-14:
            steps = [*steps, (s, y)][-REMEMBERED:]
        if new_loss >= loss:
            break
        value, loss, gradient = new, new_loss, new_gradient
    return value


def frequent(counts: np.ndarray, rows: int) -> np.ndarray:
    """The features that are used, ascending, from the rows of the sample that hold each."""
    used = np.flatnonzero(counts >= max(LEAST_ROWS, LEAST_SHARE * rows))
    return np.sort(used[np.lexsort((used, -counts[used]))][:MOST_FEATURES])


def fit(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, top: int) -> OrdinalModel:
    """Maximum likelihood with a small L2 penalty. ``grades`` are 0 to ``top``; rows hold features."""
    size = 1 << BITS
    if not len(rows):
        return OrdinalModel(np.zeros(size, np.float32), np.arange(-top, 0) * 10.0)
    counts = np.zeros(size, np.int64)
    for row in rows:
        counts[row] += 1
    used = frequent(counts, len(rows))
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    model = Likelihood([at[at >= 0] for at in (place[r] for r in rows)], len(used), grades, weight, top)
    start = np.zeros(len(used) + top)
    start[len(used)] = -1.0
    value = minimised(model.at, start)
    weights = np.zeros(size, np.float32)
    weights[used] = value[: len(used)]
    return OrdinalModel(weights, model.thresholds(value))


def train(docs: DataFrame, ratings: DataFrame, top: int, rows_a_grade: int = ROWS_A_GRADE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """A model from ``ratings`` (``doc_id, grade`` from 0 to ``top``), at most ``rows_a_grade`` of each, by hash of the id.

    Of several ratings of a document the lowest counts; null ones don't. Of several texts with one id the
    first in order is read; null counts as empty. Weights restore the grades' shares in all ratings. Without any
    ratings every text gets the top grade. Features of whole texts are counted and cut to the used ones by tasks;
    what comes to the driver is bounded by MOST_FEATURES counts and, for each row of the sample, its used
    features as numbers or as MOST_FEATURES bits, whichever is shorter.
    """
    known = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    totals = {r.grade: r.n for r in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit("train"), "doc_id")
    chosen = None
    for grade in range(top + 1):
        part = known.where(F.col("grade") == grade).orderBy(order, "doc_id").limit(rows_a_grade)
        chosen = part if chosen is None else chosen.unionByName(part)

    def run(batches: Batches) -> Batches:
        features = Features()
        for batch in batches:
            rows = [np.sort(features.of(t)).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["grade", "features"])

    # the sample has at most (top + 1) * rows_a_grade ids, so it is broadcast and no text is shuffled
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")
    sample = written(texts.mapInArrow(run, "grade int, features binary"), "rated-features")

    def tally(batches: Batches) -> Batches:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for row in batch.column(0):
                counts[np.frombuffer(row.as_buffer(), np.int32)] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["feature", "n"])

    n = sample.count()
    seen = sample.select("features").mapInArrow(tally, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    seen = seen.where(F.col("n") >= max(LEAST_ROWS, LEAST_SHARE * n)).orderBy(F.desc("n"), "feature").limit(MOST_FEATURES).toArrow()
    used = np.sort(seen.column("feature").to_numpy()).astype(np.int32)

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            rows = [packed(np.flatnonzero(np.isin(used, np.frombuffer(row.as_buffer(), np.int32), assume_unique=True))) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["grade", "features"])

    taken = sorted((r.grade, bytes(r.features)) for r in sample.mapInArrow(cut, "grade int, features binary").collect())
    grades = np.array([g for g, _ in taken], np.int64)
    count = np.bincount(grades, minlength=top + 1)
    weight = np.array([totals[g] / count[g] for g in grades])
    return fit([used[unpacked(f)] for _, f in taken], grades, weight, top)


def packed(places: np.ndarray) -> bytes:
    """Ascending numbers below MOST_FEATURES, as they are or as bits."""
    if 2 * len(places) <= MOST_FEATURES // 8:
        return b"n" + places.astype("<u2").tobytes()
    bits = np.zeros(MOST_FEATURES, np.uint8)
    bits[places] = 1
    return b"b" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"n":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def grade(docs: DataFrame, model: OrdinalModel, select: int, least: float = 0.5, text_col: str = "text", names: tuple[str, str, str] = ("expected_grade", "tail_probability", "kept")) -> DataFrame:
    """``docs`` with the expected grade, the tail probability (of grade ``select`` or better) and whether it is kept.

    The columns are called ``names`` and replace any of these names. A row is kept if the tail is at
    least ``least``. Null counts as an empty text; texts without words have no features and go by the
    thresholds alone; texts of any length are read whole. Rows with equal or null ids and equal rows are judged one by one.
    An empty table gives an empty one.
    """
    expected, likely, kept = names
    found = docs.select(nested(docs), _graded(model, select)(named(text_col).cast("string")).alias("grade"))
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in names]
    tail = F.col("grade.tail")
    return found.select(*others, F.col("grade.expected").alias(expected), tail.alias(likely), (tail >= least).alias(kept))


def _graded(model: OrdinalModel, select: int):
    """A function of texts: ``expected`` grade and ``tail`` probability. Only the texts go to Python."""
    thresholds, weights = model.thresholds, model.weights

    @F.arrow_udf("expected double, tail double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, graded = Features(), OrdinalModel(weights, thresholds)
        for part in parts:
            tails = graded.tails(np.array([weights[features.of(t)].sum(dtype=np.float64) for t in utf8(part)], float))
            yield pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tails[:, select - 1])], ["expected", "tail"])

    return run


def keep_graded(docs: DataFrame, model: OrdinalModel, select: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that reach grade ``select``, unchanged, judged as ``grade`` does; all columns are kept, whatever their names."""
    return docs.where(_graded(model, select)(named(text_col).cast("string")).getField("tail") >= least)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from labels: 0 of low quality, 1 good but toxic, 2 good; null labels give null."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
