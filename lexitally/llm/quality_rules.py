"""Quality rules whose cutoffs carry a guarantee: risk-controlled thresholds.

Each rule rejects texts whose measure is at or above a cutoff. Labelled texts, equal ones counted once, are
halved by a hash of the text, so that no text is on both sides. One half proposes, for each stratum (language)
and rule, the cutoff that catches most at little harm. The other, the holdout, decides how far a stratum may go
there: all its rules together are tested from the mildest setting on (each cutoff the same number of steps above
its proposal), and a setting passes while the exact binomial (Clopper-Pearson) upper bound of its false
rejections is at most ``risk``. Testing stops at the first that fails, so this order needs no correction;
Bonferroni's covers the strata. With chance ``1 - delta`` at least, the rules reject at most ``risk`` of the good
texts of every stratum that pass the base rules.

Every stratum is tested by itself. One with fewer good texts in its holdout than the bound needs even if none is
rejected is never tested: its rules are off, and it doesn't count among the tests.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import Batches, named, nested, source_key, unnested, utf8
from lexitally.sources.workdir import written

#: Fixed by the base rules: what separates words, and the signs counted as symbols.
SPACE, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
_BESIDE = SPACE + bytes(range(0x80, 0xC0))  # with these taken out each code point of a word leaves one byte
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Cutoffs are these many steps of a measure's full scale.
STEPS = 200
#: In a proposal a false rejection weighs so many catches.
CAUTION = 5.0
#: A cutoff that no text reaches.
OFF = 10 * STEPS

#: Rules: a measure of the text and the value at its full scale.
RULES = {
    "symbol_share": 1.0,
    "duplicate_line_share": 1.0,
    "repeated_word_share": 1.0,
    "upper_word_share": 1.0,
    "exclamations_a_word": 2.0,
    "bars_a_word": 1.0,
    "top_word_share": 1.0,
    "same_as_previous_share": 1.0,
    "digit_share": 1.0,
    "word_length": 40.0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more, its first place included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, marked = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if times[window] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = 1
    return sum(marked)


def measure(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the rules' measures of a whole text."""
    words = text.split()  # bytes are split at just the six characters of SPACE
    n = len(words)
    chars = len(text.translate(None, _BESIDE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    duplicates = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    per_word = 1 / max(1, n)
    measures = (
        symbols / max(1, chars),
        duplicates / max(1, len(lines)),
        repeated * per_word,
        sum(map(bytes.isupper, words)) * per_word,
        text.count(b"!") * per_word,
        text.count(b"|") * per_word,
        max(Counter(words).values(), default=0) * per_word if n >= LEAST_WORDS else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) * per_word,
        (len(text) - len(text.translate(None, b"0123456789"))) / max(1, chars),
        chars * per_word,
    )
    return (n, chars, symbols, duplicates, repeated), measures


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def steps(measures: tuple[float, ...]) -> list[int]:
    """Each measure as a step of its scale, 0 to STEPS."""
    return [min(STEPS, int(STEPS * m / scale)) for m, scale in zip(measures, RULES.values(), strict=True)]


def measured(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """``doc_id, stratum``, the base counts, ``base_failed``, ``steps array<int>`` and ``same``, a hash of the words, for each row."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found, same = [], []
            for text in utf8(batch.column(2)):
                found.append(measure(text))
                same.append(xxhash.xxh3_64_intdigest(b" ".join(text.split())) >> 1)
            base = [pa.array([b[i] for b, _ in found], pa.int64()) for i in range(len(BASE))]
            failed = pa.array([base_failed(b[0], b[4]) for b, _ in found], pa.bool_())
            level = pa.array([steps(m) for _, m in found], pa.list_(pa.int32()))
            same = pa.array(same, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *base, failed, level, same], names=["doc_id", "stratum", *BASE, "base_failed", "steps", "same"])

    slim = docs.select(named(id_col).cast("long").alias("doc_id"), stratum(stratum_col), named(text_col).cast("string").alias("text"))
    ddl = "doc_id long, stratum string, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, steps array<int>, same long"
    return slim.mapInArrow(run, ddl)


def stratum(column: str) -> Column:
    return source_key(named(column).cast("string")).alias("stratum")


def at_most(k: int, n: int, p: float) -> float:
    """The chance of at most ``k`` hits in ``n`` trials of chance ``p``."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.cumsum(np.r_[0.0, np.log(n - i[:-1]) - np.log(i[1:])]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def bound_holds(k: int, n: int, risk: float, delta: float) -> bool:
    """Whether the exact upper bound, at confidence 1 - delta, of a rate with k hits in n is at most ``risk``."""
    return n > 0 and at_most(k, n, risk) <= delta


def propose(good: np.ndarray, bad: np.ndarray) -> int:
    """A rule's cutoff from the counts of good and bad documents by step; OFF if none does more good than harm."""
    gain = np.cumsum(bad[::-1])[::-1] / max(1, bad.sum()) - CAUTION * np.cumsum(good[::-1])[::-1] / max(1, good.sum())
    best = int(np.flatnonzero(gain[1:] >= gain[1:].max() - 1e-12)[-1]) + 1  # the mildest of equals
    return best if gain[best] > 0 else OFF


def mildest_passing(excess: np.ndarray, risk: float, delta: float) -> int | None:
    """How far above the proposals all cutoffs must stay, from the holdout's counts by excess.

    ``excess[e]`` counts good documents whose worst measure is e - 1 steps above its proposal (0: below
    all). None: not even the mildest setting passes.
    """
    n, last = int(excess.sum()), None
    beyond = np.cumsum(excess[::-1])[::-1]
    for above in range(len(excess) - 1, -1, -1):
        if not bound_holds(int(beyond[above + 1]) if above + 1 < len(excess) else 0, n, risk, delta):
            break
        last = above
    return last


def least_trials(risk: float, delta: float) -> int:
    """Trials from which on the bound can hold, namely with no hit."""
    n = 1
    while not bound_holds(0, n, risk, delta):
        n += 1
    return n


def cutoffs(features: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``stratum, limits``: the cutoff of each rule, a row for each stratum that was tested and passed.

    ``labels`` has ``doc_id, quality``; of a document labelled several times, and of a text that several
    documents have, the mean counts (half and more is good), null labels don't. Rows stay on the executors:
    tables of counts by step are decided there too.
    """
    labels = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality")).where("quality IS NOT NULL")
    known = features.where("NOT base_failed").join(labels, "doc_id")
    known = known.groupBy("stratum", "same").agg((F.avg("quality") >= 0.5).alias("good"), F.min("steps").alias("steps"))
    known = known.withColumn("holdout", F.pmod(F.xxhash64(F.lit("holdout"), "same"), F.lit(2)) == 1)
    known = written(known, "rule-labelled")
    least = least_trials(risk, delta)
    tested = known.where("holdout AND good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    tested = written(tested.select("stratum"), "rule-strata")
    tests = max(1, tested.count())
    known = known.join(tested, "stratum", "left_semi")

    def proposals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = (np.bincount(rows.step[rows.good == g], weights=rows.n[rows.good == g], minlength=STEPS + 1) for g in (True, False))
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cutoff": [propose(good, bad)]})

    counts = known.where("NOT holdout").select("stratum", "good", F.posexplode("steps").alias("rule", "step"))
    counts = counts.groupBy("stratum", "good", "rule", "step").agg(F.count(F.lit(1)).alias("n"))
    proposed = counts.groupBy("stratum", "rule").applyInPandas(proposals, "stratum string, rule int, cutoff int")
    proposed = written(proposed.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("rule", "cutoff"))).alias("r")).select("stratum", F.col("r.cutoff").alias("cutoffs")), "rule-proposals")
    over = F.array_max(F.transform(F.arrays_zip("steps", "cutoffs"), lambda x: x["steps"] - x["cutoffs"]))
    held = known.where("holdout AND good").join(proposed, "stratum").select("stratum", F.greatest(over + 1, F.lit(0)).alias("excess"))
    held = held.groupBy("stratum", "excess").agg(F.count(F.lit(1)).alias("n"))

    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        excess = np.bincount(rows.excess, weights=rows.n, minlength=STEPS + 2)
        above = mildest_passing(excess, risk, delta / tests)
        return pd.DataFrame({"stratum": [key[0]], "above": [OFF if above is None else above]})

    passed = held.groupBy("stratum").applyInPandas(decide, "stratum string, above int").where(F.col("above") < OFF)
    limits = proposed.join(passed, "stratum").select("stratum", F.expr("transform(cutoffs, c -> c + above)").alias("limits"))
    return written(limits, "rule-limits")  # so that Spark knows its size, and only broadcasts it below its limit


def rejected(level: Column, limits: Column) -> Column:
    """Whether any rule's step reaches its cutoff; without cutoffs, none does."""
    return limits.isNotNull() & F.exists(F.arrays_zip(level.alias("step"), limits.alias("cutoff")), lambda x: x["step"] >= x["cutoff"])


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for each row.

    Null and wordless texts fail the base rules; texts of any length are measured whole. Null strata are one
    stratum. With too few labels to bound a stratum's risk its rules are off: no document is rejected on thin evidence.
    Rows with equal or null ids and equal rows are judged one by one. An empty table gives an empty one. Other
    columns aren't read.
    """
    features = written(measured(docs, id_col, text_col, stratum_col), "rule-measures")
    judged = features.join(cutoffs(features, labels, risk, delta), "stratum", "left")
    kept = ~F.col("base_failed") & ~rejected(F.col("steps"), F.col("limits"))
    return judged.select("doc_id", *BASE, "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged, judged as ``quality_verdicts`` does.

    All columns are kept, whatever their names. The texts are measured twice rather than shuffled.
    """
    features = written(measured(docs, id_col, text_col, stratum_col), "rule-measures")
    limits = cutoffs(features, labels, risk, delta)

    @F.arrow_udf("boolean")
    def good(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, limits in parts:
            keep = []
            for text, limit in zip(utf8(texts), limits.to_pylist(), strict=True):
                base, measures = measure(text)
                keep.append(not base_failed(base[0], base[4]) and not (limit and any(s >= c for s, c in zip(steps(measures), limit, strict=True))))
            yield pa.array(keep, pa.bool_())

    keyed = docs.select(nested(docs), stratum(stratum_col)).join(limits, "stratum", "left")
    return keyed.where(good(F.col("row").getField(text_col).cast("string"), F.col("limits"))).select(*unnested(docs))
