import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexitally.llm.quality_rules import CAUTION, OFF, RULES, STEPS, at_most, base_failed, bound_holds, cutoffs, keep_good, measure, measured, mildest_passing, propose, quality_verdicts, steps
from tests.llm.edge import ROWS, documents, no_documents


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    duplicates = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(marked)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t\r\x0b\x0c\x1c\x85\xa0é日#*|<!A1", max_size=80))
def test_base_counts(text):
    assert measure(text.encode())[0] == brute(text)


def labelled(spark, n, seed=1, junk=0.2):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        bad = rng.random() < junk
        words = [rng.choice("abcdefgh") * rng.randint(1, 5) + str(rng.randrange(50)) for _ in range(80)]
        rows.append((i, " ".join(w + "###" if bad else w for w in words), rng.choice(["en", "de", None]), "s", 0))
        labels.append((i, int(not bad)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int"), dict(labels)


def test_junk_goes_and_good_stays(spark):
    df, labels, truth = labelled(spark, 2000)
    got = quality_verdicts(df, labels).collect()
    assert all(r.kept == bool(truth[r.doc_id]) for r in got) and not any(r.base_failed for r in got)
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, v in truth.items() if v}


def test_no_rule_without_evidence(spark):
    df, labels, _ = labelled(spark, 120)
    assert all(r.kept for r in quality_verdicts(df, labels, risk=0.01).collect())
    assert all(r.kept for r in quality_verdicts(df, labels.where("false")).collect())
    assert all(r.kept for r in quality_verdicts(df, labels.selectExpr("doc_id", "cast(null as int) AS quality")).collect())


def test_edge_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (99, 0)], "doc_id bigint, quality int")
    got = quality_verdicts(documents(spark), labels).collect()
    expected = Counter((k, *brute(t)) for k, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality_verdicts(no_documents(spark), labels).collect() == []
    assert keep_good(documents(spark), labels).collect() == []


def test_binomial_is_exact():
    for k, n, p in ((0, 10, Fraction(1, 20)), (3, 50, Fraction(1, 20)), (49, 50, Fraction(1, 2)), (12, 400, Fraction(1, 25))):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(at_most(k, n, float(p)), float(exact), rel_tol=1e-9)
    assert at_most(5, 5, 0.1) == 1 and not bound_holds(0, 0, 0.05, 0.05)
    assert bound_holds(0, 59, 0.05, 0.05) and not bound_holds(0, 58, 0.05, 0.05)


def test_false_rejections_stay_below_the_risk():
    """Whatever is proposed, the settings that pass harm more than ``risk`` of the good in few draws."""
    rng, risk, delta, failures = np.random.default_rng(3), 0.05, 0.1, 0
    chances = np.r_[0.9, np.full(20, 0.005)]  # by excess; true risk of each setting is the tail beyond it
    chances = chances / chances.sum()
    for _ in range(400):
        above = mildest_passing(rng.multinomial(500, chances), risk, delta)
        failures += above is not None and chances[above + 1 :].sum() > risk
    assert failures <= 400 * delta


def test_propose():
    good, bad = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
    good[:20], bad[50] = 5, 30
    assert propose(good, bad) == 50
    assert propose(good, np.zeros(STEPS + 1)) == OFF
    assert propose(good + 1, np.r_[100, np.zeros(STEPS)]) == OFF


def expected_limits(rows, quality, risk=0.05, delta=0.05):
    """The cutoffs from the definitions, one stratum after another, bound by bound."""
    halves = defaultdict(lambda: ([], []))
    texts = defaultdict(list)
    for i, text, lang, *_ in rows:
        if i in quality and not base_failed(*(brute(text)[j] for j in (0, 4))):
            texts[lang, " ".join((text or "").split())].append(quality[i])
    for (lang, text), given in texts.items():
        same = xxhash.xxh3_64_intdigest(text.encode()) >> 1
        halves[lang][in_holdout(same)].append((sum(given) / len(given) >= 0.5, steps(measure(text.encode())[1])))
    tested = {lang: h for lang, h in halves.items() if 0.95 ** sum(g for g, _ in h[1]) <= delta}
    out = {}
    for lang, (half, holdout) in tested.items():
        cut = []
        for rule in range(len(RULES)):
            best, gain = OFF, 0
            for c in range(1, STEPS + 1):
                share = [sum(s[rule] >= c for g, s in half if g == kind) / max(1, sum(g == kind for g, _ in half)) for kind in (False, True)]
                if share[0] - CAUTION * share[1] > 0 and share[0] - CAUTION * share[1] >= gain - 1e-12:
                    best, gain = c, share[0] - CAUTION * share[1]
            cut.append(best)
        good, passing = [s for g, s in holdout if g], None
        for above in range(STEPS, -1, -1):
            hits = sum(any(x >= c + above for x, c in zip(s, cut, strict=True)) for s in good)
            if not bound_holds(hits, len(good), risk, delta / len(tested)):
                break
            passing = above
        if passing is not None:
            out[lang] = [c + passing for c in cut]
    return out


_SPLIT = {}


def in_holdout(same):
    return _SPLIT[same]


def test_cutoffs_and_verdicts_against_brute_force(spark):
    df, labels, quality = labelled(spark, 900, 5)
    rows = [tuple(r)[:5] for r in df.collect()]
    rows += [(2000 + i, rows[i][1], rows[i][2], "s", 0) for i in range(0, 300, 3)]  # copies, some of them labelled otherwise
    quality |= {2000 + i: int(i % 2 == 0) for i in range(0, 300, 3)}
    df = documents(spark, rows)
    labels = spark.createDataFrame(list(quality.items()), "doc_id bigint, quality int")
    hashes = {xxhash.xxh3_64_intdigest(" ".join((r[1] or "").split()).encode()) >> 1 for r in rows}
    split = spark.createDataFrame([(h,) for h in hashes], "same long").withColumn("half", F.pmod(F.xxhash64(F.lit("holdout"), "same"), F.lit(2)))
    _SPLIT.update({r.same: r.half for r in split.collect()})
    limits = expected_limits(rows, quality)
    found = cutoffs(measured(df, "doc_id", "text", "lang"), labels).collect()
    assert {r.stratum: r.limits for r in found} == {"" if k is None else f"={k}": v for k, v in limits.items()} and len(limits) == 3
    kept = Counter()
    for i, text, lang, *_ in rows:
        base, measures = measure((text or "").encode())
        kept[i, not base_failed(base[0], base[4]) and not any(x >= c for x, c in zip(steps(measures), limits.get(lang, [OFF] * len(RULES)), strict=True))] += 1
    assert Counter((r.doc_id, r.kept) for r in quality_verdicts(df, labels).collect()) == kept


def test_many_strata_are_tested_one_by_one(spark):
    """Each of 1,200 languages by itself: those with few or no labels have no rules, however many there are."""
    rows, quality = [], {}
    for i in range(2400):
        rows.append((i, " ".join(f"w{i}x{j}" + "###" * (i % 2) for j in range(60)), f"l{i % 1200}", "s", 0))
        quality[i] = 1
    for i in range(2400, 4000):
        bad = i % 4 == 0
        rows.append((i, " ".join(f"w{i}x{j}" + "###" * bad for j in range(60)), "rich", "s", 0))
        quality[i] = int(not bad)
    labels = spark.createDataFrame(list(quality.items()), "doc_id bigint, quality int")
    got = {r.doc_id: r.kept for r in quality_verdicts(documents(spark, rows), labels).collect()}
    assert got == {i: i < 2400 or i % 4 != 0 for i in range(4000)}


def test_names_that_clash(spark):
    df, labels, truth = labelled(spark, 800)
    odd = df.select("doc_id", "text", "lang", *[F.lit(i).alias(n) for i, n in enumerate(("row", "limits", "__text", "__keep", "__stratum", "a.b", "same"))])
    kept = keep_good(odd, labels)
    assert kept.columns == odd.columns and {(r.doc_id, r["a.b"]) for r in kept.collect()} == {(k, 5) for k, v in truth.items() if v}
