from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexitally.functions.stopwords import STOP_WORDS
from lexitally.functions.text import positional_tokens, tokens
from lexitally.operators import batch_counting, counting
from lexitally.operators.batch_counting import partial_counts

CASES = [
    ("", []),
    ("the", ["the"]),
    ("The THE tHe", ["the"] * 3),
    ("don't", ["don", "t"]),
    ("café", ["caf"]),
    ("naïve", ["na", "ve"]),
    ("HTML5 mp3", ["html", "mp"]),
    ("snake_case", ["snake", "case"]),
    ("a-b", ["a", "b"]),
    ("Kelvin", ["elvin"]),
    ("İstanbul", ["stanbul"]),
    ("日本abc語", ["abc"]),
    ("a\0b", ["a", "b"]),
    ("@[`{", []),
    ("x" * 64 + " y" + "z" * 63, ["x" * 64, "y" + "z" * 63]),
    (None, []),
]


def test_words(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, text string")
    got = {i: [] for i in range(len(CASES))}
    for r in positional_tokens(df, "id").orderBy("id", "pos").collect():
        got[r.id].append(r.word)
        assert r.pos == len(got[r.id])
    assert got == {i: words for i, (_, words) in enumerate(CASES)}
    assert tokens(df).count() == sum(len(w) for _, w in CASES)


def test_batches_count_what_the_expressions_give(spark, monkeypatch):
    rows = [t for t, _ in CASES] + ["nul\0l", "Zz" * 5000, "end", "\u00e9a\u0300B"] * 3
    df = texts(spark, *rows).repartition(3)
    expected = Counter(r.word for r in tokens(df).collect())
    assert {r.word: r.cnt for r in partial_counts(df).where("word IS NOT NULL").groupBy("word").sum("cnt").toDF("word", "cnt").collect()} == expected
    for piece, size in ((1, 1), (10, 3), (1 << 21, 2), (64, 1 << 18)):
        for name, value in (("PIECE", piece), ("TABLE", 2 * size), ("NEW", size)):
            monkeypatch.setattr(batch_counting, name, value)
        got, tally = Counter(), batch_counting.Tally()
        sent = [b for some in (rows[2:11], rows[:2], rows[11:]) for b in tally.add([(t or "").encode() for t in some], len(some))]
        for out in (*sent, *tally.rest()):
            for word, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
                got[word] += n
        assert got.pop(None) == len(rows) and +got == expected


def test_the_table_is_bounded(monkeypatch):
    """All words are different but for one of each length: these stay in the table, the others are sent on as they come."""
    monkeypatch.setattr(batch_counting, "TABLE", 1000)
    monkeypatch.setattr(batch_counting, "NEW", 500)
    tally, got, sent = batch_counting.Tally(), Counter(), 0
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    for at in range(0, 40_000, 200):
        text = " ".join(f"hot frequently {name(i)} {name(i)}longer" for i in range(at, at + 200))
        for out in tally.add([text.encode()], 1):
            got.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)))
            sent += len(out)
        assert len(tally.short.keys) <= 1000 and tally.short.many <= 700
        assert sum(map(len, tally.long.parts)) <= 1000 + 700
        assert "hot" not in got and "frequently" not in got
    assert sent > 75_000
    for out in tally.rest():
        got.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)))
    assert got[None] == 200 and got["hot"] == got["frequently"] == 40_000 and len(got) == 80_003


def test_short_words_are_numbers():
    lengths = [b"a" * n for n in range(1, 12)]
    (keys, counts), long = batch_counting.counted(b" ".join([*lengths, b"AAAAAAAA", b"zz"]))
    spelled = batch_counting.spelled(keys, counts).to_pydict()
    assert dict(zip(spelled["word"], spelled["cnt"], strict=True)) == {"a" * n: 1 + (n == 8) for n in range(1, 9)} | {"zz": 1}
    assert sorted(long.column("word").to_pylist()) == [w.decode() for w in lengths[8:]]


def texts(spark, *rows):
    return spark.createDataFrame([(t,) for t in rows], "text string")


def counts(spark, *rows, **kw):
    return {r.word: r.cnt for r in counting.word_counts(texts(spark, *rows), **kw).collect()}


def test_stop_list(spark):
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 68
    assert counts(spark, "ref br the", "a i g q s x u de text") == {"the": 1, "a": 1, "i": 1, "g": 1, "q": 1, "text": 1}
    assert counts(spark, "ref Ref the", stop=False) == {"ref": 2, "the": 1}


@pytest.mark.parametrize("limit, join", [("10MB", "BroadcastHashJoin"), ("-1", "SortMergeJoin")])
def test_stop_list_as_a_table(spark, tmp_path, limit, join):
    """A million words; the counts meet them below their only shuffle, or in it."""
    name = F.concat(F.lit("z"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    spark.range(1_000_000).select(name.alias("word")).unionByName(spark.createDataFrame([("the",), ("the",), (None,)], "word string")).write.parquet(str(tmp_path / "list"))
    listed = spark.read.parquet(str(tmp_path / "list"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        df = counting.word_counts(texts(spark, "The end ZBC zbc zzz", None, "the zjjjjjj"), stop=listed)
        assert {r.word: r.cnt for r in df.collect()} == {"end": 1, "zzz": 1}
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert join in plan and plan.count("Exchange hashpartitioning(word") == (1 if limit == "10MB" else 2)
        if limit == "10MB":
            assert plan.index("Exchange hashpartitioning(word") < plan.index(join)
        marked = counting.marked_counts(texts(spark, "The end", None), stop=listed)
        assert tuple(counting.summary(marked).first()) == (2, 1, 1)
        assert counts(spark, "a the", stop=listed.where("false")) == {"a": 1, "the": 1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_summary_counts_wordless_articles(spark):
    df = texts(spark, "", "12 34", "ref the", "the end")
    row = counting.summary(counting.marked_counts(df)).first()
    assert (row.total_articles, row.total_words, row.unique_words) == (4, 3, 2)
    assert tuple(counting.summary(counting.marked_counts(texts(spark, None, "a"))).first()) == (2, 1, 1)
    empty = texts(spark, "x").where("false")
    assert tuple(counting.summary(counting.marked_counts(empty)).first()) == (0, 0, 0)


@pytest.mark.parametrize("k, expected", [(0, []), (2, [(1, "b", 2) , (2, "aa", 1)]), (9, [(1, "bb", 2), (2, "aa", 1), (3, "cc", 1)])])
def test_top_k(spark, k, expected):
    got = [tuple(r) for r in counting.top_k(counting.word_counts(texts(spark, "bb cc bb aa")), k).orderBy("rank").collect()]
    assert got == [(r, w.replace("b", "bb") if w == "b" else w, c) for r, w, c in expected]


def test_k_must_be_a_count(spark):
    for k in (-1, 1.5, True, "3", 2**31):
        with pytest.raises(ValueError):
            counting.top_k(counting.word_counts(texts(spark, "a")), k)


def test_copies_multiply(spark):
    once, thrice = counts(spark, "one two two"), counts(spark, *["one two two"] * 3)
    assert thrice == {w: 3 * c for w, c in once.items()}
