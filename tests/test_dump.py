import bz2
import gzip
import random
import re
import subprocess
import sys
from collections import Counter

import pytest

from lexitally.functions.stopwords import STOP_WORDS
from lexitally.plans.word_frequency import analyze
from lexitally.operators import counting
from lexitally.sources.dump import Edge, articles_from, body_within, read_dump

CASES = [
    ("<page><text>one</text></page>", ["one"]),
    ('<page><title>T</title><text xml:space="preserve">one</text></page>', ["one"]),
    ('<page id="1"><text>one</text></page>', []),
    ("<PAGE><text>one</text></PAGE>", []),
    ("<page><text></text></page>", [""]),
    ('<page><text bytes="0" /></page>', []),
    ("<page><text/><x>two</x><text>one</text></page>", ["<x>two</x><text>one"]),
    ("<page><text>one</text><text>two</text></page>", ["one"]),
    ("<page><textarea>one</text></page>", ["one"]),
    ('<page><text a="x>y">one</text></page>', ['y">one']),
    ("<page>none</page>", []),
    ("<page><text>one</page>", []),
    ("<page><text>one</text>", []),
    ("<page><text>one</text></page><page><text>two</text>", ["one"]),
    ("<page>a<page><text>one</text></page>", ["one"]),
    ("junk</page><page><text>one</text></page>", ["one"]),
    ('<page><text\n a="1"\n>one\ntwo</text></page>', ["one\ntwo"]),
    ("<page><text>one &quot;two&quot; &apos;</text></page>", ["one &quot;two&quot; &apos;"]),
    ("", []),
    ("<page>a<text>no<page><text>one</text></page><page><text>two</text></page>", ["no<page><text>one", "two"]),
    ("<page><text>one</text><page><page></page><text>two</text></page>", ["one"]),
    ("</page><text>one</text></page>", []),
    ("<mediawiki><page><text>one</text></page>\r\n<page><text>two</text></page></mediawiki>", ["one", "two"]),
]


def model(data: bytes) -> list[bytes]:
    """The scan as a loop over one file."""
    out, at = [], 0
    while (start := data.find(b"<page>", at)) >= 0 and (end := data.find(b"</page>", start)) >= 0:
        if found := re.search(rb"(?s)<text[^>]*>(.*?)</text>", data[start:end]):
            out.append(found[1])
        at = end + 7
    return out


def scan(spark, path, split=None):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split or 1 << 27))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return sorted(r.text for r in read_dump(spark, str(path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


PACK = {"": bytes, ".gz": gzip.compress, ".bz2": bz2.compress}


def counted(spark, path, split=None):
    """Articles, words without the stop list, and counts, by the one reading."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split or 1 << 27))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = {r.word: r.cnt for r in counting.dump_counts(spark, str(path), stop=False).collect()}
        return found.pop(None, 0), found
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def words(bodies):
    return len(bodies), Counter(w.decode().lower() for b in bodies for w in re.findall(rb"[A-Za-z]+", b))


@pytest.mark.parametrize("suffix", PACK)
def test_cases(spark, tmp_path, suffix):
    """Each case in a file of its own: as rows, and as counts."""
    for number, (text, expected) in enumerate(CASES):
        (tmp_path / f"{number}.xml{suffix}").write_bytes(PACK[suffix](text.encode()))
        assert [x.decode() for x in model(text.encode())] == expected
    assert scan(spark, tmp_path) == sorted(t for _, e in CASES for t in e)
    assert counted(spark, tmp_path) == words([t.encode() for _, e in CASES for t in e])
    got = analyze(spark, str(tmp_path), 0)
    kept = [w for _, e in CASES for t in e for w in re.findall("[A-Za-z]+", t.lower()) if w not in STOP_WORDS]
    assert (got.total_articles, got.total_words, got.unique_words) == (sum(len(e) for _, e in CASES), len(kept), len(set(kept)))


def test_splits_do_not_matter(spark, tmp_path):
    """Pages that splits cut anywhere, also open ones that others go on with, and splits within which nothing is closed."""
    rng = random.Random(7)
    parts = ["<page>", "</page>", "<text>", "<text a='1'>", "</text>", "<text/>", "word ", "é\n", "\r\n", "<pa", "ge>"]
    files = ["".join(rng.choice(parts) for _ in range(120)) for _ in range(3)] + ["".join(c for c, _ in CASES[:6]) * 5]
    files += ["".join(rng.choice(["<page>", "<page><text>", "word ", "other ", "</text>"] + ["</page>"] * (i > 1)) for _ in range(60)) for i in range(4)]
    for i, text in enumerate(files):
        (tmp_path / f"{i}.xml").write_bytes(text.encode())
    bodies = [x for t in files for x in model(t.encode())]
    for split in (9, 64):
        assert scan(spark, tmp_path, split) == sorted(x.decode() for x in bodies)
        assert counted(spark, tmp_path, split) == words(bodies)


def test_splits_of_compressed_files(spark, tmp_path):
    cut = "<page><text>é one</text></page>\n" * 3000 + "<page><text>last</text>"
    for suffix in (".gz", ".bz2"):
        (tmp_path / f"a.xml{suffix}").write_bytes(PACK[suffix](cut.encode()))
    (tmp_path / "odd [1]{2}*?.xml").write_bytes(cut.encode())
    for split in (200, 1 << 20):
        assert scan(spark, tmp_path, split) == ["é one"] * 9000
        assert counted(spark, tmp_path, split) == (9000, {"one": 9000})
    twice = str(tmp_path / "a.xml.gz")
    assert counting.dump_counts(spark, [twice, twice]).where("word = 'one'").first().cnt == 6000


@pytest.mark.parametrize("suffix", PACK)
def test_one_reading(spark, tmp_path, suffix):
    """Neither the driver nor another scan looks at a file: what the scans read is the pieces, once."""
    (tmp_path / f"a.xml{suffix}").write_bytes(PACK[suffix](b"<x><page><text>one two</text></page><page><text>one"))
    df = counting.dump_counts(spark, str(tmp_path))
    assert {r.word: r.cnt for r in df.collect()} == {None: 1, "one": 1, "two": 1}
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan text") == 1 and "Reused" in plan
    spark.sparkContext.setJobGroup(f"analysis{suffix}", "")
    try:
        assert analyze(spark, str(tmp_path), 5).top == [(1, "one", 1), (2, "two", 1)]
        tracker = spark.sparkContext.statusTracker()
        ran = [i for j in tracker.getJobIdsForGroup(f"analysis{suffix}") for i in tracker.getJobInfo(j).stageIds]
        store = spark.sparkContext._jsc.sc().statusStore()
        read = [store.lastStageAttempt(i).inputRecords() for i in ran if tracker.getStageInfo(i)]  # others were skipped
        assert sum(read) == 3
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_edges_have_names_in_order():
    edges = [Edge("a", 1, False, b"\0x\xff"), Edge("a", 1, True, b""), Edge("a", 16, False, b"0"), Edge("b", 0, True, b"\0\0")]
    assert [Edge.named(e.name()) for e in edges] == edges == sorted(edges, key=Edge.name)


def test_totals_count_once(tmp_path):
    """A task of each stage fails the first time: the observed totals are of the tasks that count."""
    (tmp_path / "d.xml").write_bytes(b"<page><text>one two one ref</text></page>" * 300)
    code = f"""
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from lexitally.operators import counting
from lexitally.plans.word_frequency import observed
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
def once(batches):
    rows = list(batches)
    if TaskContext.get().attemptNumber() == 0:
        raise OSError("lost")
    yield from rows
marked = counting.dump_counts(spark, {str(tmp_path)!r})
marked = marked.mapInArrow(once, "word string, cnt long")
n, top = observed(marked, 1)
assert n == dict(total_articles=300, total_words=900, unique_words=2), n
assert top == [(1, "one", 600)], top
spark.stop()
"""
    assert subprocess.run([sys.executable, "-c", code], timeout=300).returncode == 0


def test_bodies_agree(spark):
    rng = random.Random(11)
    parts = ["<page>", "<text>", "<text a='1'>", "</text>", "<text/>", "word ", ">", "é\n"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, m string")
    got = {r.id: r.text for r in articles_from(df, "m").collect()}
    raw, at = "".join(rows).encode(), 0
    for i, row in enumerate(rows):
        end = at + len(row.encode())
        page = raw.find(b"<page>", at, end)
        body = body_within(raw, page, end) if page >= 0 else None
        assert (None if body is None else raw[body[0] : body[1]].decode()) == got.get(i), row
        at = end


def test_markup_in_a_column(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, m string")
    got = {r.id: r.text for r in articles_from(df, "m").collect()}
    assert got[4] == "" and got[9] == 'y">one' and 5 not in got and 2 not in got


def test_analyze_and_invalid_bytes(spark, tmp_path):
    (tmp_path / "d.xml").write_bytes(b"<page><text>x\xc3Bee bee ref</text></page><page><text></text></page>")
    got = analyze(spark, str(tmp_path / "d.xml"), 5)
    assert (got.total_articles, got.total_words, got.unique_words) == (2, 2, 1)
    assert got.top == [(1, "bee", 2)]
    assert "Top 5 Words:" in str(got)
