import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexitally.llm.sharding import interleaved_shards
from tests.llm.edge import ROWS, documents, no_documents

SF = "/root/testdata/sf0.001"


def brute(spark, df, shards):
    rows = df.select("doc_id", "text", "source", F.xxhash64(F.lit(42), F.col("doc_id"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long")).alias("hash")).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    placed = []
    for source, members in by_source.items():
        members.sort(key=lambda r: (r.hash, -1 if r.doc_id is None else r.doc_id))
        for rank, r in enumerate(members):
            placed.append(((rank + 0.5) / len(members), "" if source is None else "=" + source, r.hash, r))
    placed.sort(key=lambda p: p[:3])
    out = Counter()
    for at, (*_, r) in enumerate(placed):
        shard = at * shards // len(placed)
        out[r.doc_id, shard, at - -(-shard * len(placed) // shards)] += 1
    return out


def test_against_brute_force(spark):
    for df, shards in ((spark.read.parquet(f"{SF}/documents.parquet"), 7), (documents(spark), 3), (documents(spark), 40)):
        got = Counter((r.doc_id, r.shard, r.slot) for r in interleaved_shards(df, shards).collect())
        assert got == brute(spark, df, shards)


def test_shards_match_the_mixture(spark):
    rows = [(i, f"t{i}", None, "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(3000)]
    got = interleaved_shards(documents(spark, rows), 10).collect()
    assert set(Counter(r.shard for r in got).values()) == {300}
    for source, n in Counter(r[3] for r in rows).items():
        inside = Counter(r.shard for r in got if r.source == source)
        assert all(abs(inside[s] - n / 10) <= 1 for s in range(10))


def test_sizes(spark):
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in interleaved_shards(documents(spark), 4).collect())
    assert got == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in ROWS)
    assert interleaved_shards(no_documents(spark), 4).collect() == []
