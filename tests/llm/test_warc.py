import base64
import glob
import gzip
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexitally.llm import warc
from lexitally.llm.warc import captures, parse, read_records, round_trip, write_archives
from tests.llm.edge import CLASHING

BIG, OTHER = "payload \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 40, "é" * 500
ROWS = [
    (1, "http://a.example/x y?q", BIG),
    (2, "http://b.example/\r\nInjected: yes", BIG),
    (3, None, BIG),
    (4, "no scheme", "small"),
    (5, "http://é.example/ü", "small"),
    (6, "http://c.example", None),
    (7, "http://c.example", ""),
    (8, "http://d.example/", OTHER),
    (8, "http://d.example/", OTHER),
    (9, "http://d.example/", OTHER + "!"),
    (None, "http://n.example/", BIG),
    (None, "http://n.example/", "\r\n\r\n"),
    (10, "http://e.example/", "x" * 999),
    (11, "http://e.example/", "x" * 999),
    (12, "http://e.example/", "x" * 1000),
    (13, "http://e.example/", "x" * 1000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({n: F.lit(1) for n in CLASHING})


def expected(rows):
    largest = defaultdict(lambda: None)
    for key, _, html in rows:
        if key is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(key, largest[html] or key)
    out = Counter()
    for key, _, html in rows:
        raw = (html or "").encode()
        first = largest[html]
        stored = first is None or key == first
        out[key, len(raw), hashlib.sha1(raw).hexdigest(), "response" if stored else "revisit", None if stored else first] += 1
    return out


def test_round_trip(spark):
    got = round_trip(pages(spark), with_payload=True).collect()
    assert Counter((r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.kind, r.metadata.refers_to_page) for r in got) == expected(ROWS)
    assert all(r.request is not None for r in got)
    for r in got:
        if r.response.kind == "response":
            assert hashlib.sha1(bytes(r.response.payload)).hexdigest() == r.response.payload_digest
    named = {r.response.record_id: r.page_id for r in got if r.response.kind == "response"}
    assert all(named[r.response.refers_to] == r.metadata.refers_to_page for r in got if r.response.kind == "revisit")


def test_files_are_warc(spark, tmp_path):
    write_archives(pages(spark), f"file://{tmp_path}/w")
    kinds = Counter()
    for name in glob.glob(f"{tmp_path}/w/part-*"):
        for _, headers, block in parse(gzip.open(name)):
            kinds[headers["warc-type"]] += 1
            assert len(block) == int(headers["content-length"]) and "injected" not in headers
            if headers["warc-type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                assert headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            elif headers["warc-type"] != "revisit":
                assert headers["warc-concurrent-to"].startswith("<urn:uuid:")
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == len(ROWS)


def test_damage_is_noticed():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(at, block) for at, _, block in parse(good * 2)] == [(0, b"abc"), (len(good), b"abc")]
    for bad in (good[:-1], good.replace(b"3", b"2"), b"x" + good):
        with pytest.raises(ValueError):
            list(parse(bad))


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Pages of 1 MB that don't compress: a file has a few of them, and each record is a gzip member."""
    monkeypatch.setattr(warc, "FILE_BYTES", 2 << 20)
    rng = random.Random(5)
    rows = [(i, f"http://a.example/{i}", "".join(rng.choices("0123456789abcdef", k=1 << 20))) for i in range(12)]
    path = f"file://{tmp_path}/w"
    write_archives(pages(spark, rows).coalesce(1), path)
    files = glob.glob(f"{tmp_path}/w/part-*")
    assert len(files) >= 3 and all(os.path.getsize(f) < 3 << 20 for f in files)
    for name in files:
        data, members = open(name, "rb").read(), 0
        while data.strip(b"\0"):
            unpack = zlib.decompressobj(31)
            assert unpack.decompress(data).startswith(b"WARC/1.1") and unpack.eof
            data, members = unpack.unused_data, members + 1
        assert members == len(list(parse(gzip.open(name))))
    got = captures(read_records(spark, path)).collect()
    assert Counter((r.page_id, bytes(r.response.payload).decode()) for r in got) == Counter((i, html) for i, _, html in rows)


def test_other_archives_are_read(spark, tmp_path):
    """Plain files, and gzip over whole files."""
    write_archives(pages(spark), f"file://{tmp_path}/w")
    expected = captures(read_records(spark, f"file://{tmp_path}/w")).count()
    for kind, pack in (("plain", bytes), ("whole", gzip.compress)):
        (tmp_path / kind).mkdir()
        for i, name in enumerate(glob.glob(f"{tmp_path}/w/part-*")):
            (tmp_path / kind / f"part-{i}").write_bytes(pack(gzip.open(name).read()))
        assert captures(read_records(spark, f"file://{tmp_path}/{kind}")).count() == expected == len(ROWS)


def test_missing_records_and_empty(spark, tmp_path):
    write_archives(pages(spark, ROWS[:3]), f"file://{tmp_path}/w")
    records = read_records(spark, f"file://{tmp_path}/w")
    got = captures(records.where("kind <> 'request'")).collect()
    assert len(got) == 3 and all(r.request is None and r.metadata is not None for r in got)
    assert captures(records.where("kind = 'request'")).count() == 0
    assert round_trip(pages(spark).where("false")).collect() == []
