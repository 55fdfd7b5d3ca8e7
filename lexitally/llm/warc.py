"""WARC archives: writing captures, reading them back, and putting captures together again.

A capture is three records: request, response (or revisit) and metadata. The request and the
metadata name the response they belong to in ``WARC-Concurrent-To``.

Files: each record is a gzip member of its own, as the format has it. A task puts members together up to a file's
bounds of bytes and records, and Spark's text writer writes each such row into a file of its own, in any store that Spark
reaches; the zero byte that it ends a row with is padding to gzip. The reader takes the bytes of a file, unpacks
them as it goes, record by record, and goes by ``Content-Length``, whatever a payload holds.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.llm.common import Batches, join_counted, named
from lexitally.sources.workdir import shared_folder, until_exit

EOL = "\r\n"
#: Fixed by the format: the version line and the profile of a revisit with an identical payload.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always stored.
LEAST_REVISIT = 1000
#: A file is full at so many bytes (compressed) or records; a larger record is a file by itself.
FILE_BYTES, RECORDS_A_FILE = 16 << 20, 3000
#: Bytes of payloads and records that the reader hands on at a time.
BATCH_BYTES, BATCH_RECORDS = 8 << 20, 500
#: The writing time belongs to no capture here; a fixed one keeps reruns alike.
DATE = "2024-01-01T00:00:00Z"

_RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("concurrent_to", pa.string()),
        ("kind", pa.string()),
        ("target_uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("page_id", pa.int64()),
        ("refers_to_page", pa.int64()),
        ("file", pa.string()),
        ("position", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_RECORD_DDL = (
    "record_id string, concurrent_to string, kind string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes bigint, page_id bigint, refers_to_page bigint, file string, position bigint, payload binary"
)


def record_id(kind: str, *parts: Column) -> Column:
    """A URN made from what the record stands for, so that reruns write the same."""
    text = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    cuts = [F.substr(text, F.lit(at), F.lit(n)) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def base32(hexadecimal: Column) -> Column:
    """A SHA-1 in base 32, as WARC writes it: each 5 hex digits are 4 letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for at in range(1, 41, 5):
        number = F.conv(F.substr(hexadecimal, F.lit(at), F.lit(5)), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(kind: Column | str, ident: Column, uri: Column, more: Column, content_type: Column | str, block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    content_type = F.lit(content_type) if isinstance(content_type, str) else content_type
    head = [
        F.lit(VERSION + EOL + "WARC-Type: "), kind,
        F.lit(EOL + "WARC-Record-ID: "), ident,
        F.lit(EOL + "WARC-Date: " + DATE + EOL + "WARC-Target-URI: "), uri,
        F.lit(EOL), more,
        F.lit("Content-Type: "), content_type,
        F.lit(EOL + "Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(EOL + EOL), block,
    ]
    return F.concat(*head)


def deduplicated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (``page_id, url, payload``) with ``sha1``, ``bytes`` and ``first``, id and url of the page to refer to.

    Of pages with equal payloads of at least ``least`` bytes that with the largest id is the first; it
    and all others that need no reference have null. Rows that share the largest id are all stored.
    """
    keyed = pages.withColumns({"sha1": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    slim = keyed.where(F.col("bytes") >= least).select("sha1", "page_id", "url")
    same = slim.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    found = join_counted(keyed, same.where("n > 1 AND first.page_id IS NOT NULL"), "sha1", "n", pages.count(), "left")
    return found.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first")))


def records(captures: DataFrame) -> DataFrame:
    """``value``: the text of every WARC record of ``captures`` (as ``deduplicated`` gives them), less its two line ends.

    A URI's line ends and other control characters are written as in a URL (%0D and so on), since
    headers are lines.
    """
    uri = F.coalesce(F.col("url").cast("string"), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(uri, r"[\x00-\x20\x7F]", "%20"), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    uri = F.regexp_replace(uri, r"[\x00-\x20\x7F]", "%20")
    ident = record_id("response", F.col("page_id"), F.col("url"), F.col("sha1"))
    stored = F.col("first").isNull()
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1")), F.lit(EOL))
    refers = F.concat(F.lit("WARC-Refers-To: "), record_id("response", F.col("first.page_id"), F.col("first.url"), F.col("sha1")), F.lit(EOL + f"WARC-Profile: {PROFILE}" + EOL))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL + EOL))
    response = _record(
        F.when(stored, F.lit("response")).otherwise(F.lit("revisit")), ident, uri,
        F.concat(digest, F.when(stored, F.lit("")).otherwise(refers)), "application/http;msgtype=response",
        F.concat(http, F.when(stored, F.col("payload")).otherwise(F.lit(""))),
    )
    belongs = F.concat(F.lit("WARC-Concurrent-To: "), ident, F.lit(EOL))
    ask = F.concat(F.lit("GET "), F.when(F.length(path) > 0, path).otherwise(F.lit("/")), F.lit(" HTTP/1.1" + EOL + EOL))
    request = _record("request", record_id("request", F.col("page_id"), F.col("url"), F.col("sha1")), uri, belongs, "application/http;msgtype=request", ask)
    fields = F.concat(*[x for name, c in (("page-id: ", F.col("page_id")), ("refers-to-page: ", F.col("first.page_id"))) for x in (F.lit(name), F.coalesce(c.cast("string"), F.lit("")), F.lit(EOL))])
    metadata = _record("metadata", record_id("metadata", F.col("page_id"), F.col("url"), F.col("sha1")), uri, belongs, "application/warc-fields", fields)
    return captures.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a capture for every row of ``pages`` into gzipped WARC files below ``path``.

    Null html is an empty payload, a null url an empty one, a null id an empty field; repeated ids and rows are
    captures of their own. Payloads of any length are written whole. An empty table gives no records. Other columns
    aren't read.
    """
    slim = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"), F.coalesce(named(html_col).cast("string"), F.lit("")).alias("payload"))

    def files(batches: Batches) -> Batches:
        members, size = [], 0
        for batch in batches:
            for record in batch.column(0).cast(pa.binary()).to_pylist():
                members.append(gzip.compress(record + b"\r\n\r\n", 6, mtime=0))
                size += len(members[-1])
                if size >= FILE_BYTES or len(members) >= RECORDS_A_FILE:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])

    out = records(deduplicated(slim)).mapInArrow(files, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 1).text(path, lineSep="\x00")


def parse(data: bytes | BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(position, headers by lower-case name, block)`` of each record of an unpacked WARC file, one after another."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while True:
        at, first = stream.tell(), stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers.get("content-length", -1)))
        if not line or "content-length" not in headers or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where its Content-Length says")
        yield at, headers, block


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record below ``path``; digests and sizes of stored payloads are of what was read.

    Files may be gzipped, record by record or as a whole, or plain. A stored payload that doesn't match its digest is
    an error. A revisit's size is that of its HTTP header.
    """

    def run(batches: Batches) -> Batches:
        rows, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = io.BytesIO(content.as_buffer())
                packed = content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b"
                for found in parse(gzip.GzipFile(fileobj=stream) if packed else stream):
                    rows.append(_row(name, *found, with_payload))
                    size += len(rows[-1].get("payload") or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, _RECORD_DDL)


def _row(file: str, at: int, headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = headers["warc-type"]
    row = {"record_id": headers["warc-record-id"], "concurrent_to": headers.get("warc-concurrent-to"), "kind": kind, "target_uri": headers.get("warc-target-uri"), "file": file, "position": at}
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        row["payload_digest"], row["payload_bytes"] = stated, len(payload)
        if kind == "response":
            if hashlib.sha1(payload).hexdigest() != stated:
                raise ValueError(f"{file}, {at}: the payload doesn't match its digest")
            row["payload"] = payload if with_payload else None
        else:
            length = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
            row["payload_bytes"] = int(length[0])
            row["refers_to"] = headers["warc-refers-to"]
    elif kind == "metadata":
        fields = dict(line.split(": ", 1) for line in block.decode().split(EOL) if line)
        row["page_id"], row["refers_to_page"] = (int(fields[n]) if fields[n] else None for n in ("page-id", "refers-to-page"))
    return row


def captures(found: DataFrame) -> DataFrame:
    """One nested row ``page_id, request, response, metadata`` for each capture among WARC records.

    Requests and metadata join the response (or revisit) that they are concurrent to. Where
    captures are repeated, and so their names, the first of each kind belong together, and so on.
    A capture that lacks a request or metadata has null there.
    """
    part = F.when(F.col("kind") == "revisit", F.lit("response")).otherwise(F.col("kind"))
    # one shuffle, by name, serves the numbering and the join
    placed = found.withColumns({"name": F.coalesce("concurrent_to", "record_id"), "part": part}).repartition("name")
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("name", "part").orderBy("file", "position")))

    def of(kind: str, *columns: str) -> Column:
        return F.first(F.when(F.col("part") == kind, F.struct(*columns)), ignorenulls=True).alias(kind)

    out = placed.groupBy("name", "nth").agg(
        of("request", "record_id", "target_uri"),
        of("response", "record_id", "kind", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"),
        of("metadata", "record_id", "page_id", "refers_to_page"),
    )
    return out.where("response IS NOT NULL").select(F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata")


def round_trip(pages: DataFrame, path: str | None = None, with_payload: bool = False) -> DataFrame:
    """Writes ``pages`` as archives and reads the captures back. Without a path they are below the shared folder until the driver ends."""
    spark, own = pages.sparkSession, path is None
    path = path or shared_folder(spark, "warc")
    write_archives(pages, path)
    if own:
        until_exit(spark, path)
    return captures(read_records(spark, path, with_payload))
