"""Operator 9: WARC archives with segmented records, written by Spark and reassembled.

An archive is a gzipped text file of Spark whose line separator is the CR LF CR LF that
ends every WARC record, so any store Spark can write to will do. A payload travels as an
HTTP response in chunked transfer framing. A response longer than the segment size becomes
a first segment and continuation records, which a reader gathers by the origin's record
id, orders by segment number, checks against the stated total length and unframes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

EOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
BROADCAST_ROWS = 100_000  # repeated payloads up to which the pages themselves are not shuffled
UNSAFE = re.compile("[\x00-\x20\x7f<>]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes, chunk: int) -> bytes:
    """HTTP response with the payload in chunks; they end between characters."""
    out = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for part in cuts(payload, chunk):
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def unframe(block: bytes) -> bytes:
    """Payload of an HTTP response; ValueError where the chunk framing does not hold."""
    at = block.find(b"\r\n\r\n")
    if at < 0:
        raise ValueError("no end of HTTP headers")
    if b"transfer-encoding: chunked" not in block[:at].lower():
        return block[at + 4 :]
    at, out = at + 4, []
    while True:
        end = block.index(b"\r\n", at)
        size = int(block[at:end].split(b";")[0], 16)
        at = end + 2 + size
        if block[at : at + 2] != b"\r\n":
            raise ValueError("chunk of another length")
        if not size:
            return b"".join(out)
        out.append(block[end + 2 : at])
        at += 2


def cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most ``size`` bytes (4 at least) that never split a UTF-8 character."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def record(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    head += [(k, v) for k, v in fields if v is not None] + [("Content-Length", len(block))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block.decode()


def write_warc(
    pages: DataFrame,
    path: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    segment: int = 8192,
    chunk: int = 4096,
    records_per_file: int = 4000,
) -> str:
    """Write one record a row (or its segments) and return the folder.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is
    a response and the others are revisits; shorter ones are responses. A null payload counts
    as empty; a null id never names a response that others revisit; repeated rows of the
    smallest id are all responses. A very long payload is written in segments; columns other than
    the three play no part, whatever their names; an empty table writes no record."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    # Only payloads that occur again are looked up; the rest of the pages meet no partner.
    again = (
        rows.where(F.octet_length("html") >= min_bytes)
        .groupBy(F.col("digest").alias("again"))
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("again", "first")
    )
    again = materialize(again, "again")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = rows.join(again, F.col("digest") == F.col("again"), "left")
    rows = rows.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        space = uuid.uuid5(uuid.NAMESPACE_URL, path)
        for batch in batches:
            out = []
            for page, url, html, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                name, n = uuid.uuid5(space, f"{part}/{n}"), n + 1
                payload = html.encode()
                url = None if url is None else UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
                about = [("WARC-Target-URI", url), ("X-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
                about.append(("Content-Type", "application/http;msgtype=response"))
                if first is not None:
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    out.append(record("revisit", str(name), [*about, ("WARC-Profile", profile), ("X-Refers-To-Page-ID", first)], b""))
                    continue
                block = frame(payload, chunk)
                if len(block) <= segment:
                    out.append(record("response", str(name), about, block))
                    continue
                parts = list(cuts(block, segment))
                out.append(record("response", str(name), [*about, ("WARC-Segment-Number", 1)], parts[0]))
                for k, piece in enumerate(parts[1:], 2):
                    total = len(block) if k == len(parts) else None
                    fields = [("WARC-Segment-Origin-ID", f"<urn:uuid:{name}>"), ("WARC-Segment-Number", k)]
                    fields.append(("WARC-Segment-Total-Length", total))
                    out.append(record("continuation", str(uuid.uuid5(name, str(k))), fields, piece))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    written = rows.mapInArrow(records, "value string").write
    written.option("lineSep", EOR).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)
    return path


PARSED = (
    "origin string, record_type string, page_id long, refers_to long, payload_digest string, segment int, total long, block binary"
)


def parse(archive: bytes) -> Iterator[tuple]:
    """(origin, type, page, refers_to, digest, segment or None, total or None, block) of each record."""
    at = 0
    while at < len(archive):
        if archive[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = archive.index(b"\r\n\r\n", at)
        fields = {}
        for line in archive[at:end].decode().split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        at = end + 4 + size
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        number = {k: int(v) if (v := fields.get(k)) is not None else None for k in NUMBERS}
        yield (
            fields.get("warc-segment-origin-id") or fields["warc-record-id"],
            fields["warc-type"],
            number["x-page-id"],
            number["x-refers-to-page-id"],
            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            number["warc-segment-number"],
            number["warc-segment-total-length"],
            archive[end + 4 : end + 4 + size],
        )
        at += 4


NUMBERS = ("x-page-id", "x-refers-to-page-id", "warc-segment-number", "warc-segment-total-length")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_type, payload_digest, refers_to, payload`` of the archives in ``path``.

    A revisit has no payload. Fails where segments are missing or repeated, the total length
    or the framing does not hold, or a payload is not what its digest says."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for row in parse(gzip.decompress(content.as_py())):
                    rows.append(row)
                    size += len(row[-1])
                    if size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".gz")).select("content")
    whole = files.mapInArrow(records, PARSED)
    first = [F.max(c).alias(c) for c in ("page_id", "refers_to", "payload_digest", "total")]
    kind = F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type")
    parts = F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts")
    gathered = whole.groupBy("origin").agg(*first, kind, parts)
    return gathered.mapInArrow(_assemble, "page_id long, record_type string, payload_digest string, refers_to long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in PARSED.split(", ")]
    )


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]
            numbers = [p["segment"] for p in parts]
            block = b"".join(p["block"] for p in parts)
            if numbers != [None] and (numbers != list(range(1, len(parts) + 1)) or row["total"] != len(block)):
                raise ValueError(f"segments of {row['origin']}: {numbers}, {len(block)} of {row['total']} bytes")
            payload = None if row["record_type"] == "revisit" else unframe(block)
            if payload is not None and base32_sha1(payload) != row["payload_digest"]:
                raise ValueError(f"payload of {row['origin']} is not what its digest says")
            out.append((row["page_id"], row["record_type"], row["payload_digest"], row["refers_to"], payload))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "record_type", "payload_digest", "refers_to", "payload"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def warc_digests(records: DataFrame) -> DataFrame:
    """One row a page: a revisit's size is that of the response it refers to."""
    rows = records.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").alias("own"))
    full = rows.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("own").alias("n"))
    again = rows.where("record_type = 'revisit'").join(full, F.col("payload_digest") == F.col("d"), "left")
    kept = ["page_id", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type <> 'revisit'").select(*kept, F.col("own").cast("long").alias("payload_bytes")).unionByName(
        again.select(*kept, F.col("n").cast("long").alias("payload_bytes"))
    )
