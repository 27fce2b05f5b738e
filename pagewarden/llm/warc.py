"""WARC archives written from, and read back into, a chunked record table.

Write: a payload is cut into rows (record, chunk number, bytes) of at most `chunk` bytes; SHA-1 runs over the chunks as
they are cut. Records of equal payload digests and lengths meet in a pre-aggregated sum that finds the largest id: that
record is the response, the others are revisits without payload, and only rows without payloads are shuffled to find
them. Every chunk row becomes one WARC/1.1 record: the first chunk a `response`, later ones `continuation` records with
WARC-Segment-Number and the origin's id, which is the format's own way to cut an oversized record. Spark's text writer
puts them into gzip-compressed archives of at most `per_file` records, ended by the two line breaks that end a record.
A file is one gzip member: Spark has no sink for bytes, which one member for each record would need.

Read: Spark's text reader inflates an archive as a stream, cut at double line breaks; the pieces are put together by
Content-Length, and a block is passed on when it is complete, so memory is one chunk and neither one record nor one
archive. Records of one chunk are digested at once and their payloads dropped; segments are sorted by record and number
and carried through an incremental digest, one hash state at a time.

Defined cases: a null payload is empty; a null url is written as an empty target; null ids are written as such and count
as smaller than all others; rows that share payload and largest id are all responses; an empty table gives an empty
archive; payloads of any length are cut. Equal payloads means equal SHA-1 and length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, staged, table

CHUNK = 1 << 18
PER_FILE = 2_000
#: Rows of revisits (two ids and a record number each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
END = b"\r\n\r\n"
CHUNKS = "record long, page_id long, url string, chunk int, chunks int, total long, digest string, body string"


def base32_sha1(h) -> str:
    return base64.b32encode(h.digest()).decode()


def _cut(size: int):
    """record numbers rows within the staged table; the digest of a payload is on all of its chunk rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "page_id", "url", "chunk", "chunks", "total", "digest", "body"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for record, page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                raw = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                cuts = [0]
                while cuts[-1] < len(raw):
                    e = min(cuts[-1] + size, len(raw))
                    while e < len(raw) and raw[e] & 0xC0 == 0x80:  # chunks end between characters
                        e -= 1
                    cuts.append(e)
                digest = hashlib.sha1()
                for s, e in zip(cuts, cuts[1:], strict=False):
                    digest.update(raw[s:e])
                done, n = base32_sha1(digest), max(1, len(cuts) - 1)
                for k in range(n):
                    body = bytes(raw[cuts[k] : cuts[k + 1]]).decode("utf-8") if len(raw) else ""
                    held += len(body)
                    for c, v in zip(out, (record, page_id, url, k, n, len(raw), done, body), strict=True):
                        c.append(v)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                        out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return each


def chunked(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """(page_id, url, html) to the chunked record table, staged."""
    p = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return staged(p.mapInArrow(_cut(size), CHUNKS), "warc-chunks")


def with_types(chunks: DataFrame, least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds record_type, refers_to and refers_record: the largest page_id of equal payloads is the response that the others revisit.

    The rows that find the revisits hold no payloads; payloads are shuffled only where revisits are too many to broadcast.
    """
    heads = chunks.filter((F.col("chunk") == 0) & (F.col("total") >= least_bytes)).select("record", "page_id", "digest", "total")
    last = heads.groupBy("digest", "total").agg(F.max(F.struct("page_id", "record")).alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = heads.join(last, ["digest", "total"]).filter(~F.col("page_id").eqNullSafe(F.col("last.page_id")))
    pairs = staged(pairs.select("record", F.col("last.page_id").alias("refers_to"), F.col("last.record").alias("refers_record")), "warc-revisits")
    j = chunks.join(F.broadcast(pairs) if pairs.count() <= broadcast_rows else pairs, "record", "left")
    return j.withColumn("record_type", F.when(F.col("refers_record").isNotNull(), "revisit").otherwise("response"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))


def _id(page: Column, record: Column, chunk: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat(F.lit("<urn:page:"), text(page), F.lit(":"), text(record), F.lit(":"), text(chunk), F.lit(">"))


def records(typed: DataFrame) -> DataFrame:
    """Every chunk row as the text of a WARC record; revisits keep their first row only, without payload."""
    revisit, first, last = F.col("record_type") == "revisit", F.col("chunk") == 0, F.col("chunk") + 1 == F.col("chunks")
    cut = (F.col("chunks") > 1) & ~revisit
    body = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    only = lambda when, *c: F.when(when, F.concat(*c)).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")), _field("WARC-Record-ID", _id(F.col("page_id"), F.col("record"), F.col("chunk"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), _field("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        only(first, _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.lit("Content-Type: text/html\r\n"), _field("X-Payload-Length", F.col("total"))),
        only(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), _field("WARC-Refers-To", _id(F.col("refers_to"), F.col("refers_record"), F.lit(0)))),
        only(cut, _field("WARC-Segment-Number", F.col("chunk") + 1)), only(cut & ~first, _field("WARC-Segment-Origin-ID", _id(F.col("page_id"), F.col("record"), F.lit(0)))),
        only(cut & last, _field("WARC-Segment-Total-Length", F.col("total"))), _field("Content-Length", F.octet_length(body)),
    )
    return typed.filter(~revisit | first).select(F.concat(head, F.lit("\r\n"), body).alias("value"))


def write_archives(pages: DataFrame, path: str, chunk: int = CHUNK, per_file: int = PER_FILE, least_bytes: int = 0) -> None:
    out = records(with_types(chunked(pages, chunk), least_bytes))
    out.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def blocks(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each WARC record of a file that arrives in pieces. Holds one record's block and one piece at most.

    A file ends with the double line break that cuts pieces. After a payload that ends in a line break the cuts fall one
    line break early, and the last piece, which has no cut behind it, comes with one too many.
    """
    held = bytearray()
    source = iter(pieces)

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        at = held.find(END)
        while at < 0:
            if not need(len(held) + 1):
                if held.strip():
                    raise ValueError("archive ends inside a record's header")
                return
            at = held.find(END)
        if not at and not need(len(END) + 1):
            return
        head = dict(x.split(": ", 1) for x in held[:at].decode().split("\r\n")[1:])
        length = int(head["Content-Length"])
        if not need(at + 4 + length + 4) or held[at + 4 + length : at + 8 + length] != END:
            raise ValueError("record does not end where its length says")
        yield head, bytes(held[at + 4 : at + 4 + length])
        del held[: at + 8 + length]


PARSED = "record long, page_id long, url string, type string, segment int, segmented boolean, total long, digest string, refers_to long, body binary, found string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of archives, in order, to their records. Only what is one of several segments keeps its bytes."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    number = lambda x: None if x == "null" else int(x)
    out: list[list] = [[] for _ in names]
    held = 0
    rows = ((file, piece) for b in batches for piece, file in zip(b.column(0), b.column(1).to_pylist(), strict=True))
    for head, body in (r for _, file in groupby(rows, itemgetter(0)) for r in blocks(x.as_buffer().to_pybytes() + END for _, x in file)):
        _, _, page, record, segment = head["WARC-Record-ID"].strip("<>").split(":")
        kind, cut = head["WARC-Type"], "WARC-Segment-Number" in head
        ref = head["WARC-Refers-To"].strip("<>").split(":")[2] if kind == "revisit" else "null"
        found = base32_sha1(hashlib.sha1(body)) if kind == "response" and not cut else None
        total = int(head["X-Payload-Length"]) if "X-Payload-Length" in head else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if "WARC-Payload-Digest" in head else None
        row = (int(record), number(page), head["WARC-Target-URI"], kind, int(segment), cut, total, digest, number(ref), body if cut else None, found)
        held += 100 + len(body) * cut
        for c, v in zip(out, row, strict=True):
            c.append(v)
        if held > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
            out, held = [[] for _ in names], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each WARC record, staged: the digest of payloads that are one chunk, the bytes of other chunks.

    A gzip file is read by one task from start to end, so its pieces arrive in order.
    """
    pieces = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.gz").text(path)
    return staged(pieces.select("value", F.xxhash64("_metadata.file_path").alias("file")).mapInArrow(_parse, PARSED), "warc-records")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by record and segment: the digest and length of each record, one hash state at a time."""
    last, state, size = None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([base32_sha1(state)]), pa.array([size], pa.int64())], ["record", "whole", "size"])

    for b in batches:
        for record, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if record != last:
                if state is not None:
                    yield done()
                last, state, size = record, hashlib.sha1(), 0
            raw = body.as_buffer()
            state.update(raw)
            size += len(raw)
    if state is not None:
        yield done()


def digests(parsed: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; fails if a payload's digest is not its header's.

    Revisits have the length and digest of the payload that they stand for, which their headers carry.
    """
    heads = parsed.filter(F.col("type") != "continuation").select("record", "page_id", "type", "segmented", "total", "digest", "refers_to", "found")
    cut = parsed.filter("segmented").select("record", "segment", "body")
    whole = cut.repartition("record").sortWithinPartitions("record", "segment").select("record", "body").mapInArrow(_fold, "record long, whole string, size long")
    j = heads.join(whole, "record", "left").withColumn("seen", F.when(F.col("type") == "response", F.coalesce("whole", "found")).otherwise(F.col("digest")))
    good = (F.col("seen") == F.col("digest")) & (F.col("size").isNull() | (F.col("size") == F.col("total")))
    checked = F.when(good, F.col("seen")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs from the header of record "), F.col("record").cast("string"))).cast("string"))
    return j.select("page_id", F.col("total").alias("payload_bytes"), checked.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return digests(read_archives(spark, path))


# Base-32 digests have no DuckDB function, but a digest is five-bit pieces of the hash's bits.
OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
m AS (SELECT n, hex, max(page_id) AS last_id FROM h GROUP BY n, hex)
SELECT page_id, CAST(h.n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h.hex, k * 5 + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31) AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM h JOIN m ON h.n = m.n AND h.hex = m.hex
"""
