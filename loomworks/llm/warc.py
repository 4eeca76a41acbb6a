"""Operator 8: WARC archives with revisit resolution.

Plan
1. One scan makes headers: page, length and digest of the payload.  Headers alone are shuffled by digest; the original of
   equal payloads (the largest page_id) is a map-side combined maximum, so a payload of any number of copies is one row a task.
2. Headers join their originals; a header whose page is not the original is a revisit.
3. Payloads are shuffled once, by page, into archives of about ARCHIVE bytes, and meet their decision there.  Originals are
   written whole, revisits as a header that refers to the original, all with fresh headers.
4. Each record is a gzip member of its own, so an archive can be entered at any record.  Members are written by Spark's text
   writer, on any file system and under its commit protocol.  The line separator that it puts after each is an empty member,
   which holds no bytes: unpacked, the files are WARC as they stand.
5. Reading back unpacks an archive member by member, and follows Content-Length, so payloads may hold anything, and
   archives of one member, or of none, are read too.

Defined results: a null html is an empty payload.  Rows that repeat page_id and payload are equally the original: each is written
as a response, under a record id of its own; revisits refer to the first.  A null page_id is smaller than any.  A null url has no target header.  Payloads under `least` bytes are all
responses.  An empty table gives an empty archive folder and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import buckets_for, fresh_path

ARCHIVE = 16 << 20
LINE = "\r\n"
#: Bytes of packed records that go on together.
BATCH = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: four times 40 bits as 8 digits of base 32, in the alphabet of RFC 4648."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """headers (page, no_page, digest, bytes) with original (page) and record_type, once for each page and digest."""
    first = headers.where(F.col("bytes") >= least).groupBy("digest").agg(F.max(F.struct((~F.col("no_page")).alias("named"), F.col("page"))).alias("o"))
    first = first.select("digest", F.when(F.col("o.named"), F.col("o.page")).alias("original"))
    rows = headers.groupBy("page", "no_page", "digest").agg(F.first("bytes").alias("bytes")).join(first, "digest", "left")
    own = (F.col("bytes") < least) | F.when(F.col("no_page"), F.col("original").isNull()).otherwise(F.col("page").eqNullSafe(F.col("original")))
    return rows.select("page", "no_page", "digest", F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("original")).alias("original"))


def record_id(page: int | None, digest: str, copy: int = 0) -> str:
    """The id of the record of a page and payload; `copy` tells repeated rows apart."""
    name = hashlib.md5(f"{'-' if page is None else page}:{digest}{f':{copy}' if copy else ''}".encode()).hexdigest()
    return f"<urn:uuid:{uuid.UUID(name)}>"


def member(data: bytes) -> bytes:
    """A gzip member without a time, so that equal records are equal bytes."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


#: Stands after each record in an archive.
EMPTY = member(b"")


def _pack(batches, date: str):
    """Each row as a gzip member that holds its record.  Repeats of a page and payload are in one partition."""
    copies: Counter = Counter()
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("page", "no_page", "digest", "bytes", "url", "record_type", "original")), batch["payload"])
        out, size = [], 0
        for page, no_page, digest, n, url, kind, original, payload in rows:
            page, own = None if no_page else page, kind == "response"
            fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page, digest, copies[page, digest])), ("WARC-Date", date)]
            copies[page, digest] += 1
            if url is not None:
                fields.append(("WARC-Target-URI", url.replace("\r", " ").replace("\n", " ")))
            fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
            if not own:
                fields += [("WARC-Refers-To", record_id(original, digest)), ("WARC-Profile", PROFILE)]
                fields += [("X-Refers-To-Page", original)] * (original is not None)
            fields += [("X-Page-ID", page)] * (page is not None)
            fields += [("X-Payload-Length", n), ("Content-Type", "text/html"), ("Content-Length", n if own else 0)]
            head = LINE.join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields), "", ""]).encode()
            out.append(member(head + (payload.as_buffer().to_pybytes() if own else b"") + 2 * LINE.encode()))
            size += len(out[-1])
            if size > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0) -> None:
    """Writes one record per row of pages (page_id, url, html) to archives in the folder."""
    html = F.coalesce("html", F.lit(""))
    page = [F.coalesce("page_id", F.lit(0)).cast("long").alias("page"), F.col("page_id").isNull().alias("no_page")]
    size, digest = F.octet_length(html).cast("long").alias("bytes"), base32_sha1(html).alias("digest")
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    decided = resolve(pages.select(*page, digest, size), least)
    rows = pages.select(*page, digest, size, "url", html.alias("payload")).repartition(buckets_for(total, ARCHIVE), "page", "no_page", "digest")
    members = rows.join(decided, ["page", "no_page", "digest"]).mapInArrow(lambda it: _pack(it, date), "value binary")
    raw = members.select(F.col("value").cast("string").alias("value"))  # the writer puts a string's bytes down as they are
    raw.write.option("compression", "none").option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)


def unpacked(data: bytes) -> bytes:
    """All members of a gzip file, one after another; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    view, out, at = memoryview(data), [], 0
    while at < len(data) and data[at : at + 2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if at == len(data):
                raise ValueError("a member of the archive is cut short")
            piece = view[at : at + (1 << 16)]
            out.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
    if data[at:].strip(b"\0"):
        raise ValueError(f"no member at byte {at}")
    return b"".join(out)


def records(data: bytes):
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (line.partition(b":") for line in lines[1:])}
        begin, n = end + 4, int(fields["content-length"])
        block = data[begin : begin + n]
        if len(block) < n or data[begin + n : begin + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = begin + n + 4


def _read(batches):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
    number = lambda f, k: int(f[k]) if k in f else None
    for batch in batches:
        for content in batch["content"]:
            data = unpacked(content.as_buffer().to_pybytes())
            rows: list[tuple] = []
            for f, block in records(data):
                digest, response = f["warc-payload-digest"].partition(":")[2], f["warc-type"] == "response"
                intact = not response or base64.b32encode(hashlib.sha1(block).digest()).decode() == digest
                rows.append((number(f, "x-page-id"), int(f["x-payload-length"]), digest, f["warc-type"], number(f, "x-refers-to-page"), intact))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(schema)], schema=schema)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records; intact: a response's block has its digest."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def archive_pages(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Writes the archives (to the shared folder, unless a path is given) and returns what they hold, read back."""
    path = path or fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path, least=least)
    return read_archives(pages.sparkSession, path)


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest FROM d),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to, true AS intact FROM o
"""
