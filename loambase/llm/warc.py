"""WARC archives: writing pages as segmented records, and reassembly.

Writing: the payload is sent in chunked transfer framing within an HTTP response. Of pages with
equal payloads the one with the largest page_id is a ``response`` record, the others are ``revisit``
records that name it. A block longer than ``segment_bytes`` is split into a first record and
continuations (``WARC-Segment-Number``, ``WARC-Segment-Origin-ID``; the last has
``WARC-Segment-Total-Length``). Files are written by Spark's text sink, a record per row with the
record end as line end, gzip-compressed. No record is much longer than ``segment_bytes``, so a number
of records bounds a file's bytes.

Reading: a file's members are inflated piece by piece and parsed by content length as they come; a task
holds one file's compressed bytes (under 2 GB, as Spark reads a file into a row) and one record. A record
that is cut off has no payload. Continuation records are grouped by origin identifier,
ordered by segment number and joined; a group counts only if its numbers are gapless from 1 and its
length is the total that the last segment states. Chunked framing is then decoded, and a revisit
takes its payload's length from the response it names.

Null html is the empty payload. Rows that share a page_id, or have none, are records of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import flagged, key_filter
from .store import materialize, scratch_path

END = "\r\n\r\n"
_READ = "record_id string, kind string, refers_to string, page_id long, declared string, origin string, segment int, total long, block binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in split_block(payload, size) if p) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are left out."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(part)
        at = end + 4 + size


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its end."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def record_uri(page: int | None, copy: int, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{copy}:{digest}>"


def split_block(block: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that don't part a UTF-8 character (the sink takes text)."""
    out, at = [], 0
    while at < len(block):
        end = min(len(block), at + size)
        while end < len(block) and end > at + 1 and block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return out or [b""]


def _records(segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            size = 0
            for page, copy, url, html, best, revisits in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                payload = (html or "").encode()
                digest = base32_sha1(payload)
                uri, keeper = record_uri(page, copy, digest), record_uri(best, 1, digest) if revisits else None
                safe = (url or "").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
                head = [("WARC-Record-ID", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", safe), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page is None else page)]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if keeper is not None:
                    made = [record([("WARC-Type", "revisit"), *head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", keeper), ("Content-Type", "application/http; msgtype=response")], http)]
                else:
                    block = http + chunked(payload)
                    pieces = split_block(block, segment_bytes)
                    kind = ("Content-Type", "application/http; msgtype=response")
                    made = [record([("WARC-Type", "response"), *head, kind, *([("WARC-Segment-Number", 1)] if len(pieces) > 1 else [])], pieces[0])]
                    for n, piece in enumerate(pieces[1:], 2):
                        last = [("WARC-Segment-Total-Length", len(block))] if n == len(pieces) else []
                        made.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{uri[:-1]}:{n}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", uri), *last], piece))
                out += [x.decode() for x in made]
                size += sum(map(len, made))
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 16384, file_bytes: int = 80 << 20, least_revisit: int = 0) -> None:
    """Write a record per row of ``pages``. Payloads are equal if their SHA-256 are; smaller ones than
    ``least_revisit`` bytes are all responses. Payloads that surely occur once don't move. A file takes ``file_bytes``
    uncompressed, reckoned at 1,024 bytes of headers a record."""
    file_records = max(1, file_bytes // (segment_bytes + 1024))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("strong", F.sha2(F.coalesce("html", F.lit("")), 256))
    keys = rows.groupBy("page_id", "url", "strong").count()
    # Rows of one page and payload are numbered in order of url.
    numbers = Window.partitionBy("strong", "page_id").orderBy("url").rowsBetween(Window.unboundedPreceding, 0)
    best = keys.groupBy("strong").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "page_id")).alias("best"), F.sum("count").alias("n")).filter("n > 1").select("strong", F.col("best.page_id").alias("best"))
    alike = keys.join(best, "strong").select(F.col("strong").alias("s2"), F.col("page_id").alias("p2"), F.col("url").alias("u2"), (F.sum("count").over(numbers) - F.col("count")).alias("before"), "best", F.lit(True).alias("several"))
    told = flagged(rows, "strong", key_filter(best, "strong"))
    cols = ["page_id", "copy", "url", "html", "best", "revisits"]
    alone = told.filter("not __maybe").select("page_id", F.lit(1).alias("copy"), "url", "html", F.lit(None).cast("long").alias("best"), F.lit(False).alias("revisits"))
    joined = told.filter("__maybe").join(alike, (F.col("strong") == F.col("s2")) & F.col("page_id").eqNullSafe(F.col("p2")) & F.col("url").eqNullSafe(F.col("u2")), "left")
    within = F.row_number().over(Window.partitionBy("strong", "page_id", "url").orderBy(F.lit(0)))
    numbered = joined.withColumn("copy", (F.coalesce("before", F.lit(0)) + within).cast("int"))
    stays = F.col("page_id").eqNullSafe(F.col("best")) & (F.col("copy") == 1)
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= least_revisit
    same = numbered.withColumn("revisits", F.coalesce("several", F.lit(False)) & ~stays & long)
    alone.unionByName(same.select(*cols)).mapInArrow(_records(segment_bytes), "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive, read as it is
    asked for. The block of a record that is cut off is None."""
    while line := file.readline(1 << 16):
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := file.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        n = int(headers.get("content-length", 0))
        try:
            block = file.read(n)
        except EOFError:  # The gzip stream itself is cut off.
            yield headers, None
            return
        yield headers, block if len(block) == n else None


def opened(data: bytes) -> BinaryIO:
    """The data of all members of a gzip file, or the data itself if it isn't one, inflated as it is read."""
    raw = io.BytesIO(data)
    return gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw


def _until_cut(records: Iterator[tuple[dict[str, str], bytes | None]]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """The records up to where a gzip stream is cut off between blocks or within headers."""
    try:
        yield from records
    except EOFError:
        return


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = ["record_id", "kind", "refers_to", "page_id", "declared", "origin", "segment", "total", "block"]
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for h, block in _until_cut(parse_records(opened(content.as_py()))):
                page, segment = h.get("x-page-id"), h.get("warc-segment-number")
                rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-refers-to"), int(page) if page else None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-segment-origin-id") or h.get("warc-record-id"), int(segment) if segment else None, int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block))
                size += len(block or b"")
                if size > 1 << 22 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _payload(kind: str | None, parts: list[bytes | None] | None, total: int | None) -> bytes | None:
    if kind != "response" or parts is None or None in parts:
        return None
    block = b"".join(parts)
    if total is not None and len(block) != total:
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return None


def _payloads(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, payloads = [], [], []
            for i in range(batch.num_rows):
                payload = _payload(*(batch.column(c)[i].as_py() for c in (1, 5, 6)))
                sizes.append(None if payload is None else len(payload))
                digests.append(None if payload is None else base32_sha1(payload))
                payloads.append(payload if keep else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(payloads, pa.binary())], ["record_id", "kind", "refers_to", "page_id", "declared", "n_bytes", "digest", "payload"])

    return run


def read_archives(spark, path: str, keep_payload: bool = True) -> DataFrame:
    """record_id, kind, refers_to, page_id, declared digest, n_bytes, digest, payload of every logical
    record. Incomplete or wrongly framed ones have null n_bytes, digest and payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_parse, _READ)
    whole = rows.filter("segment is null").withColumn("parts", F.array("block"))
    parts = rows.filter("segment is not null").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("record_id", "kind", "refers_to", "page_id", "declared"))).alias("head"),
        F.array_sort(F.collect_set(F.when(F.col("block").isNotNull(), F.struct("segment", "block")))).alias("parts"),
        F.max("total").alias("total"),
    )
    # Without a last segment, which states the total, a group is incomplete.
    gapless = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("parts")))
    joined = parts.select("head.*", F.when(gapless & F.col("total").isNotNull(), F.transform("parts", lambda p: p["block"])).alias("parts"), "total").filter("record_id is not null")
    cols = ["record_id", "kind", "refers_to", "page_id", "declared", "parts", "total"]
    schema = "record_id string, kind string, refers_to string, page_id long, declared string, n_bytes long, digest string, payload binary"
    return whole.select(*cols).unionByName(joined.select(*cols)).mapInArrow(_payloads(keep_payload), schema)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a revisit takes the length and
    digest of the response it names, if that has the digest it declares."""
    responses = records.filter("kind = 'response'").select(F.col("record_id").alias("__id"), F.col("page_id").alias("__page"), F.col("n_bytes").alias("__n"), F.col("digest").alias("__digest"))
    own = records.filter("kind = 'response'").select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = records.filter("kind = 'revisit'").join(responses, (F.col("refers_to") == F.col("__id")) & (F.col("declared") == F.col("__digest")), "left")
    return own.unionByName(revisits.select("page_id", F.col("__n").alias("payload_bytes"), F.col("declared").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("__page").alias("refers_to")))


def round_trip(pages: DataFrame, segment_bytes: int = 16384) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment_bytes)
    return resolved(materialize(read_archives(pages.sparkSession, path, keep_payload=False), "records"))
