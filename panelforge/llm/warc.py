"""Web archives: records written in segments, read back and put together again."""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import staged
from .text import map_batches

SEGMENT_BYTES, CHUNK_BYTES, RECORDS = 16_384, 4_096, 2_000
"""Bytes of a record's block in one segment, of a transfer chunk, and records of one archive file (at most 40 MB)."""
END = b"\r\n\r\n"
_PARSED = "origin string, number int, total bigint, kind string, page_id bigint, payload_digest string, refers_to bigint, block binary"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if a chunk is cut short or the last chunk is missing."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two empty lines that end it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items() if v is not None]]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block


def records(page_id, url, payload: bytes, digest: str, refers_to, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page: a revisit without payload, or a response in as many segments as its block needs."""
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    target = "".join(c if 32 < ord(c) < 127 else "%" + c.encode("utf-8", "replace").hex("%").upper() for c in url or "")
    common = {
        "WARC-Record-ID": origin, "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": target or None,
        "Page-ID": page_id, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record("revisit", common | {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Refers-To-Page-ID": refers_to}, block)]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record("response", common, block)]
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    out = [record("response", common | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        fields = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": n}
        out.append(record("continuation", fields | {"WARC-Segment-Total-Length": len(block) if n == len(parts) else None}, part))
    return out


def revisits(pages: DataFrame, id_col: str, min_bytes: int) -> DataFrame:
    """(id, refers_to) of the pages whose payload an earlier id has; ``pages``: id, digest, n (bytes)."""
    full = pages.where((F.col("n") >= min_bytes) & F.col(id_col).isNotNull()).select(id_col, "digest")
    first = full.groupBy("digest").agg(F.min(id_col).alias("first"), F.max(id_col).alias("last"))
    first = staged(first.where(F.col("first") != F.col("last")).select("digest", "first"), "revisits")
    return full.join(first, "digest").where(F.col(id_col) != F.col("first")).select(id_col, F.col("first").alias("refers_to"), "digest").distinct()


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 100, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS,
) -> None:
    """Write a record per row (more where it is segmented) to gzipped archive files in the folder ``path``.

    Of rows with equal payloads of ``min_bytes`` or more, those with the smallest id are responses, the others revisit
    that id. A null html is an empty payload. Rows that repeat an id with the same payload are written one by one; a row
    without id is a response. Where a revisit is found by its digest, hot digests are combined before the shuffle.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    seen = revisits(rows.select("page_id", "digest", F.octet_length("payload").alias("n")), "page_id", min_bytes)
    rows = rows.join(seen.hint("shuffle_hash"), ["page_id", "digest"], "left")

    def make():
        def body(batch):
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                out += records(*row, segment_bytes)
            return {"record": out}
        return body

    # The text writer ends each row with the separator, as an archive ends each record.
    map_batches(rows, make, "record binary").select(F.col("record").cast("string").alias("value")).write \
        .option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse(archive: bytes):
    """(headers, block) of each record of an archive. Raises ValueError where the framing is broken."""
    at = 0
    while at < len(archive):
        head = archive.find(END, at)
        lines = archive[at:head].decode("utf-8", "replace").split("\r\n") if head >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = head + len(END)
        stop = start + int(fields["content-length"])
        if archive[stop:stop + 4] != END:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, archive[start:stop]
        at = stop + 4


def _number(value) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _parsed(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {c.split()[0]: [] for c in _PARSED.split(", ")}
    for content in batch.column("content").to_pylist():
        if content[:2] == b"\x1f\x8b":
            content = gzip.decompress(content)
        for f, block in parse(content):
            number = _number(f.get("warc-segment-number"))
            row = (
                f.get("warc-segment-origin-id") or f.get("warc-record-id"), number, _number(f.get("warc-segment-total-length")),
                f["warc-type"], _number(f.get("page-id")), (f.get("warc-payload-digest") or "").rpartition(":")[2] or None,
                _number(f.get("refers-to-page-id")), block)
            for column, value in zip(out.values(), row):
                column.append(value)
    return out


def _whole(parts: list[dict]) -> tuple[bytes | None, int | None]:
    """Payload and its length from the segments of a record; None where a segment is missing or the length is wrong."""
    parts = sorted(parts, key=lambda p: p["number"] or 0)
    block = b"".join(p["block"] for p in parts)
    if parts[0]["number"] is not None:
        total = parts[-1]["total"]
        if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total != len(block):
            return None, None
    head, _, body = block.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if parts[0]["kind"] == "revisit":
        return None, _number(fields.get(b"content-length", b"").decode())
    payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    return payload, None if payload is None else len(payload)


def _decoded(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "complete")}
    for parts in batch.column("parts").to_pylist():
        first = min(parts, key=lambda p: p["number"] or 0)
        payload, size = _whole(parts)
        digest = first["payload_digest"] if payload is None else hashlib.sha256(payload).hexdigest()
        good = size is not None and digest == first["payload_digest"]
        for k, v in zip(out, (first["page_id"], first["kind"], first["refers_to"], payload, size, digest, good)):
            out[k].append(v)
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: page_id, record_type, refers_to, payload, payload_bytes, payload_digest, complete.

    Segments are grouped by the record they continue and put in order; their number and total length are verified, the
    chunks decoded, the digest compared. ``complete`` is false where any of that fails: the payload and its length are
    then null. A revisit has no payload; its length and digest are those of the payload it refers to. Only segmented
    records move between machines. A folder without archives raises; an archive without records gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = map_batches(files, lambda: _parsed, _PARSED).where(F.col("kind").isin("response", "revisit", "continuation"))
    part = F.struct(*[F.col(c) for c in ("number", "total", "kind", "page_id", "payload_digest", "refers_to", "block")])
    alone = found.where(F.col("number").isNull()).select(F.array(part).alias("parts"))
    split = found.where(F.col("number").isNotNull()).groupBy("origin").agg(F.collect_list(part).alias("parts"))  # one page
    kind = "page_id bigint, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string, complete boolean"
    return map_batches(alone.unionByName(split.select("parts")), lambda: _decoded, kind)
