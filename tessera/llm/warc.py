"""WARC archives: writer and salvage reader.

The writer makes one record per page: a ``response`` whose block is an HTTP response
with the page as payload, or a ``revisit`` of the response with an identical payload,
whose block is the HTTP head alone. Records leave through Spark's text writer (a
record's closing line end is the writer's line separator), so any file system that
Spark writes can hold the archives. ``records_per_file`` bounds a file.

The reader takes archives as bytes, plain or gzipped by member or as a whole. Each
record must parse, be as long as it says, end in two line ends and match those digests
whose algorithm is known (MD5, SHA-1, SHA-2; hexadecimal or base32); others are not
checked. After a failed check the reader looks for the next place where a valid gzip
member or version line starts, goes on there, and logs the bytes between as a
quarantined gap. Of a damaged gzip member the records before the damage are recovered.
A member is unpacked in small pieces up to ``MOST_BYTES``, so a member made to explode
is cut there and logged. A file is one row of Spark's ``binaryFile`` source, which holds
up to 2 GiB; ``records_per_file`` keeps own archives far below.

Null pages are empty payloads. Rows of equal payload and equal largest ``page_id`` are
each a response; a null ``page_id`` is smallest. Line ends in a URL become spaces; a null
URL has no header line and stays null. An empty table gives no archive and no rows. Columns
other than the three named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import settle, shared_dir

RECORDS_PER_FILE = 1000
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: The most bytes that one gzip member is unpacked to.
MOST_BYTES = 1 << 30
_PIECE = 1 << 16

_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_NEXT = re.compile(rb"WARC/1\.[01]\r?\n|\x1f\x8b\x08")
_ID = re.compile(r"<urn:tessera:page:(-?[0-9]{1,19}|null)>")
_LENGTH = re.compile(r"[0-9]{1,18}")
_HEX = re.compile(r"[0-9a-f]+")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Writing


def _record(page_id, url, payload: bytes, refers_to) -> bytes:
    revisit = refers_to is not None
    head = f"{HTTP_HEAD}Content-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:tessera:page:{name}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {' '.join(url.split())}"]),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:tessera:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def _records(batches):
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
        # Bytes pass through a string column unread.
        yield pa.RecordBatch.from_arrays([pa.array([_record(p, u, x, r) for p, u, x, r in rows], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as WARC files; payloads of ``min_bytes`` or more are written once, by their largest ``page_id``."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    pages = pages.select("*", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("sha"))
    first = pages.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null").drop("times")
    # Only payloads that occur again have a row here.
    first = settle(first.select("sha", "n", "first"), "payloads")
    rows = pages.join(first, ["sha", "n"], "left")
    refers_to = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    records = rows.select("page_id", "url", "payload", refers_to.alias("refers_to")).mapInArrow(_records, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path)


# Reading


class Damaged(Exception):
    pass


def _differs(digest: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` is of a known algorithm and encoding and not that of ``data``."""
    name, _, value = digest.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip().lower().rstrip("=")
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return False
    found = hashlib.new(name, data, usedforsecurity=False).digest()
    if len(value) == 2 * len(found) and _HEX.fullmatch(value):
        return value != found.hex()
    plain = base64.b32encode(found).decode().lower().rstrip("=")
    return len(value) == len(plain) and value != plain


def _parse(data: bytes, pos: int, verify: bool = True) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``pos``; Damaged if any check fails."""
    line = _VERSION.match(data, pos)
    if not line:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", line.end() - 2)
    if end < 0:
        raise Damaged("head without end")
    headers: dict[str, str] = {}
    for x in data[line.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = x.partition(":")
        if not colon:
            raise Damaged("head line without colon")
        headers[name.strip().lower()] = value.strip()
    if not _LENGTH.fullmatch(headers.get("content-length", "")) or "warc-type" not in headers:
        raise Damaged("no length or type")
    start = end + 4
    stop = start + int(headers["content-length"])
    if stop > len(data):
        raise Damaged("cut off")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where it says")
    block = data[start:stop]
    if verify and _differs(headers.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs")
    return headers, block, stop + 4


def _member(data: bytes, pos: int, most: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at ``pos``, and why it ends before its own end, if it does."""
    z, out, size, at, view = zlib.decompressobj(31), [], 0, pos, memoryview(data)
    while not z.eof:
        piece = z.unconsumed_tail or view[at : at + _PIECE]
        if not len(piece):
            return b"".join(out), at, "gzip member cut off"
        if not z.unconsumed_tail:
            at += len(piece)
        try:
            got = z.decompress(piece, 4 * _PIECE)
        except zlib.error as e:
            return b"".join(out), at, f"gzip: {e}"
        size += len(got)
        if size > most:
            return b"".join(out), at, f"gzip member of more than {most} bytes"
        out.append(got)
    return b"".join(out), at - len(z.unused_data), ""


def _plain(data: bytes, verify: bool, packed: bool, most: int) -> Iterator[tuple]:
    pos, gap, why = 0, None, ""
    while pos < len(data):
        found, reason = [], ""
        if packed and data[pos : pos + 3] == b"\x1f\x8b\x08":
            inner, end, reason = _member(data, pos, most)
            found = [(kind, pos, end, a, b) for kind, _, _, a, b in _plain(inner, verify, False, most)]
            if not any(x[0] == "record" for x in found):
                found, reason = [], reason or "gzip member without a valid record"
            elif reason:
                found = [x for x in found if x[0] == "record"]
        else:
            try:
                headers, block, end = _parse(data, pos, verify)
                found = [("record", pos, end, headers, block)]
            except Damaged as e:
                reason = str(e)
        if found and gap is not None:
            yield "gap", gap, pos, why, b""
            gap = None
        yield from found
        if not reason:
            pos = end
            continue
        if gap is None:
            gap, why = pos, reason
        later = (_NEXT if packed else _VERSION).search(data, pos + 1)
        pos = later.start() if later else len(data)
    if gap is not None:
        yield "gap", gap, len(data), why, b""


def salvage(data: bytes, verify: bool = True, most: int = MOST_BYTES) -> Iterator[tuple]:
    """``("record", start, end, headers, block)`` of all valid records and ``("gap", start, end, reason, b"")`` of what lies between.

    Records of a damaged gzip member have its range and lie in its gap.
    """
    return _plain(data, verify, True, most)


def _page(urn: str) -> int | None:
    m = _ID.fullmatch(urn)
    n = int(m[1]) if m and m[1] != "null" else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head."""
    head, blank, rest = block.partition(b"\r\n\r\n")
    return rest if blank else head


READ = "path string, kind string, start long, stop long, reason string, record_type string, page_id long, url string, payload binary, payload_digest string, refers_to long"


def _read(batches):
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for kind, start, stop, a, block in salvage(data.as_py()):
                if kind == "gap":
                    rows.append((path, kind, start, stop, a, None, None, None, None, None, None))
                    continue
                kind_, digest = a["warc-type"], a.get("warc-payload-digest", "")
                web = "application/http" in a.get("content-type", "application/http").lower()
                body = None if kind_ == "revisit" else payload_of(block) if web else block
                # A payload sent in pieces may have its digest with or without their marks.
                checked = body is not None and b"transfer-encoding" not in block[: len(block) - len(body)].lower()
                reason = "payload digest differs" if checked and _differs(digest, body) else None
                refers = _page(a["warc-refers-to"]) if "warc-refers-to" in a else None
                rows.append((path, "gap" if reason else kind, start, stop, reason, kind_, _page(a.get("warc-record-id", "")), a.get("warc-target-uri"), body, digest.removeprefix("sha1:"), refers))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps (``kind``) of all archives under ``path``, with their byte ranges."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, READ)


def page_records(spark: SparkSession, pages: DataFrame, **kw) -> DataFrame:
    """Writes ``pages`` as archives, reads them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    path = f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **kw)
    got = read_archives(spark, path).where("kind = 'record'")
    got = settle(got.select("page_id", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to", "url"), "records")
    full = got.where("record_type = 'response'").groupBy(F.col("page_id").alias("r")).agg(F.max("n").alias("full"))
    full = settle(full.where("r is not null"), "responses")
    rows = got.join(full, F.col("refers_to") == F.col("r"), "left")
    return rows.select("page_id", F.coalesce("n", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
x AS (SELECT *, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, array_to_string(regexp_extract_all(url, '\\S+'), ' ') AS url
FROM x
"""
