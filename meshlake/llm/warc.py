"""WARC archives: a writer that deduplicates equal payloads, and a sequential reader.

Writer: each task streams its rows into archives of at most `roll` bytes in a folder that the whole cluster shares, one
gzip member a record. A task's archives have names of their own, and the manifest (a table that Spark commits once a task)
lists those that count, so a repeated or lost task leaves nothing that is read twice.

Reader: each archive is read from front to back in blocks of `BLOCK` bytes through an incremental decompressor. The end of
a gzip member ends the record; headers end at an empty line, the block is framed by Content-Length, and block and payload
digests are verified. Nothing larger than one record is held.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import kept, shared_path, temporary

ROLL = 32 << 20
BLOCK = 1 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"


class WarcError(ValueError):
    """A record that is not framed as it says, or whose digest does not match."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_shared(path: str, mode: str) -> BinaryIO:
    """A file in the shared folder: local or mounted paths as such, other stores by pyarrow's filesystems."""
    if path.startswith("/") or path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_stream(inner)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header, which tells the payload's length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"Content-Length: {len(block)}"]
    return BREAK.join([*(x.encode("utf-8", "replace") for x in lines), b"", block, b"", b""])


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(file: BinaryIO, block: int = BLOCK) -> Iterator[bytes]:
    """The decompressed gzip members of `file`, one after the other."""
    data = b""
    while True:
        data = data or file.read(block)
        if not data:
            return
        z, parts = zlib.decompressobj(31), []
        while True:
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            if z.eof:
                data = z.unused_data
                break
            data = file.read(block)
            if not data:
                raise WarcError("the archive ends inside a gzip member")
        yield b"".join(parts)


def _headers(data: bytes, at: int) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise WarcError("no empty line after the headers")
    first, *rest = data[at:end].split(BREAK)
    pairs = (x.split(b":", 1) for x in rest if b":" in x)
    return first.decode("utf-8", "replace"), {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, v in pairs}, end + 4


def _matches(digest: str | None, data: bytes) -> bool:
    """Whether a digest header, if it is there and by SHA-1 (in base32 or hexadecimal), is that of `data`."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return True
    return value.upper() == base32_sha1(data) or value.lower() == hashlib.sha1(data).hexdigest()


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; raises WarcError unless framing and digests hold.

    Digests are optional; those there are, by SHA-1, must match. A block of another content type than HTTP is the payload.
    """
    version, head, at = _headers(data, 0)
    if not version.startswith("WARC/1."):
        raise WarcError(f"not a WARC record: {version[:20]}")
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no content length") from e
    block = data[at : at + length]
    if len(block) != length or data[at + length :] != BREAK * 2:
        raise WarcError("the block is not as long as it says")
    if not _matches(head.get("warc-block-digest"), block):
        raise WarcError("block digest does not match")
    if not head.get("content-type", "").startswith("application/http"):
        return head, {}, block
    _, http, body = _headers(block, 0)
    payload = block[body:]
    if head.get("warc-type") == "response" and not _matches(head.get("warc-payload-digest"), payload):
        raise WarcError("payload digest does not match")
    return head, http, payload


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, roll: int = ROLL) -> DataFrame:
    """Write `pages` (page_id, url, html) to archives under `path`; the manifest (path, records, bytes).

    Of equal payloads of at least `min_bytes` bytes the row with the least page_id is a response and the others revisit it;
    smaller payloads are responses. A null html is an empty payload; a null url leaves the target out. A null page_id is
    written without a number, comes last, and is a response unless an equal payload with a page_id exists. Of rows that
    repeat a page_id and payload, each is written; those of the least page_id are all responses. An empty table gives an
    empty manifest. A payload is written whole, however long. Other columns are not written. Archives that a lost or repeated
    task leaves are in no manifest and go with the folder.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body")})
    least = rows.where(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    least = least.where("n > 1 AND least IS NOT NULL").select("d", "s", "least")
    first = rows.join(least, (rows["digest"] == least["d"]) & (rows["size"] == least["s"]), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("refers_to")
    first = first.select("page_id", "url", "body", refers)
    schema = T.StructType.fromDDL("path string, records bigint, bytes bigint")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, file, name, n, size = [], None, "", 0, 0
        try:
            for batch in batches:
                for page, url, payload, refers_to in zip(*(batch.column(i) for i in range(4))):
                    page, to = page.as_py(), refers_to.as_py()
                    own = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
                    if file is None:
                        name = f"{path}/part-{uuid.uuid4().hex}.warc.gz"
                        file, n, size = open_shared(name, "wb"), 0, 0
                    kind = "response" if to is None else "revisit"
                    data = member(record(kind, own, url.as_py(), payload.as_py(), None if to is None else f"urn:page:{to}"))
                    file.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= roll:
                        file.close()
                        done.append((name, n, size))
                        file = None
            if file is not None:
                file.close()
                done.append((name, n, size))
                file = None
        finally:
            if file is not None:
                file.close()
        if done:
            yield pa.record_batch([pa.array(list(x)) for x in zip(*done)], names=schema.names)

    spark = pages.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return kept(first.mapInArrow(write, schema), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row a record of the archives that `manifest` (path) names: (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload).

    Of a revisit, payload is null, and its length and digest are those of the full payload, as far as its headers tell them.
    Records of other archives are read too: of any type (`record_type`), with or without digests (that of a payload at hand is
    worked out), with ids that are no page numbers (page_id null). One gzip member may hold one record only. A record that is
    not framed as it says fails the read. Rows that name an archive twice give its records twice; an empty manifest gives an
    empty result. A record is held whole, however long.
    """
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(uri: str | None) -> int | None:
        inner = (uri or "").strip("<>").removeprefix("urn:page:")
        return int(inner) if inner.lstrip("-").isdigit() and inner.isascii() else None

    def whole(text: str | None) -> int | None:
        return int(text) if text and text.isdigit() else None

    def row(data: bytes) -> tuple:
        head, http, payload = parsed(data)
        kind = head.get("warc-type", "")
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        again = number(head.get("warc-refers-to")) if kind == "revisit" else None
        if kind == "revisit":
            return number(head.get("warc-record-id")), head.get("warc-target-uri"), kind, whole(http.get("content-length")), digest, again, None
        return number(head.get("warc-record-id")), head.get("warc-target-uri"), kind, len(payload), digest or base32_sha1(payload), None, payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows), types)], schema=types)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with open_shared(name, "rb") as file:
                    for data in members(file):
                        rows.append(row(data))
                        held += len(data)
                        if len(rows) >= 2000 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(read, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    manifest = write_archives(read_table(spark, sf_dir, "pages"), temporary(shared_path(spark, "warc")))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS least FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM d
"""
