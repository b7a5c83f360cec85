"""WARC: exact round trips, revisits, framing and digests."""

import base64
import gzip
import hashlib
import io

import pytest

from meshlake.llm import warc as W
from meshlake.llm._shared import shared_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, size int, digest string")


ROWS = [
    (3, "http://a/3", "same", 1, "x"), (1, "http://a/1", "same", 1, "x"), (2, "http://a/2", "ü" * 50_000, 1, "x"), (4, None, None, 1, "x"), (5, "http://a/5\r\nX: y", "", 1, "x"),
    (6, "http://a/6", "\r\n\r\nWARC/1.1\r\n\r\n", 1, "x"), (7, "u", "twice", 1, "x"), (7, "u", "twice", 1, "x"), (None, "u", "same", 1, "x"), (None, None, "alone", 1, "x"),
]


def expected(rows):
    least = {}
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        if i is not None:
            least[b] = min(least.get(b, i), i)
    out = []
    for i, _, html, *_ in rows:
        b = (html or "").encode()
        first = least.get(b, i)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("roll", [200, 1 << 20])
def test_round_trip(spark, roll):
    manifest = W.write_archives(pages(spark, ROWS), shared_path(spark, "warc"), roll=roll)
    got = W.read_archives(manifest)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == expected(ROWS)
    kept = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert kept[2] == ("ü" * 50_000).encode()
    assert kept[6] == b"\r\n\r\nWARC/1.1\r\n\r\n"


def test_archives_are_gzip_members(spark):
    manifest = W.write_archives(pages(spark, ROWS), shared_path(spark, "warc"))
    total = 0
    for r in manifest.collect():
        with W.open_shared(r.path, "rb") as f:
            data = f.read()
        assert len(data) == r.bytes
        assert gzip.decompress(data).count(b"WARC-Type:") == r.records
        total += r.records
    assert total == len(ROWS)


def test_small_payloads_are_responses(spark):
    manifest = W.write_archives(pages(spark, ROWS), shared_path(spark, "warc"), min_bytes=5)
    got = {(r.page_id, r.record_type) for r in W.read_archives(manifest).collect()}
    assert (3, "response") in got


def test_empty(spark):
    manifest = W.write_archives(pages(spark, []), shared_path(spark, "warc"))
    assert W.read_archives(manifest).count() == 0


def test_members_by_small_blocks():
    parts = [b"a" * 10, b"", bytes(range(256)) * 50]
    data = b"".join(W.member(p) for p in parts)
    assert list(W.members(io.BytesIO(data), 7)) == parts
    with pytest.raises(W.WarcError):
        list(W.members(io.BytesIO(data[:-3]), 7))
    with pytest.raises(W.WarcError):
        list(W.members(io.BytesIO(b"plain text")))


def test_verification():
    good = W.record("response", "urn:page:1", "http://x", b"hello")
    assert W.parsed(good)[2] == b"hello"
    for bad in (good.replace(b"hello", b"hellp"), good[:-1], good + b"x", good.replace(b"Content-Length: ", b"Content-Size: "), b"HTTP" + good):
        with pytest.raises(W.WarcError):
            W.parsed(bad)
    wrong = good.replace(W.base32_sha1(b"hello").encode(), W.base32_sha1(b"other").encode())
    with pytest.raises(W.WarcError):
        W.parsed(wrong)


def foreign(kind, block, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0f0f>", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return W.member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    """Records without digests or page numbers, of all types, and with digests of other kinds."""
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    app = {"Content_Type": "application/http; msgtype=response"}
    records = [
        foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("response", http, **app),
        foreign("response", http, WARC_Payload_Digest="sha256:abc", **app),
        foreign("response", http, WARC_Payload_Digest="sha1:" + hashlib.sha1(b"hello").hexdigest(), **app),
        foreign("revisit", b"", WARC_Refers_To="<urn:uuid:0f0f>"),
        foreign("metadata", b"a: b", Content_Type="text/plain"),
    ]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(records))
    out = W.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    assert [r.record_type for r in out] == ["warcinfo", "request", "response", "response", "response", "revisit", "metadata"]
    assert [r.payload for r in out if r.record_type == "response"] == [b"hello"] * 3
    assert out[2].payload_digest == W.base32_sha1(b"hello")
    assert {(r.page_id, r.refers_to) for r in out} == {(None, None)}
    with pytest.raises(W.WarcError):
        W.parsed(next(W.members(io.BytesIO(foreign("response", http, WARC_Payload_Digest="sha1:AAAA", **app)))))


def test_long_payload_and_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "é" * 3_000_000, "x", 5), (2, None, "é" * 3_000_000, "y", 6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, size int")
    manifest = W.write_archives(df, f"file://{tmp_path}/w")
    out = sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in W.read_archives(manifest).collect())
    assert out == [(1, "response", 6_000_000, None), (2, "revisit", 6_000_000, 1)]
