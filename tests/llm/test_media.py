"""Media: exact decoding, area means, tiles, hashes, and the digests of stored texts."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlake.llm import media as M


@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_round_trips(h, w, colour, seed):
    x = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w), dtype=np.uint8)
    assert (M.decode(M.encode_netpbm(x)) == x).all()
    y = M.decode(M.encode_bmp(x))
    assert (y == x).all() if y.shape == x.shape else (x == y[:, :, None]).all()


def test_netpbm_kinds():
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert M.decode(b"P1 3 1 101").tolist() == [[0, 255, 0]]
    assert M.decode(b"P2 2 1 #x\n 9\n 3 9").tolist() == [[85, 255]]
    assert M.decode(b"P5 3 1 100\n\x00\x32\x64").tolist() == [[0, 128, 255]]
    assert M.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert M.decode(b"P5 1 2 65535\n\x01\x02\x03\x04").tolist() == [[258], [772]]
    assert M.decode(b"P6 1 1 255\n\x0a\x0b\x0c").tolist() == [[[10, 11, 12]]]


def test_bmp_kinds():
    def bmp(bits, rows, palette=b"", h=None):
        start = 54 + len(palette)
        return struct.pack("<2sIHHI", b"BM", 0, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, 2, h or len(rows), 1, bits, 0, 0, 0, 0, len(palette) // 4, 0) + palette + b"".join(r.ljust(-(-len(r) // 4) * 4, b"\0") for r in rows)

    grey = bytes([0, 0, 0, 0, 255, 255, 255, 0])
    assert M.decode(bmp(1, [b"\x40"], grey)).tolist() == [[0, 255]]
    assert M.decode(bmp(4, [b"\x10"], grey)).tolist() == [[255, 0]]
    assert M.decode(bmp(8, [b"\1\0", b"\0\0"], bytes([1, 2, 3, 0, 4, 5, 6, 0]))).tolist() == [[[3, 2, 1]] * 2, [[6, 5, 4], [3, 2, 1]]]
    assert M.decode(bmp(32, [bytes([1, 2, 3, 9, 4, 5, 6, 9])], h=-1)).tolist() == [[[3, 2, 1], [6, 5, 4]]]


@pytest.mark.parametrize("data", [b"", b"P7 1 1 255\n\0", b"P5 9 9 255\n\0", b"P5 x", b"P5 0 1 255\n", b"BM", b"BM" + b"\0" * 60, b"P2 2 2 255 1", b"P2 2 1 255 1 x", b"P2 1 1 9 10", b"P4 9 2\n\0\0\0", b"P4 3 1"])
def test_refusals(data):
    with pytest.raises(M.MediaError):
        M.decode(data)


def test_bmp_masks_and_palettes():
    def bmp(bits, packing, extra, rows, colours=0):
        start = 54 + len(extra)
        return struct.pack("<2sIHHI", b"BM", 0, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, bits, packing, 0, 0, 0, colours, 0) + extra + rows

    assert M.decode(bmp(32, 3, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000), bytes([1, 2, 3, 9]))).tolist() == [[[1, 2, 3]]]
    assert M.decode(bmp(32, 3, struct.pack("<III", 0x3FF, 0xFFC00, 0x3FF00000), struct.pack("<I", 0x3FF))).tolist() == [[[255, 0, 0]]]
    for bad in (bmp(32, 3, struct.pack("<III", 0, 1, 2), b"abcd"), bmp(8, 0, bytes(8), b"\5\0\0\0", 2), bmp(8, 0, bytes(8), b"\0\0\0\0", 1 << 30), bmp(24, 3, b"", b"abcd")):
        with pytest.raises(M.MediaError):
            M.decode(bad)


IMAGES = [b"P1\n3 2\n1 0 1\n0 1 0", b"P2 2 1 9 3 9", b"P3 1 1 255 1 2 3", b"P4 3 1\n\xa0", b"P5 1 2 65535\n\1\2\3\4", b"P6 1 1 255\n\n\v\f", M.encode_bmp(np.zeros((3, 5), np.uint8)), M.encode_bmp(np.zeros((3, 5, 3), np.uint8))]


@given(st.sampled_from(IMAGES), st.lists(st.tuples(st.integers(0, 120), st.integers(0, 255)), max_size=4), st.integers(0, 200))
@settings(max_examples=600, deadline=None)
def test_damaged_bytes_decode_or_are_refused(data, changes, length):
    out = bytearray(data)
    for at, x in changes:
        out[at % len(out)] = x
    try:
        assert M.decode(bytes(out[:length])).size > 0
    except M.MediaError:
        pass


@given(st.integers(1, 20), st.integers(1, 20), st.integers(1, 12), st.integers(1, 12))
@settings(max_examples=80, deadline=None)
def test_area_means(h, w, a, b):
    x = np.random.default_rng(h * 400 + w).integers(0, 256, (h, w))
    big = np.repeat(np.repeat(x, a, axis=0), b, axis=1).astype(float)  # each output cell holds h x w whole cells
    want = big.reshape(a, h, b, w).mean(axis=(1, 3))
    assert np.allclose(M.area_resize(x, a, b), want)


def test_npy_and_hash():
    x = np.tile(np.arange(36, dtype=np.uint8), (8, 1))
    assert M.difference_hash(x) == 2**64 - 1
    assert M.difference_hash(x[:, ::-1]) == 0
    assert (np.load(io.BytesIO(M.npy(x))) == x).all()


def test_stored_texts(corpus, clashing, empty):
    texts = sorted(((r.doc_id, r.text) for r in corpus.collect()), key=repr)
    got = sorted((r.asDict() for r in M.digests(M.stored_texts(clashing)).collect()), key=lambda r: repr((r["doc_id"],)))
    by: dict = {}
    for d, t in texts:
        by.setdefault(d, t)
    assert len(got) == len(texts)
    for r in got:
        data = (by[r["doc_id"]] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        media = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    assert M.digests(M.stored_texts(empty)).count() == 0


def test_tiles(spark):
    x = np.arange(64, dtype=np.uint8).reshape(8, 8)
    rows = [(1, bytearray(M.encode_bmp(x)), "a"), (2, bytearray(M.encode_netpbm(x)), "b"), (3, None, "c"), (4, bytearray(b"no"), "d"), (5, bytearray(), "e")]
    got = {r.id: r for r in M.tiles(spark.createDataFrame(rows, "id int, media binary, error string"), tile=(4, 4)).collect()}
    assert got[1].dhash == got[2].dhash and bytes(got[1].tile) == bytes(got[2].tile)
    tile = np.load(io.BytesIO(bytes(got[1].tile)))
    assert tile.shape == (4, 4) and tile.dtype == np.uint8
    assert (got[1].height, got[1].error, got[3].tile, got[3].error) == (8, None, None, None)
    assert got[4].error and got[5].error
