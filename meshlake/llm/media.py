"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, and turned into NPY tiles with difference hashes.

Everything is a column: stored bytes in, tile bytes and hash out, a batch at a time. Resizing takes area means from an
integral image, so each output pixel costs four look-ups whatever the size of the input.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import kept

TILE = (16, 16)
UNIT = 576
WIDTH = 24
PAD = 255
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*)*([^\s#]+)")


class MediaError(ValueError):
    """Bytes that are not an image of a known form."""


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm of uint8 pixels: (h, w) as P5, (h, w, 3) as P6."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """Pixels of a P1 to P6 file: (h, w) or (h, w, 3), uint8 or, above 255, uint16, scaled so that its maximum is the type's; bitmaps as 0 (black) and 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not a Netpbm file")
    fields, at = [], 2
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise MediaError("bad Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = *fields[:2], (fields[2] if len(fields) > 2 else 1)
    if not 0 < top < 65536 or w < 1 or h < 1:
        raise MediaError("bad Netpbm header")
    bands = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        row = (w + 7) // 8
        if len(data) - at - 1 < row * h:
            raise MediaError("too few samples")
        raw = np.frombuffer(data, np.uint8, row * h, at + 1)
        return (1 - np.unpackbits(raw.reshape(h, row), axis=1)[:, :w]) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        form = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(data) - at - 1 < w * h * bands * form.itemsize:
            raise MediaError("too few samples")
        out = np.frombuffer(data, form, w * h * bands, at + 1).astype(form.newbyteorder("="))
    else:
        text = re.sub(rb"#[^\n\r]*", b"", data[at:])
        tokens = re.findall(rb"[01]", text) if kind == b"P1" else text.split()
        if len(tokens) < w * h * bands:
            raise MediaError("too few samples")
        if not all(t.isdigit() and len(t) < 6 for t in tokens[: w * h * bands]):
            raise MediaError("a sample is not a number")
        out = np.array(tokens[: w * h * bands], dtype=np.int64)
        if out.max() > top:
            raise MediaError("a sample is above the maximum")
        out = out.astype(np.uint8 if top < 256 else np.uint16)
        if kind == b"P1":
            return ((1 - out) * np.uint8(255)).reshape(h, w)
    full = 255 if top < 256 else 65535
    if top != full:
        out = np.minimum((out.astype(np.int64) * full + top // 2) // top, full).astype(out.dtype)
    return out.reshape((h, w, 3) if bands == 3 else (h, w))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed BMP of uint8 pixels: (h, w) as 8 bits with a grey palette, (h, w, 3) as 24 bits."""
    grey = pixels.ndim == 2
    h, w = pixels.shape[:2]
    rows = np.ascontiguousarray(pixels[::-1] if grey else pixels[::-1, :, ::-1], np.uint8).reshape(h, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint32) * 0x010101, 1).astype("<u4").tobytes() if grey else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Pixels of an uncompressed BMP of 1, 4, 8, 24 or 32 bits: (h, w) where the palette is grey, else (h, w, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not a BMP file")
    start = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or packing not in (0, 3) or (packing == 3 and bits != 32) or bits not in (1, 4, 8, 24, 32) or w < 1 or not h:
        raise MediaError("a BMP form that is not supported")
    stride, tall = (w * bits + 31) // 32 * 4, abs(h)
    if len(data) < start + stride * tall:
        raise MediaError("too few samples")
    raw = np.frombuffer(data, np.uint8, stride * tall, start).reshape(tall, stride)
    raw = raw[::-1] if h > 0 else raw
    if bits == 32 and packing == 3:
        masks = struct.unpack_from("<III", data, 54) if len(data) >= 66 else (0, 0, 0)
        if not all(masks):
            raise MediaError("bad BMP masks")
        cells = np.ascontiguousarray(raw[:, : w * 4]).view("<u4").astype(np.uint64)
        shift = [(m & -m).bit_length() - 1 for m in masks]
        parts = [((cells & np.uint64(m)) >> np.uint64(k)) * 255 // (m >> k) for m, k in zip(masks, shift)]
        return np.stack(parts, axis=2).astype(np.uint8)
    if bits >= 24:
        return raw[:, : w * bits // 8].reshape(tall, w, bits // 8)[:, :, 2::-1].copy()
    if bits < 8:
        cell = np.unpackbits(raw, axis=1).reshape(tall, -1, bits)
        index = (cell * (1 << np.arange(bits)[::-1])).sum(axis=2, dtype=np.uint8)[:, :w]
    else:
        index = raw[:, :w]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    if used > 256 or len(data) < 14 + size + used * 4 or int(index.max()) >= used:
        raise MediaError("bad BMP palette")
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    out = palette[index]
    return out[:, :, 0].copy() if (palette == palette[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    """Pixels of a Netpbm or BMP file; `MediaError` for whatever else, cut or damaged bytes included."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except MediaError:
        raise
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        raise MediaError(f"damaged bytes: {e}") from e


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means (float64) of (h, w) or (h, w, c) pixels over a height x width grid; parts of a pixel count in part."""
    h, w = pixels.shape[:2]
    total = np.zeros((h + 1, w + 1, *pixels.shape[2:]))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def cut(table: np.ndarray, n: int, parts: int) -> np.ndarray:
        edge = np.arange(parts + 1) * n / parts
        low = np.minimum(edge.astype(np.int64), n - 1)
        share = (edge - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] + (table[low + 1] - table[low]) * share

    rows = cut(total, h, height)
    both = np.swapaxes(cut(np.swapaxes(rows, 0, 1), w, width), 0, 1)
    return np.diff(np.diff(both, axis=0), axis=1) / (h * w / (height * width))


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether brightness rises from one cell to the next in an 8 x 9 area-resized grey image."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    small = np.round(area_resize(grey, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, column: str = "media", tile: tuple[int, int] = TILE) -> DataFrame:
    """`media` with height, width, tile (NPY bytes, uint8), dhash (16 hex digits) and error for each image in `column`.

    Null, empty and undecodable bytes give nulls and, unless null, the reason in `error`; no bytes fail the job. Repeated rows
    each get their tile; an empty table gives an empty result. An image is decoded whole, however large. New columns that
    clash with present ones take their place.
    """
    fields = {"height": pa.int32(), "width": pa.int32(), "tile": pa.binary(), "dhash": pa.string(), "error": pa.string()}
    rest = [c for c in media.columns if c not in fields]
    ddl = "height int, width int, tile binary, dhash string, error string"

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 5
        try:
            pixels = decode(data)
        except MediaError as e:
            return None, None, None, None, str(e)
        small = np.clip(np.round(area_resize(pixels, *tile) * (255 / 65535 if pixels.dtype == np.uint16 else 1)), 0, 255).astype(np.uint8)
        return *pixels.shape[:2], npy(small), f"{difference_hash(pixels):016x}", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(x.as_py()) for x in b.column(b.schema.get_field_index(column))]
            new = [pa.array([m[i] for m in made], t) for i, t in enumerate(fields.values())]
            yield pa.record_batch([*(b.column(c) for c in rest), *new], names=[*rest, *fields])

    return media.mapInArrow(run, ", ".join([*(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in rest), ddl]))


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as the samples of a P5 image 24 wide.

    A null text is empty; a text is stored whole, however long; rows that repeat a doc_id, or have none, are stored each; an
    empty table gives an empty one. Other columns are not stored. The rows are written as a table in the shared folder and
    read from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = []
            for x in b.column(2):
                data = x.as_py()
                data += bytes([PAD]) * ((-len(data)) % UNIT or (0 if data else UNIT))
                media.append(encode_netpbm(np.frombuffer(data, np.uint8).reshape(-1, WIDTH)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body).select("doc_id", F.octet_length("body").cast("bigint").alias("n_bytes"), "body")
    return kept(rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), "media")


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all from the bytes in `media`, decoded."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(data: bytes, tile: bytes, dhash: str) -> tuple:
        payload = decode(data).tobytes()
        sha = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest()
        return len(payload), *sha, f"{dhash}-{zlib.crc32(tile):08x}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(*(x.as_py() for x in row)) for row in zip(*(b.column(c) for c in ("media", "tile", "dhash")))]
            new = [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds[2:])]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *new], names=names)

    ddl = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return tiles(media).mapInArrow(run, ddl)


def op8_media(spark, sf_dir: str) -> DataFrame:
    from ._shared import read_table

    return digests(stored_texts(read_table(spark, sf_dir, "documents")))
