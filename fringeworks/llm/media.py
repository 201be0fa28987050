"""Media columns: Netpbm (P5, P6) and BMP images, decoded to arrays, area-resized
by integral images, and written as NPY tiles with difference hashes."""

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

from .common import map_batches, text_column

#: 64 RGB pixels a row: payloads are multiples of one row.
ROW_PIXELS, UNIT = 64, 192
TILE_H, TILE_W = 8, 9


def encode_ppm(samples: np.ndarray) -> bytes:
    """P6 for (h, w, 3), P5 for (h, w) arrays of unsigned bytes."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of an (h, w, 3) RGB array."""
    h, w, _ = samples.shape
    stride = -(-w * 3 // 4) * 4
    rows = np.zeros((h, stride), dtype=np.uint8)
    rows[:, : w * 3] = samples[::-1, :, ::-1].reshape(h, w * 3)
    head = b"BM" + struct.pack("<IHHI", 54 + stride * h, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 2835, 2835, 0, 0)
    return head + rows.tobytes()


_HEADER = re.compile(rb"(P[56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def decode(data: bytes) -> np.ndarray:
    """The samples of a P5, P6 (up to 255) or uncompressed 24-bit BMP file."""
    if data[:2] == b"BM":
        at = struct.unpack_from("<I", data, 10)[0]
        w, h, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
        if depth != 24 or packed:
            raise ValueError("only uncompressed 24-bit BMP is read")
        stride = -(-w * 3 // 4) * 4
        rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, : w * 3].reshape(abs(h), w, 3)
        return (rows[::-1] if h > 0 else rows)[:, :, ::-1]
    m = _HEADER.match(data)
    if not m or int(m[4]) > 255:
        raise ValueError("not a P5, P6 or BMP image with 8-bit samples")
    w, h, deep = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    x = np.frombuffer(data, np.uint8, w * h * deep, m.end())
    return x.reshape(h, w, 3) if deep == 3 else x.reshape(h, w)


def _cumulative(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Running sums (first axis) read at fractional positions."""
    low = np.minimum(edges.astype(np.int64), len(sums) - 1)
    high = np.minimum(low + 1, len(sums) - 1)
    part = (edges - low).reshape(-1, *[1] * (sums.ndim - 1))
    return sums[low] + (sums[high] - sums[low]) * part


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each target cell's exact area, cells cutting pixels included,
    from the integral image: one lookup per edge, whatever the scale."""
    rows = np.zeros((image.shape[0] + 1, *image.shape[1:]))
    np.cumsum(image, axis=0, out=rows[1:])
    strips = np.diff(_cumulative(rows, np.linspace(0, image.shape[0], h + 1)), axis=0)
    cols = np.zeros((image.shape[1] + 1, h, *image.shape[2:]))
    np.cumsum(np.swapaxes(strips, 0, 1), axis=0, out=cols[1:])
    cells = np.diff(_cumulative(cols, np.linspace(0, image.shape[1], w + 1)), axis=0)
    return np.swapaxes(cells, 0, 1) * (h * w / (image.shape[0] * image.shape[1]))


def tile(image: np.ndarray, h: int = TILE_H, w: int = TILE_W) -> np.ndarray:
    return np.clip(np.rint(area_resize(image, h, w)), 0, 255).astype(np.uint8)


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def difference_hash(tile_: np.ndarray) -> str:
    """A bit for each pair of horizontal neighbours, set where brightness falls."""
    grey = tile_.astype(np.int64)
    grey = grey @ np.array([299, 587, 114]) if grey.ndim == 3 else grey
    return np.packbits(grey[:, 1:] < grey[:, :-1]).tobytes().hex()


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def _store(batches: Iterator[pa.RecordBatch], form: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, media = [], []
        for t in b.column("text").to_pylist():
            n, payload = payload_of(t)
            sizes.append(n)
            image = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 3)
            bmp = form == "bmp" or form == "mixed" and len(image) % 2 == 1
            media.append((encode_bmp if bmp else encode_ppm)(image))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, form: str = "mixed", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with blanks to a
    positive multiple of 192, as a 64-pixel-wide RGB image: P6 (``ppm``), ``bmp``, or BMP
    where the image has an odd number of rows and P6 where it has an even one
    (``mixed``), so that equal texts have equal images.

    Null text counts as empty (one row of blanks); null ids, repeated rows and
    empty tables pass through; other columns are not read.
    """
    if form not in ("ppm", "bmp", "mixed"):
        raise ValueError("form is ppm, bmp or mixed")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    return map_batches(picked, lambda it: _store(it, form), "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(8)]
        for data in b.column("media").to_pylist():
            if data is None:
                row: tuple = (None,) * 8
            else:
                image = decode(data)
                payload = np.ascontiguousarray(image).tobytes()
                small = tile(image)
                stored = npy(small)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(small), stored, hashlib.sha256(stored).hexdigest())
            for o, v in zip(out, row, strict=True):
                o.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *[pa.array(o, k) for o, k in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_npy", "tile_sha256"])


def features(media: DataFrame) -> DataFrame:
    """Decode the stored bytes of ``store_texts`` and give their digests, the tile (8 x 9
    RGB) as the bytes of an NPY file, and its difference hash, as hex.

    Null media give null features; bytes that are no such image are an error.  Null ids,
    repeated rows and empty tables pass through.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary, tile_sha256 string"
    return map_batches(media.select("doc_id", "n_bytes", "media"), _features, schema)
