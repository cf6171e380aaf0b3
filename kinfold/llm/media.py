"""Media columns: Netpbm and BMP bytes, numpy arrays, area resize, NPY tiles, difference hashes.

Images live in binary columns.  ``decode`` reads binary Netpbm (P5, P6) and
uncompressed 8- or 24-bit BMP into numpy arrays; ``area_resize`` averages exact
pixel areas by an integral image; ``to_tiles`` cuts an array into NPY files;
``dhash`` compares neighbours of an area-resized grey image.

``text_media`` takes texts as P6 images of 64 pixels a row (192 samples), decodes
them, stores the arrays losslessly as NPY tiles, reads the stored bytes back and
derives payload and features from what it read.
Null text counts as empty, an empty text is one row of blanks, repeated rows
give repeated results, further columns are ignored, and an empty table gives no
rows.  Nothing is gathered across rows, so a row's memory is a small multiple of
its own bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import as_bytes, table
from kinfold.shared import python_ready, tidy

#: Samples in a row of a text image: 64 pixels of three samples.
ROW = 192
#: Rows of a tile of a text image: 192 KiB.
TILE_ROWS = 1024


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for (h, w) and P6 for (h, w, 3) arrays of 8-bit samples."""
    h, w = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, w, h) + image.astype(np.uint8, copy=False).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """Binary P5 or P6 with a maximum of 255; comments in the header are skipped."""
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
            if end > len(data):
                raise ValueError("the header ends early")
        fields.append(int(data[at:end]))
        at = end
    w, h, most = fields
    if data[:2] not in (b"P5", b"P6") or most != 255:
        raise ValueError("not an 8-bit P5 or P6 image")
    shape = (h, w, 3) if data[:2] == b"P6" else (h, w)
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), at + 1).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """Bottom-up 24-bit BMP of an (h, w, 3) array, or 8-bit with a grey palette of an (h, w) array."""
    h, w = image.shape[:2]
    grey = image.ndim == 2
    rows = image[::-1] if grey else image[::-1, :, ::-1].reshape(h, w * 3)
    pad = -rows.shape[1] % 4
    body = np.pad(rows, ((0, 0), (0, pad))).astype(np.uint8).tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0) + palette + body


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24-bit BMP as (h, w, 3); 8-bit through its palette, as (h, w) where that is grey."""
    start, head, w, h = struct.unpack_from("<IIii", data, 10)
    bits, packed = struct.unpack_from("<HI", data, 28)
    if data[:2] != b"BM" or packed or bits not in (8, 24):
        raise ValueError("not an uncompressed 8- or 24-bit BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows.reshape(abs(h), w, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    """The sum of a pixel's samples, as a plane of integers."""
    if image.ndim == 2:
        return image.astype(np.uint32)
    out = image[:, :, 0].astype(np.uint32)
    out += image[:, :, 1]
    out += image[:, :, 2]
    return out


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas of a plane, with fractions of pixels at the borders, by an integral image."""
    h, w = plane.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(plane, axis=0, dtype=np.float64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], axis=1, out=total[1:, 1:])

    def at(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(n + 1) * size / n
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, edge - low

    y, fy = at(height, h)
    x, fx = at(width, w)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    both = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return (both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]) / (h / height * (w / width))


def dhash(plane: np.ndarray) -> str:
    """64 bits: in an 8 by 9 area resize, is each cell darker than its right neighbour?"""
    small = np.round(area_resize(plane, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_tiles(image: np.ndarray, rows: int) -> Iterator[bytes]:
    """NPY files of at most ``rows`` rows each, in order; joined along the first axis they give the image."""
    for at in range(0, len(image), rows):
        out = io.BytesIO()
        np.save(out, np.ascontiguousarray(image[at : at + rows]), allow_pickle=False)
        yield out.getvalue()


def from_tiles(tiles: list[bytes]) -> np.ndarray:
    return np.concatenate([np.load(io.BytesIO(t), allow_pickle=False) for t in tiles])


def text_to_image(text: bytes) -> bytes:
    """A text's bytes, blanks up to a positive multiple of 192, as a P6 image."""
    size = max(1, -(-len(text) // ROW))
    return b"P6\n%d %d\n255\n" % (ROW // 3, size) + text.ljust(size * ROW)


def image_to_text(data: bytes, n_bytes: int) -> bytes:
    return decode(data).tobytes()[:n_bytes]


def media_tiles(df: DataFrame, key: str, media: str, rows: int = 256) -> DataFrame:
    """(key, tile, npy): each image of a binary column as NPY tiles."""
    kind = df.schema[key].dataType
    python_ready(df.sparkSession, 256)

    def run(batches):
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, npy in enumerate(to_tiles(decode(data), rows) if data else ()):
                    yield pa.RecordBatch.from_pydict({"key": pa.array([k], b.schema.field(0).type), "tile": pa.array([i], pa.int32()), "npy": pa.array([npy], pa.binary())})

    return df.select(key, media).mapInArrow(tidy(run), f"key {kind.simpleString()}, tile int, npy binary")


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def tile_features(tiles: list[bytes], n_bytes: int) -> tuple:
    """What ``text_media`` reports, from stored tiles alone."""
    image = from_tiles(tiles)
    payload, media = image.reshape(-1).data, hashlib.sha256()
    for t in tiles:
        media.update(t)
    return n_bytes, image.size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), sum(map(len, tiles)), media.hexdigest(), dhash(grey(image))


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text as an image in a binary column."""

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(map(text_to_image, texts), pa.binary())], ["key", "n_bytes", "media"])

    python_ready(df.sparkSession)
    return df.select(key, text).mapInArrow(tidy(run), "key long, n_bytes long, media binary")


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of features a text; see the module's text for nulls, empty texts and repeats."""

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(1))]
            rows = [(k, *tile_features(list(to_tiles(decode(text_to_image(t)), TILE_ROWS)), len(t))) for k, t in zip(b.column(0).to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FEATURES)] if rows else [pa.array([], f.type) for f in _FEATURES], schema=_FEATURES)

    python_ready(df.sparkSession)
    return df.select(key, text).mapInArrow(tidy(run), FEATURES)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
