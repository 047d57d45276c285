"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, tiled as NPY, with difference hashes.

``decode`` reads binary PGM and PPM (P5, P6; 8 bits) and uncompressed BMP (8-bit palette, 24 and 32 bits; bottom-up or top-down).
``resize`` averages over areas with integral images, fractional edges weighted; it takes memory for a strip of lines, not for the image. Tiles are NPY files in a
binary column. The images here carry texts: 192 bytes are one line of 64 RGB pixels, padded with spaces.

Edge cases: a null or empty text is one line of spaces; images of any height, down to one line, can be resized; repeated rows give
equal values; a damaged image raises ValueError in ``decode`` and is a null row in ``image_features``; an empty table gives no rows.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, through_table

LINE_PIXELS = 64
LINE_BYTES = 3 * LINE_PIXELS
TILE = 16
HASH_SIDE = 8


def encode_ppm(pixels: np.ndarray) -> bytes:
    """P6 of (height, width, 3), P5 of (height, width); 8 bits."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit, bottom-up BMP of (height, width, 3)."""
    height, width = pixels.shape[:2]
    stride = (3 * width + 3) // 4 * 4
    lines = np.zeros((height, stride), np.uint8)
    lines[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, -1)
    body = lines.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _decode_netpbm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([56])(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)\s", data)
    if not head:
        raise ValueError("not a binary PGM or PPM")
    width, height, most = (int(x) for x in head.groups()[1:])
    if not 0 < most < 256:
        raise ValueError("only 8-bit samples are read")
    shape = (height, width, 3) if head[1] == b"6" else (height, width)
    size = int(np.prod(shape))
    if len(data) - head.end() < size:
        raise ValueError("samples are missing")
    return np.frombuffer(data, np.uint8, size, head.end()).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("a BMP header is missing")
    offset, header, width, height, _, bits, packed = struct.unpack_from("<I4xI", data, 10)[0:1] + struct.unpack_from("<IiiHHI", data, 14)
    if packed != 0 or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is read")
    stride, lines = (bits // 8 * width + 3) // 4 * 4, abs(height)
    if len(data) < offset + stride * lines:
        raise ValueError("samples are missing")
    raw = np.frombuffer(data, np.uint8, stride * lines, offset).reshape(lines, stride)[:, : bits // 8 * width]
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, offset - 14 - header, 14 + header).reshape(-1, 4)
        return colours[raw][:, :, 2::-1]
    return raw.reshape(lines, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP file: uint8, (height, width) or (height, width, 3)."""
    return _decode_bmp(data) if data[:2] == b"BM" else _decode_netpbm(data)


#: Samples of an image that are summed up at once.
STRIP = 1 << 18
#: Files made or read at a time: so many rows, and about so many bytes.
PIECE_ROWS, PIECE_BYTES = 500, 8 << 20


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of a height x width grid, in float64, from an integral image that is made in strips of lines."""
    lines, columns = pixels.shape[:2]
    down, across = np.arange(height + 1) * (lines / height), np.arange(width + 1) * (columns / width)
    low = np.minimum(across.astype("i8"), columns - 1)
    share = (across - low).reshape(1, -1, *[1] * (pixels.ndim - 2))

    def edges(sums: np.ndarray) -> np.ndarray:
        """Of sums along the lines, those up to each fractional edge."""
        return sums[:, low] * (1 - share) + sums[:, low + 1] * share

    above = np.zeros((1, width + 1, *pixels.shape[2:]))
    at = np.zeros((height + 1, *above.shape[1:]))
    step = max(1, STRIP // max(1, int(np.prod(pixels.shape[1:]))))
    for begin in range(0, lines, step):
        strip = pixels[begin : begin + step]
        sums = np.zeros((len(strip), columns + 1, *pixels.shape[2:]))
        sums[:, 1:] = strip.cumsum(1, dtype="f8")
        integral = np.concatenate([above, above + edges(sums).cumsum(0)])
        last = begin + len(strip)
        own = np.flatnonzero((down > begin) & ((down <= last) | (last == lines)))
        line = np.minimum(down[own].astype("i8"), last - 1) - begin
        part = (down[own] - begin - line).reshape(-1, *[1] * (pixels.ndim - 1))
        at[own] = integral[line] * (1 - part) + integral[line + 1] * part
        above = integral[-1:]
    areas = np.diff(np.diff(at, axis=0), axis=1)
    return areas * (height * width / (lines * columns))


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, pixels, allow_pickle=False)
    return out.getvalue()


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels


def difference_hash(pixels: np.ndarray, side: int = HASH_SIDE) -> str:
    """side * side bits in hex: is a cell brighter than its right neighbour?"""
    small = np.round(grey(resize(pixels, side, side + 1)), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def text_images(docs: DataFrame, form: str = "ppm") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an image file of 64 pixels a line."""
    encode = {"ppm": encode_ppm, "bmp": encode_bmp}[form]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_ROWS, PIECE_BYTES):
                sizes, files = [], []
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode()
                    sizes.append(len(raw))
                    raw = raw.ljust(max(1, -(-len(raw) // LINE_BYTES)) * LINE_BYTES, b" ")
                    files.append(encode(np.frombuffer(raw, np.uint8).reshape(-1, LINE_PIXELS, 3)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def image_features(images: DataFrame) -> DataFrame:
    """The ids and sizes of ``images`` with digests of the decoded samples and the file, difference hash and NPY tile."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, difference_hash string, tile binary"
    names = [x.split()[0] for x in fields.split(", ")]

    def features(media: bytes | None) -> tuple:
        try:
            pixels = decode(media or b"")
        except ValueError:
            return (None,) * 7
        payload = pixels.tobytes()
        tile = np.round(resize(pixels, TILE, TILE)).astype(np.uint8)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), npy(tile)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, PIECE_ROWS, PIECE_BYTES, "media"):
                columns = zip(*map(features, part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return images.select("doc_id", "n_bytes", "media").mapInArrow(read, fields)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = through_table(text_images(table(spark, sf_dir, "documents")), "media")
    tiles = through_table(image_features(stored), "media-tiles")
    digest = F.concat_ws(":", "difference_hash", F.substring(F.sha2("tile", 256), 1, 16))
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", digest.alias("feature"))


QUERIES = {"op9_media": op9_media}
SQL: dict[str, str] = {}
