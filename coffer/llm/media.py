"""Media columns: Netpbm and BMP images decoded to arrays, resized by area, written as NPY tiles with difference hashes.

``process_media`` takes any binary column of images. ``text_media`` is the
lossless container of ``documents``: a text's bytes as the grey samples of a
PGM image 64 samples wide.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import in_small_batches, parts, text_bytes

WIDTH = 64
TILE = 16


class MediaError(ValueError):
    """The bytes are no image of a known format."""


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers after the magic, with white space and # comments between them, and where the samples begin."""
    values: list[int] = []
    at = 2
    while len(values) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == ord("#")):
            if data[at] == ord("#"):
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at or at - start > 9:
            raise MediaError("bad Netpbm header")
        values.append(int(data[start:at]))
    return values, at + 1  # one white space byte ends the header


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (height, width) or (height, width, 3); uint8, or uint16 where the maximum is above 255. Bitmaps: 1 is black, so 0 in the array."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not Netpbm")
    bitmap = kind in (b"P1", b"P4")
    numbers, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    top = 1 if bitmap else numbers[2]
    if not width or not height or not 0 < top < 65536:
        raise MediaError("bad Netpbm size or maximum")
    count = width * height * depth
    if kind == b"P4":
        stride = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, stride * height, at) if len(data) - at >= stride * height else None
        if raw is None:
            raise MediaError("short Netpbm samples")
        return (1 - np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width]) * np.uint8(255)
    if kind in (b"P1", b"P2", b"P3"):
        text = data[at - 1 :]
        tokens = [c for c in text if c in b"01"] if bitmap else text.split()
        if len(tokens) < count:
            raise MediaError("short Netpbm samples")
        if bitmap:
            flat = 255 * (1 - (np.array(tokens[:count], np.int64) - 48))
        else:
            try:
                flat = np.array([int(t) for t in tokens[:count]], np.int64)
            except ValueError as e:
                raise MediaError("bad Netpbm sample") from e
            if flat.size and (flat.min() < 0 or flat.max() > top):
                raise MediaError("Netpbm sample above the maximum")
        flat = flat.astype(np.uint16 if top > 255 else np.uint8)
    else:
        unit = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        if len(data) - at < count * unit.itemsize:
            raise MediaError("short Netpbm samples")
        flat = np.frombuffer(data, unit, count, at).astype(unit.newbyteorder("="))
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_pgm(samples: np.ndarray) -> bytes:
    """Grey samples (height, width), uint8, as P5."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as an array (height, width, 3), top row first, red first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not BMP")
    (start,) = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if width <= 0 or height == 0 or packing not in (0, 3) or bits not in (8, 24, 32) or (packing == 3 and bits != 32):
        raise MediaError("unsupported BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(data) - start < stride * rows:
        raise MediaError("short BMP samples")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * bits // 8]
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        (used,) = struct.unpack_from("<I", data, 46)
        used = used or 256
        if len(data) < 14 + head + 4 * used:
            raise MediaError("short BMP palette")
        palette = np.zeros((256, 3), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)[:, 2::-1]
        return palette[raw]
    return raw.reshape(rows, width, bits // 8)[:, :, 2::-1]


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Colour samples (height, width, 3), uint8, as 24-bit BMP."""
    height, width = pixels.shape[:2]
    stride = (width * 24 + 31) // 32 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0)
    return head + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """An image of either family."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


#: Samples that are held as 64-bit numbers at once: a strip of an image's rows.
STRIP = 1 << 18


def grey(pixels: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 as float64 (height, width); colour by the weights 299, 587, 114 of a thousand."""
    values = pixels.astype(np.float64)
    if pixels.dtype == np.uint16:
        values /= 257.0
    return values @ np.array([0.299, 0.587, 0.114]) if values.ndim == 3 else values


def integral_rows(pixels: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows ``at`` (ascending, from 0 to the height) of the integral image of ``pixels`` in grey: sums of all above and left of each corner.

    Rows between are summed strip by strip, so an image of any height takes
    STRIP numbers and the rows asked for.
    """
    step = max(1, STRIP // max(1, pixels[0].size))
    out, total, done = np.zeros((len(at), pixels.shape[1] + 1)), np.zeros(pixels.shape[1]), 0
    for i, row in enumerate(at.tolist()):
        for first in range(done, row, step):
            total += grey(pixels[first : min(first + step, row)]).sum(0)
        done = row
        out[i, 1:] = total.cumsum()
    return out


def resize_area(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of ``pixels`` in grey over each cell of a height x width grid, parts of samples counted by area.

    Between its corners the integral image is bilinear, so four lookups give the
    sum of any cell, and only its rows at the cells' edges are needed.
    """
    rows, cols = pixels.shape[:2]
    y, x = np.arange(height + 1) * (rows / height), np.arange(width + 1) * (cols / width)
    top, left = np.minimum(y.astype(np.int64), rows - 1), np.minimum(x.astype(np.int64), cols - 1)
    fy, fx = (y - top)[:, None], (x - left)[None, :]
    needed = np.unique(np.concatenate([top, top + 1]))
    integral = integral_rows(pixels, needed)
    at_rows = integral[np.searchsorted(needed, top)] * (1 - fy) + integral[np.searchsorted(needed, top + 1)] * fy
    corners = at_rows[:, left] * (1 - fx) + at_rows[:, left + 1] * fx
    return np.diff(np.diff(corners, axis=0), axis=1) / ((rows / height) * (cols / width))


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side, as the bytes of an NPY file of uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize_area(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: on an 8 x 9 grid, is a cell brighter than its right neighbour (by more than rounding)?"""
    cells = np.rint(resize_area(image, 8, 9) * 256)
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


_MEDIA_FIELDS = [("height", pa.int64()), ("width", pa.int64()), ("samples", pa.binary()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())]


def describe(data: bytes | None, side: int = TILE) -> tuple:
    """height, width, samples, NPY tile, difference hash and error of one image."""
    if data is None:
        return None, None, None, None, None, "no media"
    try:
        pixels = decode(data)
    except MediaError as e:
        return None, None, None, None, None, str(e)
    return pixels.shape[0], pixels.shape[1], pixels.tobytes(), npy_tile(pixels, side), difference_hash(pixels), None


def process_media(df: DataFrame, media: str, keep: list[str], side: int = TILE) -> DataFrame:
    """Decode the images of column ``media``: adds height, width, samples (decoded, native byte order), tile, dhash, error.

    ``keep`` names the columns to carry along. Null media, or bytes that are no
    image, give nulls and say why in ``error``. One row in, one row out; each
    row is on its own, so equal bytes give equal results.
    """
    narrow = df.select(*[F.col(k) for k in keep], F.col(media).alias("media_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = list(zip(*[describe(b, side) for b in part.column(len(keep)).to_pylist()], strict=True))
                columns = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(v, t) for v, (_, t) in zip(found, _MEDIA_FIELDS, strict=True)], names=keep + [n for n, _ in _MEDIA_FIELDS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)])
    return in_small_batches(narrow).mapInArrow(run, kinds + ", height bigint, width bigint, samples binary, tile binary, dhash string, error string")


def text_media(docs: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) as PGM images: doc_id, n_bytes, media.

    A text's UTF-8 bytes (null: none) are padded with bytes 0 to a positive
    multiple of 64 and are the samples of an image 64 wide.
    """
    raw = text_bytes()
    n = F.octet_length(raw).cast("long")
    rows = F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("long")
    head = F.concat(F.lit(f"P5\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    zeros = F.unhex(F.repeat(F.lit("00"), (rows * WIDTH - n).cast("int")))
    return docs.select("doc_id", n.alias("n_bytes"), F.concat(head, raw, zeros).alias("media"))


def media_features(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: digests of the text's stored media and of what is read back from it, and its feature.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (difference hash and CRC-32 of the NPY
    tile). Null and empty texts: 64 zero bytes. Null or repeated doc_ids: kept.
    A worker holds one image at a time beside its batch, and of that its bytes,
    its samples and STRIP numbers.
    """
    stored = text_media(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields if f.name in keep)
    kinds += ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = [_digests(data.as_py()) for data in batch.column(len(keep))]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    read = in_small_batches(stored.select(*keep, "media")).mapInArrow(run, kinds)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def _digests(stored: bytes) -> tuple[int, str, int, str]:
    """Of what is read back from an image: its samples' number, SHA-256 and the CRC-32 of the last WIDTH; its difference hash and its tile's CRC-32. Only these leave the worker."""
    _, _, samples, tile, dhash, error = describe(stored)
    if error is not None:
        raise MediaError(error)
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), f"{dhash}-{zlib.crc32(tile):08x}"
