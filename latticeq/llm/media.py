"""Media columns: Netpbm and BMP images to numpy arrays, area resizing, NPY tiles and difference hashes.

Samples come out as their format says, scaled to the full range of a byte, or of 16 bits where the format has more
than 255 levels; :func:`area_resize` and the tiles keep that type.

Defined cases: null bytes decode to None; bytes that are no image, that end too early or that name a size, a range
or a palette entry beyond their bounds raise ``ValueError`` in the scalar functions and give null columns in
:func:`decode_column`; a null or empty text is stored as one row of 64 zero samples, a long one as a tall image;
equal texts, repeated rows and null ids give equal results, one row for each; an empty table gives an empty table;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows

ROW_SAMPLES = 64


def _number(digits: bytes) -> int:
    if len(digits) > 9:
        raise ValueError("Netpbm: a number is out of bounds")
    return int(digits)


def _full_range(samples: np.ndarray, top: int) -> np.ndarray:
    """Samples of 0 to ``top`` as bytes or, beyond 255 levels, 16-bit numbers of the whole range."""
    if samples.size and samples.max() > top:
        raise ValueError("Netpbm: a sample is out of range")
    most, kind = (255, np.uint8) if top < 256 else (65535, np.uint16)
    return samples.astype(kind) if top == most else ((samples.astype(np.uint64) * most + top // 2) // top).astype(kind)


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers of a Netpbm header behind its magic; comments run from ``#`` to the line's end."""
    at, found = 2, []
    while len(found) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) if data[at : at + 1] == b"#" else at + 1
            if at < 0:
                raise ValueError("Netpbm: a comment without an end")
        stop = at
        while stop < len(data) and data[stop : stop + 1].isdigit():
            stop += 1
        if stop == at:
            raise ValueError("Netpbm: a number is missing")
        found.append(_number(data[at:stop]))
        at = stop
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3) arrays in the full range; bitmaps become 0 (black) and 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, planes = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    (w, h), top = numbers[:2], 1 if bitmap else numbers[2]
    if not (w and h and 0 < top < 65536):
        raise ValueError("Netpbm: size or range is out of bounds")
    n, shape = w * h * planes, (h, w, 3) if planes == 3 else (h, w)
    if kind == b"P1":
        bits = [c - 48 for c in b"".join(line.split(b"#")[0] for line in data[at:].split(b"\n")) if c in b"01"]
        if len(bits) < n:
            raise ValueError("Netpbm: samples are missing")
        return (255 * (1 - np.array(bits[:n], np.uint8))).reshape(shape)
    if kind in (b"P2", b"P3"):
        words = b" ".join(line.split(b"#")[0] for line in data[at:].split(b"\n")).split()[:n]
        if len(words) < n or not all(map(bytes.isdigit, words)):
            raise ValueError("Netpbm: samples are missing")
        return _full_range(np.array([_number(x) for x in words], np.int64), top).reshape(shape)
    body = memoryview(data)[at + 1 :]
    if kind == b"P4":
        stride = (w + 7) // 8
        if len(body) < stride * h:
            raise ValueError("Netpbm: samples are missing")
        bits = np.unpackbits(np.frombuffer(body, np.uint8, stride * h).reshape(h, stride), axis=1)[:, :w]
        return (255 * (1 - bits)).astype(np.uint8)
    wide = np.dtype(np.uint8 if top < 256 else ">u2")
    if len(body) < n * wide.itemsize:
        raise ValueError("Netpbm: samples are missing")
    return _full_range(np.frombuffer(body, wide, n), top).reshape(shape)


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary graymap (P5) of 8-bit samples."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_ppm(rgb: np.ndarray) -> bytes:
    """A binary pixmap (P6) of 8-bit samples."""
    h, w, _ = rgb.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(rgb).tobytes()


def _masked(samples: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as bytes of the full range."""
    low = (mask & -mask).bit_length() - 1 if mask else 0
    most = mask >> low
    if not most or most & (most + 1):
        raise ValueError("BMP: a mask has no bits or gaps")
    part = (samples & np.uint32(mask)) >> np.uint32(low)
    return ((part.astype(np.uint64) * 255 + most // 2) // most).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 16, 24 or 32 bits, with masks or without, as (height, width, 3) RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, size, w, h, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    used = struct.unpack_from("<I", data, 46)[0]
    masks = [0x7C00, 0x3E0, 0x1F] if depth == 16 else [0xFF0000, 0xFF00, 0xFF]
    if packing in (3, 6) and depth in (16, 32) and len(data) >= 66:
        masks = list(struct.unpack_from("<III", data, 54))
    elif packing or depth not in (1, 4, 8, 16, 24, 32):
        raise ValueError("BMP: this kind is not supported")
    if size < 40 or w <= 0 or not h:
        raise ValueError("BMP: size is out of bounds")
    stride, rows = (w * depth + 31) // 32 * 4, abs(h)
    if len(data) < start + stride * rows:
        raise ValueError("BMP: samples are missing")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if depth <= 8:
        held = min(used or 1 << depth, 1 << depth, (len(data) - 14 - size) // 4)
        colors = np.frombuffer(data, np.uint8, 4 * max(held, 0), 14 + size).reshape(-1, 4)
        index = raw if depth == 8 else np.unpackbits(raw, axis=1) if depth == 1 else np.stack((raw >> 4, raw & 15), 2).reshape(rows, -1)
        if index[:, :w].max() >= len(colors):
            raise ValueError("BMP: a palette entry is missing")
        out = colors[index[:, :w]][:, :, 2::-1]
    elif depth == 24:
        out = raw[:, : 3 * w].reshape(rows, w, 3)[:, :, ::-1]
    else:
        samples = np.ascontiguousarray(raw).view("<u2" if depth == 16 else "<u4")[:, :w].astype(np.uint32)
        out = np.stack([_masked(samples, m) for m in masks], 2)
    return np.ascontiguousarray(out[::-1] if h > 0 else out)


def encode_bmp(rgb: np.ndarray) -> bytes:
    """A 24-bit bottom-up BMP."""
    h, w, _ = rgb.shape
    stride = (3 * w + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode_image(data: bytes | None) -> np.ndarray | None:
    return None if data is None else decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _area(samples: np.ndarray, out: int) -> np.ndarray:
    """Area means along the first axis, from its running sums (a one-dimensional integral image)."""
    n = samples.shape[0]
    sums = np.zeros((n + 1, *samples.shape[1:]))
    np.cumsum(samples, axis=0, out=sums[1:])
    edges = np.arange(out + 1) * (n / out)
    low = np.minimum(edges.astype(np.int64), n - 1)
    part = (edges - low).reshape(-1, *[1] * (samples.ndim - 1))
    at = sums[low] + part * (sums[low + 1] - sums[low])
    return np.diff(at, axis=0) * (out / n)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area resizing by integral images, one axis after the other, so that memory stays near the image's own."""
    narrow = np.swapaxes(_area(np.swapaxes(image, 0, 1), width), 0, 1)
    return np.clip(np.rint(_area(narrow, height)), 0, np.iinfo(image.dtype).max).astype(image.dtype)


def gray(image: np.ndarray) -> np.ndarray:
    if image.dtype == np.uint16:
        image = (image >> 8).astype(np.uint8)
    return image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def npy_bytes(array: np.ndarray) -> bytes:
    """NPY format 1.0, as ``numpy.save`` writes it, for C-ordered arrays."""
    head = f"{{'descr': '{np.lib.format.dtype_to_descr(array.dtype)}', 'fortran_order': False, 'shape': {array.shape!r}, }}"
    head += " " * (-(10 + len(head) + 1) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + np.ascontiguousarray(array).tobytes()


def difference_hash(image: np.ndarray) -> int:
    """64 bits: in an 8 by 9 area-resized gray image, 1 where a sample is greater than its left neighbour."""
    small = area_resize(gray(image), 8, 9).astype(np.int16)
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


def tile(data: bytes, side: int = 32) -> tuple[bytes, int]:
    """NPY bytes of the ``side`` by ``side`` tile of an encoded image, and the difference hash."""
    image = decode_image(data)
    return npy_bytes(area_resize(image, side, side)), difference_hash(image)


def decode_column(images: DataFrame, id_col: str, media_col: str, side: int = 32) -> DataFrame:
    """``id``, ``height``, ``width``, ``tile`` (NPY) and ``dhash`` (16 hex digits); nulls where bytes are no image."""
    schema = pa.schema([("id", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("tile", pa.binary()), ("dhash", pa.string())])

    def one(data):
        try:
            image = decode_image(data)
        except ValueError:
            image = None
        return (None,) * 4 if image is None else (*image.shape[:2], npy_bytes(area_resize(image, side, side)), f"{difference_hash(image):016x}")

    def work(ids, media):
        rows = [one(m) for m in media]
        return [ids, *([r[k] for r in rows] for k in range(4))]

    return images.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{media_col}` AS media").mapInArrow(arrow_rows(lambda: work, schema), "id bigint, height bigint, width bigint, tile binary, dhash string")


def write_tiles(images: DataFrame, path: str, id_col: str = "doc_id", media_col: str = "media", side: int = 32) -> DataFrame:
    """Decode a column of images and store what :func:`decode_column` gives, the NPY tiles among it, as Parquet."""
    decode_column(images, id_col, media_col, side).write.mode("overwrite").parquet(path)
    return images.sparkSession.read.parquet(path)


KINDS = ("pgm", "ppm", "bmp")


def text_to_media(text: str | None) -> tuple[bytes, int]:
    """A whole text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as an image; and their number.

    The kind goes by the payload's CRC-32: a graymap 64 samples wide or, where the payload fills rows of 64 colors, a
    pixmap or a bitmap.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + bytes(-len(raw) % ROW_SAMPLES or (0 if raw else ROW_SAMPLES))
    samples, kind = np.frombuffer(padded, np.uint8), KINDS[zlib.crc32(padded) % 3]
    if kind == "pgm" or len(padded) % (3 * ROW_SAMPLES):
        return encode_pgm(samples.reshape(-1, ROW_SAMPLES)), len(raw)
    return (encode_ppm if kind == "ppm" else encode_bmp)(samples.reshape(-1, ROW_SAMPLES, 3)), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each text stored losslessly as an image."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def work(ids, texts):
        made = [text_to_media(t) for t in texts]
        return [ids, [n for _, n in made], [m for m, _ in made]]

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"cast(`{text_col}` as string) AS text").mapInArrow(arrow_rows(lambda: work, schema), "doc_id bigint, n_bytes bigint, media binary")


def describe(stored: DataFrame, side: int = 32) -> DataFrame:
    """Read stored media back: digests of the samples and of the stored form, and a feature string.

    The feature is the difference hash, a colon, and the CRC-32 of the NPY tile, which is in ``tile`` itself; equal
    texts have equal features.
    """
    kinds = [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("tile", "binary")]
    arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, arrow[k]) for n, k in kinds])

    def one(media):
        image = decode_image(media)
        payload = np.ascontiguousarray(image).data.cast("B")
        small, bits = npy_bytes(area_resize(image, side, side)), difference_hash(image)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW_SAMPLES:]), len(media), hashlib.sha256(media).hexdigest(), f"{bits:016x}:{zlib.crc32(small):08x}", small

    def work(ids, sizes, media):
        rows = [one(m) for m in media]
        return [ids, sizes, *([r[k] for r in rows] for k in range(7))]

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(arrow_rows(lambda: work, schema), ", ".join(f"{n} {k}" for n, k in kinds))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 10 over all documents."""
    return describe(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
