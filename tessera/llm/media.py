"""Media columns: bytes stored as Netpbm or BMP images, decoded to numpy arrays, area-resized, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64


# --- encoders and decoders ---------------------------------------------------------------------------------------


def encode_pgm(a: np.ndarray) -> bytes:
    """A [height, width] uint8 array as binary PGM (P5)."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """A [height, width] uint8 array as 8-bit BMP with a gray palette, rows from the bottom."""
    h, w = a.shape
    pad = -w % 4
    start = 14 + 40 + 1024
    size = start + (w + pad) * h
    palette = np.zeros((256, 4), dtype=np.uint8)
    palette[:, :3] = np.arange(256, dtype=np.uint8)[:, None]
    head = struct.pack("<2sIHHI", b"BM", size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, (w + pad) * h, 2835, 2835, 256, 0)
    return head + palette.tobytes() + np.pad(a[::-1], ((0, 0), (0, pad))).tobytes()


def _netpbm_header(b: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header, after comments are skipped, and where the samples begin."""
    out, i = [], 2
    while len(out) < fields:
        while i < len(b) and (b[i : i + 1].isspace() or b[i] == 35):
            if b[i] == 35:
                i = (b.find(b"\n", i) + 1) or len(b)
            else:
                i += 1
        j = i
        while j < len(b) and 48 <= b[j] <= 57:
            j += 1
        if i == j:
            raise ValueError("bad Netpbm header")
        out.append(int(b[i:j]))
        i = j
    return out, i + 1


def decode_netpbm(b: bytes) -> np.ndarray:
    """P1 to P6 as [height, width] or [height, width, 3] of uint8 or (maximum over 255) uint16; bitmaps give 0 (black) and 255."""
    kind = b[1] - 48 if b[:1] == b"P" and len(b) > 2 else 0
    if not 1 <= kind <= 6:
        raise ValueError("not Netpbm")
    bitmap, depth = kind in (1, 4), 3 if kind in (3, 6) else 1
    head, at = _netpbm_header(b, 2 if bitmap else 3)
    w, h = head[:2]
    top = 1 if bitmap else head[2]
    if not 0 < top < 65536:
        raise ValueError("bad maximum")
    n = w * h * depth
    if kind == 1:
        a = np.frombuffer(bytes(c for c in b[at - 1 :] if c in b"01"), dtype=np.uint8)[:n] - 48
    elif kind in (2, 3):
        a = np.array(b[at - 1 :].split()[:n], dtype=np.int64).astype(np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        row = -(-w // 8)
        a = np.unpackbits(np.frombuffer(b, dtype=np.uint8, offset=at, count=row * h).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        a = np.frombuffer(b, dtype=">u2" if top > 255 else np.uint8, offset=at, count=n).astype(np.uint16 if top > 255 else np.uint8)
    if len(a) != n:
        raise ValueError("short image")
    if bitmap:
        a = np.where(a == 1, 0, 255).astype(np.uint8)
    return a.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(b: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette) and 24- or 32-bit BMP; gray palettes give [height, width], others [height, width, 3] in RGB."""
    if b[:2] != b"BM" or len(b) < 54:
        raise ValueError("not BMP")
    start = struct.unpack_from("<I", b, 10)[0]
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", b, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    used = struct.unpack_from("<I", b, 46)[0] or 256
    row = -(-w * bits // 32) * 4
    a = np.frombuffer(b, dtype=np.uint8, offset=start, count=row * abs(h)).reshape(abs(h), row)
    a = a[::-1] if h > 0 else a
    if bits == 8:
        palette = np.frombuffer(b, dtype=np.uint8, offset=14 + size, count=4 * used).reshape(-1, 4)[:, 2::-1]
        a = a[:, :w]
        gray = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
        if gray and used == 256 and (palette[:, 0] == np.arange(256)).all():
            return a
        return palette[:, 0][a] if gray else palette[a]
    return a[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(b: bytes) -> np.ndarray:
    return decode_bmp(b) if b[:2] == b"BM" else decode_netpbm(b)


# --- features ----------------------------------------------------------------------------------------------------


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The points that cut 0 to n into equal parts, as whole numbers below n and fractions."""
    p = np.linspace(0, n, parts + 1)
    lo = np.minimum(p.astype(np.int64), n - 1)
    return lo, p - lo


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, from an integral image that is read between its points linearly: exact for fractions of pixels.

    Only the rows of the integral image that are read are made, by sums over the rows between them, so that a very tall
    image (a long text) needs no array of its size.
    """
    rows, cols = a.shape[:2]
    lo, frac = _edges(rows, height)
    at = np.unique(np.concatenate([[0], lo, lo + 1]))
    bands = np.add.reduceat(a, at[at < rows], axis=0, dtype=np.float64)  # sums of the rows from each point to the next
    bands = bands.mean(axis=2) if bands.ndim == 3 else bands
    s = np.zeros((len(at), cols + 1))
    s[1:, 1:] = np.cumsum(np.cumsum(bands, axis=0), axis=1)[: len(at) - 1]
    i = np.searchsorted(at, lo)
    e = s[i] * (1 - frac)[:, None] + s[i + 1] * frac[:, None]
    lo, frac = _edges(cols, width)
    e = e[:, lo] * (1 - frac) + e[:, lo + 1] * frac
    return np.diff(np.diff(e, axis=0), axis=1) * (height * width / (rows * cols))


def difference_hash(a: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each of 8 by 8 cells is darker than its right neighbour in a 9 by 8 area-resized image."""
    small = area_resize(a, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(a: np.ndarray, side: int = 16) -> bytes:
    """The image area-resized to side by side bytes, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(a, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


# --- tables ------------------------------------------------------------------------------------------------------


def pad64(b: bytes) -> bytes:
    return b + bytes(64 - len(b) % 64 if len(b) % 64 or not b else 0)


def encode_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text (null: empty) as UTF-8, zero bytes up to a positive multiple of 64, stored losslessly as
    gray samples of an image 64 wide; texts with an even number of rows become PGM, others BMP, so equal texts have equal media.
    Ids of any type, null ones too, stay as they are: they pass through Python as text."""

    def make(batches):
        for pdf in batches:
            raw = [(t or "").encode() for t in pdf["text"]]
            media = []
            for b in raw:
                a = np.frombuffer(pad64(b), dtype=np.uint8).reshape(-1, WIDTH)
                media.append(encode_bmp(a) if len(a) % 2 else encode_pgm(a))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [len(b) for b in raw], "media": media})

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(make, "doc_id string, n_bytes long, media binary").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, tile, dhash) of media columns, from the decoded pixels; media that cannot be decoded (null, broken)
    have null in the last three."""

    def read(batches):
        for pdf in batches:
            rows = []
            for m in pdf["media"]:
                try:
                    a = decode(m)
                except (ValueError, TypeError, struct.error):
                    rows.append((None, None, None))
                    continue
                rows.append((a.tobytes(), npy_tile(a), difference_hash(a)))
            payload, tile, dhash = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "payload": payload, "tile": tile, "dhash": dhash})

    rows = media.select(F.col("doc_id").cast("string").alias("doc_id"), "n_bytes", "media").mapInPandas(read, "doc_id string, n_bytes long, payload binary, tile binary, dhash string")
    return rows.withColumn("doc_id", F.col("doc_id").cast(media.schema["doc_id"].dataType))


def media_tiles(media: DataFrame) -> DataFrame:
    """Media columns with payloads as digests, in one pass: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, tile, dhash), tile being an NPY file. All media must be whole."""

    def read(batches):
        for pdf in batches:
            rows = []
            for i, n, m in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
                a = decode(m)
                p = a.tobytes()
                rows.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), npy_tile(a), difference_hash(a)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "dhash"])

    rows = media.select(F.col("doc_id").cast("string").alias("doc_id"), "n_bytes", "media")
    rows = rows.mapInPandas(read, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, dhash string")
    return rows.withColumn("doc_id", F.col("doc_id").cast(media.schema["doc_id"].dataType))


def read_tile(tile: bytes) -> np.ndarray:
    """The pixels of an NPY tile."""
    return np.load(io.BytesIO(tile))


def store_and_read(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes media columns to path/media, reads them back, writes their tiles and hashes to path/tiles and returns what is read there,
    with tile as its digest: (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tile_sha256).
    One row for each row of docs; an empty table gives an empty result."""
    media = encode_payloads(docs, id_col, text_col)
    media.write.option("compression", "zstd").parquet(f"{path}/media")
    tiles = media_tiles(docs.sparkSession.read.schema(media.schema).parquet(f"{path}/media"))
    tiles.write.option("compression", "zstd").parquet(f"{path}/tiles")
    back = docs.sparkSession.read.schema(tiles.schema).parquet(f"{path}/tiles")
    return back.withColumnRenamed("dhash", "feature").withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")
