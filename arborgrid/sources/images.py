"""Portable pixmaps (P2, P5, P6) and PNG files as pixel tables."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from arborgrid.sources.tabular import writer


def decode_pnm(data: bytes) -> np.ndarray:
    """Array (height, width, bands) of a P2, P5 or P6 file; comments in the head are skipped."""
    fields: list[bytes] = []
    at = 0
    while len(fields) < 4:
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*([^\s#]+)").match(data, at)
        if not m:
            raise ValueError("no portable pixmap")
        fields.append(m.group(1))
        at = m.end()
    kind, (w, h, top) = fields[0], (int(f) for f in fields[1:])
    bands = 3 if kind == b"P6" else 1
    if kind == b"P2":
        values = np.array(data[at:].split()[: w * h], dtype=np.int64)
    elif kind in (b"P5", b"P6"):
        values = np.frombuffer(data, dtype=np.uint8 if top < 256 else ">u2", count=w * h * bands, offset=at + 1).astype(np.int64)
    else:
        raise ValueError(f"format {kind!r} is not known")
    return values.reshape(h, w, bands)


def encode_pnm(a: np.ndarray) -> bytes:
    """P5 for one band, P6 for three; 8 bits up to 255, else 16."""
    h, w, bands = a.shape
    top = 255 if a.max(initial=0) < 256 else 65535
    return f"P{5 if bands == 1 else 6}\n{w} {h}\n{top}\n".encode() + np.ascontiguousarray(a, dtype=np.uint8 if top == 255 else ">u2").tobytes()


PNG = b"\x89PNG\r\n\x1a\n"
#: Bands of PNG colour types: gray, RGB, gray and opacity, RGB and opacity.
PNG_BANDS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """Array (height, width, bands) of a PNG file of 8 or 16 bits without palette or interlacing; other
    kinds raise ValueError."""
    if not data.startswith(PNG):
        raise ValueError("no PNG")
    at, packed, head = len(PNG), b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
    if head is None or head[3] not in PNG_BANDS or head[2] not in (8, 16) or head[6]:
        raise ValueError("a kind of PNG that is not known")
    w, h, bits, kind = head[:4]
    bands, step = PNG_BANDS[kind], PNG_BANDS[kind] * bits // 8
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), dtype=np.uint8)
    above = np.zeros(w * step, dtype=np.uint8)
    for y in range(h):
        rule, row = int(raw[y, 0]), raw[y, 1:]
        if rule == 0:
            now = row
        elif rule == 1:
            now = np.cumsum(row.reshape(w, step), 0, dtype=np.uint64).astype(np.uint8).ravel()
        elif rule == 2:
            now = row + above
        else:
            now = _unfiltered(rule, row.tolist(), above.tolist(), step)
        out[y] = above = now
    values = out if bits == 8 else out.reshape(h, -1, 2).astype(np.int64) @ np.array([256, 1])
    return values.astype(np.int64).reshape(h, w, bands)


def _unfiltered(rule: int, row: list[int], above: list[int], step: int) -> np.ndarray:
    """A row that was stored as the difference to the mean (3) or to the best (4) of its neighbours."""
    now = [0] * len(row)
    for i, v in enumerate(row):
        left, up, corner = (now[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        if rule == 3:
            guess = (left + up) // 2
        else:
            base = left + up - corner
            guess = min(((abs(base - c), n, c) for n, c in enumerate((left, up, corner))))[2]
        now[i] = (v + guess) & 255
    return np.array(now, dtype=np.uint8)


def encode_png(a: np.ndarray) -> bytes:
    """PNG of one to four bands, 8 bits up to 255, else 16; rows are stored as differences upwards."""
    h, w, bands = a.shape
    kind = {b: k for k, b in PNG_BANDS.items()}[bands]
    bits = 8 if a.max(initial=0) < 256 else 16
    flat = np.ascontiguousarray(a, dtype=np.uint8 if bits == 8 else ">u2").reshape(h, -1).view(np.uint8)
    rows = np.empty((h, flat.shape[1] + 1), dtype=np.uint8)
    rows[:, 0] = 2
    rows[:, 1:] = flat
    rows[1:, 1:] -= flat[:-1]
    part = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, bands, rows): an image a row, its pixel rows as arrays of band-interleaved values."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["content"]):
                a = decode_png(b) if bytes(b[:8]) == PNG else decode_pnm(b)
                yield pd.DataFrame({"path": [p], "width": [a.shape[1]], "height": [a.shape[0]], "bands": [a.shape[2]], "rows": [a.reshape(a.shape[0], -1).tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, width int, height int, bands int, rows array<array<long>>")


def to_pixels(images: DataFrame) -> DataFrame:
    """(path, x, y, band, v) of images."""
    from pyspark.sql import functions as F

    r = images.select("path", "bands", F.posexplode("rows").alias("y", "r")).select("path", "bands", "y", F.posexplode("r").alias("i", "v"))
    return r.select("path", F.floor(F.col("i") / F.col("bands")).cast("int").alias("x"), "y", (F.col("i") % F.col("bands")).alias("band"), "v")


def write_images(pixels: DataFrame, folder: str, value: str = "v", kind: str = "pgm") -> DataFrame:
    """(image_id, bytes): writes <folder>/<image_id>.<kind> (pgm or png) for each image from the executors, which must
    share the folder (a path or an address, see tabular.writer). Lazy: an action on the result writes."""

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1, 1), dtype=np.int64)
        a[pdf["y"], pdf["x"], 0] = pdf[value]
        size = writer(folder)(f"{pdf['image_id'].iloc[0]}.{kind}", (encode_png if kind == "png" else encode_pnm)(a))
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "bytes": [size]})

    return pixels.groupBy("image_id").applyInPandas(save, "image_id long, bytes long")
