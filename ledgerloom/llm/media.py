"""Media columns: PNG pictures in binary columns, their exact samples, and low-frequency cosine-transform hashes.

encode_png writes 8-bit RGB pictures 64 pixels (192 bytes) wide: each row is filtered with whichever of None, Sub and Up
leaves the least sum of absolute differences, and the rows go through zlib into an IDAT chunk. decode_png checks the
signature and every chunk's CRC-32, inflates, and undoes all five row filters with numpy. features reduce the decoded
picture to a 32 x 32 grey image by area means and hash the signs of its 63 lowest frequencies but the mean around their
median.

A text's payload is its UTF-8 bytes and then spaces up to a positive multiple of 192. Null or empty text: 192 spaces.
Repeated rows and equal texts: equal values. Null doc_id: kept. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHANNELS = 3
ROW = WIDTH * CHANNELS
SIDE = 32
LOW = 8
LEVEL = 6


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b" "), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, "u1").reshape(-1, ROW)
    left = np.zeros_like(rows)
    left[:, CHANNELS:] = rows[:, :-CHANNELS]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    choices = np.stack([rows, rows - left, rows - above])
    cost = np.minimum(choices, 0 - choices).sum(axis=2, dtype="i8")
    best = cost.argmin(axis=0)
    filtered = np.empty((len(rows), ROW + 1), "u1")
    filtered[:, 0] = best
    filtered[:, 1:] = choices[best, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters (0 None, 1 Sub, 2 Up, 3 Average, 4 Paeth) of rows that start with their filter byte."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    for i in np.flatnonzero(kinds).tolist():
        kind, line = int(kinds[i]), out[i]
        above = out[i - 1] if i else np.zeros_like(line)
        if kind == 1:
            np.add.accumulate(line.reshape(-1, step), axis=0, dtype="u1", out=line.reshape(-1, step))
        elif kind == 2:
            line += above
        else:
            up, cells = above.tolist(), line.tolist()
            for x in range(len(cells)):
                a, b, c = (cells[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                cells[x] = (cells[x] + ((a + b) // 2 if kind == 3 else _paeth(a, b, c))) & 255
            out[i] = cells
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit, non-interlaced grey or true-colour PNG; raises on any damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, size = 8, [], None
    while True:
        if at + 12 > len(media):
            raise ValueError("the file ends early")
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(size[3]) if size else None
    if not channels or size[2] != 8 or size[6]:
        raise ValueError("only 8-bit, non-interlaced grey or true-colour pictures")
    width, height = size[0], size[1]
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != height * (width * channels + 1):
        raise ValueError("size of the samples")
    return unfilter(np.frombuffer(raw, "u1").reshape(height, -1), channels).reshape(height, width, channels)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _area_means(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n equal stretches of the first axis, fractions of rows weighted by their share."""
    size = x.shape[0]
    sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype="f8")])
    ends = np.arange(n + 1) * size / n
    whole = np.minimum(ends.astype("i8"), size - 1)
    at = sums[whole] + (ends - whole)[:, None] * x[whole]
    return np.diff(at, axis=0) * n / size


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies exceed their median; the mean itself always gives 0."""
    grey = samples.mean(axis=2)
    small = _area_means(_area_means(grey, SIDE).T, SIDE).T
    low = np.round(_cosines() @ small @ _cosines().T, 6)
    bits = low > np.median(low.ravel()[1:])
    bits[0, 0] = False
    return np.packbits(bits.ravel()).tobytes()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the PNG) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode_png(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Adds payload (bytes read back) digests and phash (binary) to doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, n, png in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples = decode_png(png)
                back = samples.tobytes()
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, phash binary")
