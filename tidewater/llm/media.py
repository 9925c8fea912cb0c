"""Texts as PNG images in a binary column, read back with checksum tests, and low-frequency cosine hashes.

A text's UTF-8 bytes, padded with blanks to a positive multiple of 192, are an image of 64 RGB pixels a row. Writing
filters each row (by Up or Sub where most of the row becomes zero, None otherwise: letters predict no letters) and deflates the rows into IDAT chunks; reading
tests the signature, every chunk's CRC, the sizes and zlib's own checksum, and undoes all five filters. The feature is
a 64-bit hash: mean brightness over a 32 by 32 grid, a two-dimensional cosine transform, and the signs of its 8 by 8
lowest frequencies against their median.

Images live in a table written to the shared folder; features come from what is read from it. Nulls and edges: a null
or empty text is one row of blanks with n_bytes 0; very long texts are images of more rows; repeated rows and ids are
carried as they are; an empty table gives no rows; columns besides the id and the text are not read.
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

from tidewater.llm.common import map_batches, stored

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6
IDAT_BYTES = 1 << 16
GRID, LOW = 32, 8


class BadImage(ValueError):
    """Bytes that are not a whole, sound PNG of the kind written here."""


def payload(text: str | None) -> tuple[int, bytes]:
    """(length of the UTF-8 bytes, those bytes padded to a positive multiple of a row)."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (-len(raw) % ROW or ROW * (not raw))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(data: bytes) -> bytes:
    """A PNG of data, whose length is a positive multiple of a row."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0], out[:, 1:] = 0, rows
    sub, up = rows.copy(), rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up[1:] -= rows[:-1]
    best = np.argmax([np.full(len(rows), ROW // 2), (sub == 0).sum(1), (up == 0).sum(1)], 0)
    for kind, filtered in ((1, sub), (2, up)):
        own = best == kind
        out[own, 0], out[own, 1:] = kind, filtered[own]
    body = zlib.compress(out.tobytes(), LEVEL)
    parts = [SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0))]
    parts += [chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES)]
    return b"".join([*parts, chunk(b"IEND", b"")])


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of each chunk, tested."""
    if png[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise BadImage("chunk cut off")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) != n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise BadImage(f"checksum of {kind!r} at {at}")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            if at != len(png):
                raise BadImage("bytes after the end")
            return
    raise BadImage("no end chunk")


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered lines, each led by its filter's number.

    Sub is a running sum over the row and Up a sum with the row above; runs of Up rows are one running sum. Average and
    Paeth depend on both neighbours and go pixel by pixel, all channels of a pixel at once.
    """
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise BadImage("unknown filter")
    sub = np.flatnonzero(kinds == 1)
    if len(sub):
        pixels = rows[sub].reshape(len(sub), -1, step)
        rows[sub] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(len(sub), -1)
    for y in np.flatnonzero(kinds >= 2):
        above = rows[y - 1] if y else np.zeros(rows.shape[1], np.uint8)
        if kinds[y] == 2:
            rows[y] += above
            continue
        a, c = np.zeros(step, np.int16), np.zeros(step, np.int16)
        for x in range(0, rows.shape[1], step):
            b = above[x : x + step].astype(np.int16)
            if kinds[y] == 3:
                guess = (a + b) // 2
            else:
                pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
            rows[y, x : x + step] += guess.astype(np.uint8)
            a, c = rows[y, x : x + step].astype(np.int16), b
    return rows


def decode(png: bytes) -> np.ndarray:
    """The samples, a row each line; BadImage if any test fails."""
    header, body, ended = None, [], False
    for kind, data in chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
    if header is None or header[2:] != (8, 2, 0, 0, 0) or not ended:
        raise BadImage("not an 8-bit RGB image without interlace")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(raw) != height * (width * CHANNELS + 1):
        raise BadImage("wrong number of samples")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), CHANNELS)


@lru_cache(8)
def cosines(n: int) -> np.ndarray:
    """The LOW lowest rows of the orthonormal cosine transform (type II) of n values."""
    k, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


@lru_cache(128)
def averaging(n: int) -> np.ndarray:
    """GRID by n: the mean over each of GRID equal bands of n lines, edges shared in proportion."""
    edges = np.arange(GRID + 1) * (n / GRID)
    line = np.arange(n)
    over = np.minimum(edges[1:, None], line + 1) - np.maximum(edges[:-1, None], line)
    return np.clip(over, 0, None) * (GRID / n)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits; equal samples, equal digits."""
    gray = samples.reshape(len(samples), WIDTH, CHANNELS).sum(2, dtype=np.uint16).astype(np.float64) / CHANNELS
    across = gray.reshape(len(gray), GRID, WIDTH // GRID).mean(2)
    n = len(gray)
    if n <= 4096:
        grid = averaging(n) @ across
    else:  # whole bands of a very tall image, line counts that differ by one
        bounds = np.arange(GRID + 1) * n // GRID
        grid = np.add.reduceat(across, bounds[:-1], axis=0) / np.diff(bounds)[:, None]
    low = np.round(cosines(GRID) @ grid @ cosines(GRID).T, 6)
    bits = (low > np.median(low)).astype(np.uint8).reshape(-1)
    return np.packbits(bits).tobytes().hex()


def images(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, png): one image a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([encode(x) for _, x in made], pa.binary())], ["doc_id", "n_bytes", "png"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_bytes bigint, png binary")


def features(stored_images: DataFrame) -> DataFrame:
    """Digests of images() rows and of the payloads read out of them, and the cosine hash."""
    kind = stored_images.schema["doc_id"].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for png in batch.column(2).to_pylist():
                samples = decode(png)
                data = samples.tobytes()
                out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return map_batches(stored_images, run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """images(df) written as a table, read back, and its features."""
    return features(stored(images(df, id_col, text_col), "images", compression="none"))
