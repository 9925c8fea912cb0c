"""The binary frame: layouts of its versions, decoding to columns and encoding back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

POLICY, HISTORY = 1858, 104
#: Fields in the order of the format's sixth version: name, numpy type, count.
_HEAD = [("version", "<u4", 1), ("input_format", "<u4", 1), ("probabilities", "<f4", POLICY), ("planes", "<u8", HISTORY)]
_BYTES = ["castling_us_ooo", "castling_us_oo", "castling_them_ooo", "castling_them_oo", "side_to_move_or_enpassant", "rule50_count", "invariance_info"]
_FLOATS = ["root_q", "best_q", "root_d", "best_d", "root_m", "best_m", "plies_left", "result_q", "result_d", "played_q", "played_d", "played_m", "orig_q", "orig_d", "orig_m"]
_TAIL = [("visits", "<u4", 1), ("played_idx", "<u2", 1), ("best_idx", "<u2", 1), ("policy_kld", "<f4", 1), ("reserved", "<u4", 1)]
LAYOUT = [*_HEAD, *((b, "u1", 1) for b in _BYTES), ("dep_result", "i1", 1), *((f, "<f4", 1) for f in _FLOATS), *_TAIL]
#: Bytes of a record of each version.
SIZES = {3: 8276, 4: 8292, 5: 8308, 6: 8356}
#: The seventh version's fields after the sixth's; their order is our own, as no public layout fixes it.
ADDED = [("q_st", "<f4", 1), ("d_st", "<f4", 1), ("opp_played_idx", "<u2", 1), ("next_played_idx", "<u2", 1)]


def _dtype(layout: list[tuple[str, str, int]]) -> np.dtype:
    return np.dtype([(n, k) if c == 1 else (n, k, (c,)) for n, k, c in layout])


V6, V7 = _dtype(LAYOUT), _dtype(LAYOUT + ADDED)
SIZES[7] = V7.itemsize
_kinds = {"<u4": (pa.int64(), T.LongType()), "<f4": (pa.float32(), T.FloatType()), "<u8": (pa.int64(), T.LongType()), "u1": (pa.int16(), T.ShortType()), "i1": (pa.int16(), T.ShortType()), "<u2": (pa.int32(), T.IntegerType())}
COLUMNS = [(n, k, c) for n, k, c in LAYOUT + ADDED if n != "reserved"]
FIELDS = [T.StructField(n, T.ArrayType(_kinds[k][1]) if c > 1 else _kinds[k][1]) for n, k, c in COLUMNS]
FRAME = T.StructType(FIELDS)
ARROW = [pa.field(n, pa.list_(_kinds[k][0]) if c > 1 else _kinds[k][0]) for n, k, c in COLUMNS]


class BadFrames(ValueError):
    """Bytes that are no whole number of records of a known version."""


def widened(data: bytes, version: int) -> np.ndarray:
    """Records of any version as the seventh's; fields that the version lacks are zero, and input_format 1 below five."""
    size = SIZES.get(version)
    if not size or not data or len(data) % size:
        raise BadFrames(f"{len(data)} bytes are no records of version {version}")
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    out = np.zeros((len(raw), V7.itemsize), np.uint8)
    if version >= 5:
        out[:, :size] = raw
    else:
        out[:, :4], out[:, 4], out[:, 8 : size + 4] = raw[:, :4], 1, raw[:, 4:]
    return out.reshape(-1).view(V7)


def sniffed(data: bytes) -> int:
    """The version that the first four bytes name."""
    if len(data) < 4:
        raise BadFrames("no version")
    return int.from_bytes(data[:4], "little")


def decode(data: bytes, version: int | str = "auto") -> np.ndarray:
    return widened(data, sniffed(data) if version == "auto" else int(version))


def encode(frames: np.ndarray, version: int = 6) -> bytes:
    """Records of a version; older ones lack the last fields, and below five the input format."""
    if version == 7:
        return frames.astype(V7).tobytes()
    raw = np.ascontiguousarray(frames).view(np.uint8).reshape(len(frames), -1)
    if version >= 5:
        return np.ascontiguousarray(raw[:, : SIZES[version]]).tobytes()
    return np.hstack([raw[:, :4], raw[:, 8 : SIZES[version] + 4]]).tobytes()


def arrays(frames: np.ndarray) -> list[pa.Array]:
    """One Arrow array a column; unsigned 64-bit planes keep their bits in signed longs."""
    out = []
    for (n, k, c), field in zip(COLUMNS, ARROW, strict=True):
        flat = np.ascontiguousarray(frames[n]).reshape(-1)
        flat = flat.view(np.int64) if k == "<u8" else flat
        kind = _kinds[k][0]
        a = pa.array(flat).cast(kind)
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, c * len(frames) + 1, c), pa.int32()), a).cast(field.type) if c > 1 else a)
    return out


def from_rows(rows: list[dict]) -> np.ndarray:
    """Records of rows by column; missing fields are zero."""
    out = np.zeros(len(rows), V7)
    for i, r in enumerate(rows):
        for n, k, _ in COLUMNS:
            if r.get(n) is not None:
                out[n][i] = np.asarray(r[n]).astype(np.int64).view(np.uint64) if k == "<u8" else r[n]
    return out
