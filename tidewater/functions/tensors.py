"""Planes, flags, value matrices and other parts of a frame, as array expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Planes of history, of the board in all, and the divisor of the move counter.
HISTORY_PLANES, PLANES, RULE50 = 104, 112, 99.0
#: Bits of invariance_info, from bit 0, as the training format documents them.
INVARIANCE_FLAGS = ("flip", "mirror", "transpose", "best_move_proven", "max_length_exceeded", "adjudicated", "rescorer_deleted", "side_to_move")
#: Rows of the value matrix, and the frame's fields for their q, d and moves left.
VALUE_ROWS = (("result_q", "result_d", "plies_left"), ("best_q", "best_d", "best_m"), ("played_q", "played_d", "played_m"), ("orig_q", "orig_d", "orig_m"), ("root_q", "root_d", "root_m"), ("q_st", "d_st", None))
#: Input formats whose move counter is divided by 100, and those with an armageddon plane.
RULE50_100_FORMATS, ARMAGEDDON_FORMATS = (4, 5, 132, 133), (132, 133)


def squares(words: pa.Array) -> pa.Array:
    """64 floats for each 64-bit word: its bytes from the lowest, each from its highest bit."""
    plain = words.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    return pa.array(np.unpackbits(plain.view(np.uint8)).astype(np.float32))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def bits(plane: pa.Array) -> pa.Array:
    """64 floats: square s is bit s XOR 7 of the plane."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * len(plane) + 1, 64, dtype=np.int32)), squares(plane), mask=plane.is_null())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def history(planes: pa.Array) -> pa.Array:
    """bits() of all planes of an array, one after another."""
    ends = np.cumsum([0, *planes.value_lengths().fill_null(0).to_pylist()], dtype=np.int32) * 64
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), squares(planes.flatten()), mask=planes.is_null())


def filled(value: Column) -> Column:
    return F.array_repeat(value.cast("float"), 64)


def meta_planes(us_ooo: Column, us_oo: Column, them_ooo: Column, them_oo: Column, side: Column, rule50: Column) -> Column:
    """Eight planes: castling rights, side to move, move counter, zeros, ones."""
    values = [us_ooo, us_oo, them_ooo, them_oo, side, rule50 / F.lit(RULE50), F.lit(0), F.lit(1)]
    return F.concat(*[filled(v) for v in values])


def input_planes(planes: Column, *meta: Column) -> Column:
    """All 112 planes of a frame as 7168 floats."""
    return F.concat(history(F.slice(planes, 1, HISTORY_PLANES)), meta_planes(*meta))


def byte_row(value: Column) -> Column:
    """A plane whose first row is a byte's bits, lowest first, and the rest zeros."""
    low = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(value.cast("bigint"), i).cast("float"))
    return F.concat(low, F.array_repeat(F.lit(0.0).cast("float"), 56))


def format_planes(input_format: Column, us_ooo: Column, us_oo: Column, them_ooo: Column, them_oo: Column, side: Column, rule50: Column, invariance: Column) -> Column:
    """The eight auxiliary planes as each input format lays them out.

    Format 1: four flat castling planes and the side. 2: queen-side rights of both in two planes of byte rows, one of
    each side's rows, then zeros and the side. Later ones: the same with the en-passant row in place of the side.
    """
    zeros = filled(F.lit(0))
    halves = lambda us, them: F.concat(F.slice(byte_row(us), 1, 8), F.array_repeat(F.lit(0.0).cast("float"), 48), F.slice(byte_row(them), 1, 8))
    rows = F.concat(halves(us_ooo, them_ooo), halves(us_oo, them_oo), zeros, zeros)
    head = F.when(input_format == 1, F.concat(filled(us_ooo), filled(us_oo), filled(them_ooo), filled(them_oo), filled(side))).when(input_format == 2, F.concat(rows, filled(side)))
    ep = F.concat(F.array_repeat(F.lit(0.0).cast("float"), 56), F.slice(byte_row(side), 1, 8))
    head = head.otherwise(F.concat(rows, ep))
    counter = F.when(input_format.isin(*RULE50_100_FORMATS), rule50 / F.lit(100.0)).otherwise(rule50 / F.lit(RULE50))
    armageddon = F.when(input_format.isin(*ARMAGEDDON_FORMATS) & (invariance >= 128), 1).otherwise(0)
    return F.concat(head, filled(counter), filled(armageddon), filled(F.lit(1)))


def invariance_bits(info: Column) -> dict[str, Column]:
    return {name: F.getbit(info.cast("bigint"), F.lit(i)).cast("int") for i, name in enumerate(INVARIANCE_FLAGS)}


def value_matrix(frame) -> Column:
    """18 floats, [q, d, m] of result, best, played, original, root and short-term values; frame(name) gives a field."""
    cells = [frame(n) if n else F.lit(float("nan")) for row in VALUE_ROWS for n in row]
    return F.array(*[c.cast("float") for c in cells])


def wdl(q: Column, d: Column) -> Column:
    return F.array((F.lit(1.0) + q - d) / 2, d, (F.lit(1.0) - q - d) / 2)


def wdl_of_result(result: Column) -> Column:
    """One of win, draw and loss for a result of 1, 0 or -1, as older versions store it."""
    return F.array(*[(result == v).cast("float") for v in (1, 0, -1)])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once; inside a lambda it would be for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(logits: Column) -> Column:
    e = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(e, lambda e: let(total(e), lambda whole: F.transform(e, lambda x: x / whole)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def q_of_logits(logits: Column) -> Column:
    """Win less loss of win, draw, loss logits."""
    return let(softmax(logits), lambda p: p[0] - p[2])


def plies_left(plies: Column, invariance: Column) -> Column:
    """Plies left, or the field that older records kept them in where there are none."""
    return F.when(plies == 0, invariance).otherwise(plies)


def starts_with(planes: Column, constants: list[int]) -> Column:
    """Whether the first planes equal the constants (unsigned)."""
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in constants]
    return F.slice(planes, 1, len(signed)) == F.array(*[F.lit(v).cast("bigint") for v in signed])


def first_match(frames: Column, planes: str, constants: list[int]) -> Column:
    """The index of the first frame of an array whose first planes equal the constants, or null."""
    at = F.array_position(F.transform(frames, lambda f: starts_with(f[planes], constants)), True)
    return F.when(at > 0, at - 1)


def probes(probabilities: Column, indices: list[int]) -> Column:
    return F.array(*[F.get(probabilities, F.lit(i)) for i in indices])


def ascii_board(piece_planes: list[Column], letters: str = "PNBRQKpnbrqk") -> Column:
    """Eight lines of a board from twelve 64-bit planes, first rank last, dots where no piece is. For looking at records."""
    def square(s: int) -> Column:
        return reduce(lambda out, p: F.when(F.getbit(p[0], F.lit(s)) == 1, p[1]).otherwise(out), zip(piece_planes, letters, strict=True), F.lit("."))

    return F.concat_ws("\n", *[F.concat(*[square(8 * r + f) for f in range(8)]) for r in range(7, -1, -1)])


def fen_placement(piece_planes: list[Column]) -> Column:
    """The first field of a position's FEN text from twelve 64-bit planes."""
    rows = F.replace(ascii_board(piece_planes), F.lit("\n"), F.lit("/"))
    for n in range(8, 0, -1):
        rows = F.replace(rows, F.lit("." * n), F.lit(str(n)))
    return rows


def mirrored(move: Column) -> Column:
    """A move's name from the other side."""
    return F.translate(move, "12345678", "87654321")
