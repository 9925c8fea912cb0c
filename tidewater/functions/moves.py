"""Moves by rule: the 1858 names in their order, and index maps from planes and square pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES, RANKS = "abcdefgh", "12345678"
#: Clockwise from the north, as (file, rank) steps; knights' jumps in the same order.
QUEEN = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
KNIGHT = ((1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2))
#: Promotions in the order of move names, and in that of planes; a knight is a plain move.
NAMED, PLANED = "qrb", "rbq"
QUEEN_PLANES, KNIGHT_PLANES, PROMOTION_PLANES = 56, 8, 9
PAIRS = 64 * 64


def square(file: int, rank: int) -> str:
    return FILES[file] + RANKS[rank]


def on_board(file: int, rank: int) -> bool:
    return 0 <= file < 8 and 0 <= rank < 8


def targets(file: int, rank: int) -> list[tuple[int, int]]:
    """Squares that a queen or a knight reaches on an empty board, by rank, then file."""
    reached = [(file + n * f, rank + n * r) for f, r in QUEEN for n in range(1, 8)] + [(file + f, rank + r) for f, r in KNIGHT]
    return sorted((t for t in reached if on_board(*t)), key=lambda t: (t[1], t[0]))


def names() -> list[str]:
    """Moves by origin and target, each by rank and file; then promotions by origin, target and piece."""
    plain = [square(f, r) + square(*t) for r in range(8) for f in range(8) for t in targets(f, r)]
    promoted = [square(f, 6) + square(f + d, 7) + p for f in range(8) for d in (-1, 0, 1) if on_board(f + d, 7) for p in NAMED]
    return plain + promoted


def plane_moves() -> list[str | None]:
    """The move of each of 73 planes by 64 squares, plane by plane: queen directions by steps, knights, promotions."""
    steps = [(n * f, n * r) for f, r in QUEEN for n in range(1, 8)] + list(KNIGHT)
    out = [square(f, r) + square(f + df, r + dr) if on_board(f + df, r + dr) else None for df, dr in steps for r in range(8) for f in range(8)]
    for d in (-1, 0, 1):
        out += [square(f, 6) + square(f + d, 7) + p if r == 6 and on_board(f + d, 7) else None for p in PLANED for r in range(8) for f in range(8)]
    return out


def plane_map(spark: SparkSession) -> DataFrame:
    """(plane, square, move_index): which plane and square holds each move's logit."""
    at = {m: i for i, m in enumerate(names())}
    return spark.createDataFrame([(i // 64, i % 64, at[m]) for i, m in enumerate(plane_moves()) if m], "plane int, square int, move_index int")


def pair_index(move: str) -> int:
    """A move's place among square pairs, promotions after them by origin's and target's file and piece."""
    number = lambda s: 8 * RANKS.index(s[1]) + FILES.index(s[0])
    if len(move) == 5:
        return PAIRS + 24 * FILES.index(move[0]) + 3 * FILES.index(move[2]) + NAMED.index(move[4])
    return 64 * number(move[:2]) + number(move[2:])


def pair_map() -> list[int]:
    """Each move's place in pair logits: what joins.gathered takes."""
    return [pair_index(m) for m in names()]


def table(spark: SparkSession) -> DataFrame:
    """(move_index, move)."""
    return spark.createDataFrame(list(enumerate(names())), "move_index int, move string")
