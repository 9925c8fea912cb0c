"""Random numbers as functions of a seed and keys, equal in every engine that has md5, and on every retry of a task."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What stands for a null key.
NULL = "<null>"


def digits(n: int, *keys: Column | str | int) -> Column:
    """The first n hex digits of the md5 of the keys joined by #, as a long; a null key counts as a sign of its own."""
    parts = [F.coalesce(k.cast("string"), F.lit(NULL)) if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, n), 16, 10).cast("bigint")


def uniform(*keys: Column | str | int) -> Column:
    """A double in [0, 1) with 52 random bits."""
    return digits(13, *keys) / F.lit(float(1 << 52))


def below(n: int, *keys: Column | str | int) -> Column:
    """A long in [0, n)."""
    return digits(15, *keys) % F.lit(n)


def sql_uniform(*keys: str) -> str:
    """uniform() as DuckDB SQL; keys are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('#', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0)"


def sql_below(n: int, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('#', {', '.join(keys)})), 1, 15))::BIGINT % {n})"


def number(*keys: str | int) -> float:
    """uniform() of plain values."""
    return int(hashlib.md5("#".join(map(str, keys)).encode()).hexdigest()[:13], 16) / (1 << 52)
