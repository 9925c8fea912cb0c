"""Exponential time windows over metric ticks, in closed form.

After t ticks, bucket i holds the last complete aligned block of 2**i ticks. An aggregate ending now over n ticks covers
the least number of ticks, at least n, that whole buckets can make up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of a tick.
TICK = 2.0**-6


def tick_of(seconds: Column) -> Column:
    """The tick, from 1, that a time after the start falls in."""
    return (F.floor(seconds / TICK) + F.lit(1)).cast("bigint")


def bucket_span(ticks: int, i: int) -> tuple[int, int]:
    """Bucket i's ticks after so many: over the first, up to the second."""
    end = ticks >> i << i
    return (end - (1 << i), end) if end else (0, 0)


def ending_now_ticks(ticks: int, n: int) -> int:
    """How many of the last ticks an aggregate over n of them covers."""
    if n <= 0:
        return 0
    w = n.bit_length()
    m = ticks % (1 << w)
    return m + (1 << w) if m < n and (1 << w) <= ticks else m


def buckets(ticks: DataFrame, now: int, tick: str, aggregates: list[Column]) -> DataFrame:
    """(bucket, first_tick, last_tick, aggregates) of every bucket after ``now`` ticks: each row is in log2(now) + 1 of them at most."""
    spark = ticks.sparkSession
    spans = [(i, lo + 1, hi) for i in range(now.bit_length()) for lo, hi in [bucket_span(now, i)] if hi]
    table = spark.createDataFrame(spans, "bucket int, first_tick bigint, last_tick bigint")  # a row a bucket
    inside = (F.col(tick) >= F.col("first_tick")) & (F.col(tick) <= F.col("last_tick"))
    return ticks.join(F.broadcast(table), inside).groupBy("bucket", "first_tick", "last_tick").agg(*aggregates)


def ending_now(ticks: DataFrame, now: int, n: int, tick: str, aggregates: list[Column], pending: DataFrame | None = None) -> DataFrame:
    """One row: the aggregates over the last ticks that cover n, with the pending rows if given."""
    last = ticks.where((F.col(tick) > now - ending_now_ticks(now, n)) & (F.col(tick) <= now))
    return (last.unionByName(pending) if pending is not None else last).agg(*aggregates)


def blocks(ticks: DataFrame, i: int, tick: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """(block, keys, aggregates): all aligned blocks of 2**i ticks, block = (tick - 1) >> i."""
    return ticks.groupBy(F.shiftright(F.col(tick) - F.lit(1), i).alias("block"), *keys).agg(*aggregates)


@dataclass(frozen=True)
class Monoid:
    """An aggregate of the user's own: an empty state, and a state of an older and a newer one. It need not commute."""

    clear: Callable[[], Any]
    update: Callable[[Any, Any], Any]

    def fold(self, states: list) -> Any:
        out = self.clear()
        for s in states:
            out = self.update(out, s)
        return out


def folded(ticks: DataFrame, tick: str, keys: list[str], state: str, monoid: Monoid, i: int = 12) -> DataFrame:
    """(keys, state): each key's states folded in the order of tick, blocks of 2**i ticks first, so that no task holds a key's rows."""
    kind = ticks.schema[state].dataType
    own = [ticks.schema[k] for k in keys]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = monoid.fold(table.sort_by("_at")[state].to_pylist())
        values = [*(k.as_py() for k in key[: len(keys)]), min(table["_at"].to_pylist()), out]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, [*(table.schema.field(k) for k in keys), table.schema.field("_at"), table.schema.field(state)], strict=True)], [*keys, "_at", state])

    schema = T.StructType([*own, T.StructField("_at", T.LongType()), T.StructField(state, kind)])
    rows = ticks.select(*keys, F.col(tick).cast("bigint").alias("_at"), state, F.shiftright(F.col(tick) - F.lit(1), i).alias("_block"))
    parts = rows.groupBy(*keys, "_block").applyInArrow(run, schema)
    return parts.groupBy(*keys).applyInArrow(run, schema).drop("_at")
