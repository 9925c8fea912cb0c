"""Position weights, disjoint position samples, probabilistic sequences, unpacking and reservoirs."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import rng


def position_weight(best_q: Column, orig_q: Column, kld: Column, q_weight: float | None = None, pol_scale: float | None = None, alpha: float = 1.0, beta: float = 0.0, gamma: float = 1.0, tau: float = 1.0, default: float = 1.0) -> Column:
    """How much a position counts by the search's correction of the first guess; default without parameters or a guess.

    min(pow(((q_weight * |best_q - orig_q| + kld) / (q_weight + pol_scale)) * alpha + beta, gamma), tau); a power that
    is no number stays none.
    """
    if q_weight is None and pol_scale is None:
        return F.lit(default)
    qw, ps = 0.0 if q_weight is None else q_weight, 1.0 if pol_scale is None else pol_scale
    raised = F.pow((F.lit(qw) * F.abs(best_q - orig_q) + kld) / F.lit(qw + ps) * F.lit(alpha) + F.lit(beta), F.lit(gamma))
    return F.when(F.isnan(orig_q) | orig_q.isNull(), F.lit(default)).otherwise(F.when(F.isnan(raised), raised).otherwise(F.least(raised, F.lit(tau))))


def diff_focus(version: Column, orig_q: Column, best_q: Column, kld: Column, u: Column, least: float, slope: float, q_weight: float, pol_scale: float) -> Column:
    """Whether a record is kept by the older rule: those with a guess and kld above 0 by chance least + slope * difference."""
    total = (F.lit(q_weight) * F.abs(best_q - orig_q) + F.lit(pol_scale) * kld) / F.lit(q_weight + pol_scale)
    chance = F.lit(least) + F.lit(slope) * total
    applies = (version >= 6) & ~F.isnan(orig_q) & (kld > 0)
    return ~(applies & (chance < 1) & (u > chance))


def normalised(df: DataFrame, weight: str, chunk: str) -> DataFrame:
    """df with probability: the weight over the chunk's greatest, or one where that isn't positive."""
    most = F.max(weight).over(Window.partitionBy(chunk))
    return df.withColumn("probability", F.when(most <= 0, F.lit(1.0)).otherwise(F.col(weight) / most))


def position_uses(draw: Callable[[Column], Column], rate: float, uses: Column) -> Column:
    """The uses, under the given number, at which a position is sampled at this rate: an array, in order.

    Each share of length rate on an endless line belongs to a use. On every unit of the line the position falls on one
    place, line + draw(line), and is sampled at that place's use. A share that reaches over the end of a unit meets the
    position twice if it falls there on both sides; whoever was met at the end of a unit is left out of the next.
    """

    def step(acc: Column, line: Column) -> Column:
        use, last = F.floor((line + draw(line)) / F.lit(rate)), F.floor((line + F.lit(1)) / F.lit(rate))
        found = F.when(~acc["out"] & (use < uses), F.concat(acc["found"], F.array(use))).otherwise(acc["found"])
        out = ~acc["out"] & (use == last) & (last * F.lit(rate) < line + F.lit(1))
        return F.struct(found.alias("found"), out.alias("out"))

    start = F.struct(F.array().cast("array<bigint>").alias("found"), F.lit(False).alias("out"))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.floor(uses * F.lit(rate))), start, step, lambda acc: acc["found"])


def sampled_at(draw: Callable[[Column], Column], rate: float, use: Column) -> Column:
    """Whether position_uses has this use."""
    return F.array_contains(position_uses(draw, rate, use.cast("bigint") + F.lit(1)), use.cast("bigint"))


def sampled_positions(chunks: DataFrame, rate: float, uses: int, seed: str, chunk: str = "global_index", n: str = "n") -> DataFrame:
    """(chunk, frame_idx, use_count) of all samples in the first uses of chunks of n frames."""
    frames = chunks.where(F.col(n) > 0).select(chunk, F.explode(F.sequence(F.lit(0), (F.col(n) - F.lit(1)).cast("int"))).alias("frame_idx"))
    at = position_uses(lambda line: rng.uniform(seed, F.col(chunk), line, F.col("frame_idx")), rate, F.lit(uses).cast("bigint"))
    return frames.select(chunk, "frame_idx", F.explode(at).alias("use_count"))


def probabilistic_sequence(df: DataFrame, chunk: str, frame: str, probability: str, take: int, skip: Column, seed: str, uses: str | None = None) -> DataFrame:
    """Frames skip .. skip + take - 1 of each chunk's endless sequence: permutations one after another, thinned by probability.

    Adds block, the number of the permutation, and place in the sequence. With uses, a chunk's rows of each value of that
    column are taken apart; they share the chunk's sequence. A group is one chunk's frames; its permutations are made one
    by one until the last place is filled. A chunk in which no probability is positive gives nothing.
    """
    keyed, by = df.withColumn("_skip", skip.cast("bigint")), [chunk, *([uses] if uses else [])]
    schema = T.StructType([*df.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        name, p = key[0].as_py(), table[probability].to_numpy(zero_copy_only=False)
        frames, first = table[frame].to_pylist(), table["_skip"][0].as_py()
        rows, blocks, places = [], [], []
        block = done = 0
        while done < first + take and np.nanmax(p, initial=0.0) > 0:
            own = [i for i, f in enumerate(frames) if rng.number(seed, "accept", name, block, f) < p[i]]
            own.sort(key=lambda i: (rng.number(seed, "order", name, block, frames[i]), frames[i]))
            for i in own[max(0, first - done) : max(0, first + take - done)]:
                rows.append(i)
                blocks.append(block)
            done, block = done + len(own), block + 1
        places = range(first, first + len(rows))
        out = table.drop_columns(["_skip"]).take(pa.array(rows, pa.int64()))
        return out.append_column("block", pa.array(blocks, pa.int32())).append_column("place", pa.array(places, pa.int32()))

    return keyed.groupBy(*by).applyInArrow(one, schema)


def unpack(frames: DataFrame, seed: str, rate: float | None = None, count: int | None = None, prefetch: int = 0, weights: dict | None = None, chunk: str = "global_index") -> DataFrame:
    """(chunk, use_count, frame_idx, place) of the frames that each use of a chunk emits.

    With a rate, those sampled at the use, place null. With a count, count + prefetch frames of the chunk's sequence after
    the count of each use before, thinned by position_weight(**weights) over the chunk's greatest where weights are given.
    """
    if (rate is None) == (count is None):
        raise ValueError("exactly one of rate and count is needed")
    if rate is not None and not 0 < rate <= 1:
        raise ValueError("rate must be over 0 and at most 1")
    if count is not None and count < 1:
        raise ValueError("count must be positive")
    if rate is not None:
        draw = lambda line: rng.uniform(seed, F.col(chunk), line, F.col("frame_idx"))
        return frames.where(sampled_at(draw, rate, F.col("use_count"))).select(chunk, "use_count", "frame_idx", F.lit(None).cast("int").alias("place"))
    slim = frames.select(chunk, "use_count", "frame_idx", (position_weight(F.col("best_q"), F.col("orig_q"), F.col("policy_kld"), **weights) if weights else F.lit(1.0)).cast("double").alias("_weight"))
    slim = normalised(slim, "_weight", chunk) if weights else slim.withColumnRenamed("_weight", "probability")
    taken = probabilistic_sequence(slim, chunk, "frame_idx", "probability", count + prefetch, F.col("use_count") * count, seed, "use_count")
    return taken.select(chunk, "use_count", "frame_idx", "place")


def prefetched(unpacked: DataFrame, count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(frames that a use emits itself, frames that it offers for the uses to come, with next_use) of unpack's rows."""
    first = F.col("place") < F.col("use_count") * count + count
    return unpacked.where(first), unpacked.where(~first).withColumn("next_use", F.col("use_count") + F.lit(1))


def reservoir_shuffle(df: DataFrame, size: int, seed: int, drain: bool = False) -> DataFrame:
    """Each partition through a reservoir: filled first, then a random slot leaves for each row that comes.

    A partition of n rows emits max(0, n - size + 1); with drain, the rest follow shuffled, so that no row is lost. Slots
    are numbers of rows in the batches that came; once the batches hold twice the reservoir's rows, those in it are copied
    out and the batches are let go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = random.Random(f"{seed}:{TaskContext.get().partitionId()}")
        parts: list[pa.Table] = []
        slots: list[int] = []

        def picked(rows: list[int]) -> pa.Table:
            starts = np.cumsum([0, *map(len, parts)])
            at = np.asarray(rows, np.int64)
            part = np.searchsorted(starts, at, "right") - 1
            order = np.argsort(part, kind="stable")
            found = pa.concat_tables([parts[k].take(pa.array(at[part == k] - starts[k])) for k in np.unique(part)])
            return found.combine_chunks().take(pa.array(np.argsort(order)))

        for batch in batches:
            before = sum(map(len, parts))
            parts.append(pa.Table.from_batches([batch]))
            leave = []
            for row in range(before, before + batch.num_rows):
                if len(slots) < size - 1:
                    slots.append(row)
                    continue
                at = draw.randrange(size)  # the last slot is the row itself
                leave.append(slots[at] if at < size - 1 else row)
                if at < size - 1:
                    slots[at] = row
            if leave:
                yield from picked(leave).to_batches()
            if before + batch.num_rows > 2 * size + batch.num_rows:
                parts[:], slots[:] = ([picked(slots).combine_chunks()], range(len(slots))) if slots else ([], [])
        if drain and slots:
            draw.shuffle(slots)
            yield from picked(slots).to_batches()

    return df.mapInArrow(run, df.schema)
