"""Streams of files, metric windows, the position cache, two-phase starts and status."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators.exponential import TICK


def watched(spark: SparkSession, path: str, schema: Any, files_per_trigger: int = 1000, file_format: str = "parquet") -> DataFrame:
    """Rows of files that come into a folder tree, each file once; files_per_trigger holds back what comes faster."""
    return spark.readStream.schema(schema).format(file_format).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A stream's rows so far through sink, batch by batch, then an end."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def two_phases(initial: DataFrame, stream: DataFrame, sink: Callable[[DataFrame, int, str], None], checkpoint: str, pool_size: int | None = None) -> StreamingQuery:
    """The initial rows first, in one batch; nothing of the stream before. No row at all is an error, too few for the pool are not."""
    n = initial.limit(pool_size or 1).count()
    if not n:
        raise ValueError("the initial scan found no chunk")
    sink(initial, -1, "initial")
    return run_available(stream, lambda df, i: sink(df, i, "new"), checkpoint)


def tumbling(events: DataFrame, time: str, i: int, late: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates over blocks of 2**i ticks of event time; rows later than ``late`` are left out."""
    micros = int(TICK * 1e6) << i
    return events.withWatermark(time, late).groupBy(F.window(time, f"{micros} microseconds"), *keys).agg(*aggregates)


def cache_budget(rate: float, cache_size: int, pool_size: int, average: float, carried: float) -> tuple[int, float]:
    """(positions of a chunk to cache, fraction carried on) for a chunk of this sampling rate."""
    exact = rate * cache_size / pool_size / average + carried
    return int(exact), exact - int(exact)


def smoothed(average: float | None, new: float, theta: float = 0.99) -> float:
    """The average that weighs the new sample by theta."""
    return new if average is None else theta * new + (1 - theta) * average


OUTPUT = "global_index bigint, use_count int, kind string, item string"


def position_cache(requests: DataFrame) -> DataFrame:
    """A stream of (global_index, kind, use_count, items array<string>, capacity int, sequence bigint) through a cache of positions by chunk.

    A row of kind ``fill`` offers items for the chunk's uses from use_count on, of which ``capacity`` are kept if the
    chunk has been used as often (``newly_cached``; else ``mismatched``); one of kind ``use`` takes the next (``hit``
    with the item, or ``miss``). The first ``use`` of a chunk is number 0.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        for rows in batches:
            for r in rows.sort_values("sequence").itertuples():
                if r.kind == "fill":
                    if r.use_count != used:
                        out.append((used, "mismatched", None))
                        continue
                    room = max(0, r.capacity - len(held))
                    held += list(r.items)[:room]
                    out += [(used, "newly_cached", x) for x in list(r.items)[:room]] + [(used, "dropped", x) for x in list(r.items)[room:]]
                else:
                    out.append((used, "hit", held.pop(0)) if held else (used, "miss", None))
                    used += 1
        state.update((used, held))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["global_index", "use_count", "kind", "item"])

    return requests.groupBy("global_index").applyInPandasWithState(step, OUTPUT, "used int, held array<string>", "append", GroupStateTimeout.NoTimeout)


def trimmed(ids: DataFrame, window: int, overhead: float = 0.1, id_: str = "id", part: str = "part") -> DataFrame:
    """Ids of each part over its newest window once it is over by the overhead: those to delete."""
    n = F.row_number().over(Window.partitionBy(part).orderBy(F.col(id_).desc()))
    counted = ids.withColumn("_n", n).withColumn("_all", F.count("*").over(Window.partitionBy(part)))
    return counted.where((F.col("_n") > window) & (F.col("_all") > window * (1 + overhead))).drop("_n", "_all")


class Progress(StreamingQueryListener):
    """Each batch's progress as a line of JSON through emit."""

    def __init__(self, emit: Callable[[str], None]):
        self.emit = emit

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.emit(event.progress.json)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass
