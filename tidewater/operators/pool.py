"""The chunk pool: prefix sums and the newest window over sources, look-up of chunks, epoch orders and acceptance."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import rng
from tidewater.operators.ordering import prefixed, shuffled
from tidewater.storage import stored


def start_indices(sources: DataFrame, key: str = "sort_key", count: str = "chunk_count") -> DataFrame:
    """sources with start_chunk_index: chunks of all older sources."""
    return prefixed(sources, [F.col(key)], {"start_chunk_index": F.col(count)}).drop("row_number")


def newest_window(sources: DataFrame, pool_size: int, key: str = "sort_key", count: str = "chunk_count") -> DataFrame:
    """The newest sources whose newer ones hold fewer than pool_size chunks, with newer_chunks. The crossing source is whole."""
    return prefixed(sources, [F.col(key)], {"newer_chunks": F.col(count)}, descending=True).where(F.col("newer_chunks") < pool_size).drop("row_number")


def evicted(sources: DataFrame, pool_size: int, key: str = "sort_key", count: str = "chunk_count") -> DataFrame:
    """sources with evicted: dropped oldest first while the rest hold pool_size; the newest always stays."""
    newer = prefixed(sources, [F.col(key)], {"newer_chunks": F.col(count)}, descending=True)
    return newer.withColumn("evicted", (F.col("newer_chunks") >= pool_size) & (F.col("row_number") > 1)).drop("row_number")


def bounds(total: Column, pool_size: int) -> Column:
    """The least global index of the window."""
    return F.greatest(F.lit(0), total - F.lit(pool_size))


def range_lookup(indices: DataFrame, sources: DataFrame, index: str = "global_index", start: str = "start_chunk_index", count: str = "chunk_count") -> DataFrame:
    """Each index with the source whose range holds it, and index_within_sort_key; indices that no source holds go.

    Starts and indices are ordered together, range partition by range partition; the last start is carried on, over the
    partitions' ends as well (a row each). Sources are neither exploded nor paired with anything.
    """
    spark, key, own = indices.sparkSession, F.struct(*sources.columns), F.struct(*indices.columns)
    starts = sources.where(F.col(count) > 0).select(F.col(start).alias("_pos"), F.lit(0).alias("_kind"), key.alias("_source"), F.lit(None).cast(T.StructType(indices.schema.fields)).alias("_own"))
    asked = indices.where(F.col(index).isNotNull()).select(F.col(index).alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast(T.StructType(sources.schema.fields)).alias("_source"), own.alias("_own"))
    dealt = starts.unionByName(asked).repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_pos", "_kind")
    placed = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    held = {r["_range"]: r["s"] for r in placed.where("_kind = 0").groupBy("_range").agg(F.max_by("_source", "_pos").alias("s")).collect()}  # a row a range
    last, bases = None, []
    for k in range(max(held, default=-1) + 2):
        bases.append((k, last))
        last = held.get(k, last)
    carried = spark.createDataFrame(bases, T.StructType([T.StructField("_first", T.IntegerType()), T.StructField("_carried", T.StructType(sources.schema.fields))]))
    most = len(bases) - 1
    before = Window.partitionBy("_range").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.withColumn("_met", F.last("_source", ignorenulls=True).over(before)).where("_kind = 1")
    found = found.withColumn("_first", F.least(F.col("_range"), F.lit(most))).join(F.broadcast(carried), "_first")
    found = found.select("_own.*", F.coalesce("_met", "_carried").alias("_met")).where(F.col("_met").isNotNull())
    found = found.select(*indices.columns, *[F.col("_met").getField(c).alias(c) for c in sources.columns])
    return found.where(F.col(index) < F.col(start) + F.col(count)).withColumn("index_within_sort_key", F.col(index) - F.col(start))


def epoch_order(df: DataFrame, seed: str, epoch: int | Column, index: str = "global_index") -> DataFrame:
    """df with position: a permutation of its rows for each epoch, without repeats inside one."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return shuffled(df, rng.uniform(seed, e, F.col(index)), [F.col(index)], "position")


def epochs(df: DataFrame, n: int, seed: str, index: str = "global_index") -> DataFrame:
    """df n times over with epoch and position: each epoch an order of its own."""
    many = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return shuffled(many, rng.uniform(seed, F.col("epoch"), F.col(index)), [F.col(index)], "position", F.col("epoch"))


def cache_plan(uses: DataFrame, cache_size: int, pool_size: int, offered: int, theta: float = 0.99) -> DataFrame:
    """(global_index, use_count, status, newly_cached, dropped) of (global_index, use_count, position, probability) rows.

    A use takes a cached position (hit) or the chunk (miss). A miss offers so many positions for the chunk's next uses, of
    which probability * cache_size / pool_size over the running average of probabilities are cached, the fraction carried
    on to the next miss. One task folds over the uses in the order of position: those of one pool over its epochs, two
    numbers each, are a bound that the spec sets.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("position").select(["global_index", "use_count", "probability"])
        held: dict[int, int] = {}
        average, carried, out = 1.0, 0.0, []
        for index, _, p in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if held.get(index):
                held[index] -= 1
                out.append(("hit", 0, 0))
                continue
            average = average * (1 - theta) + p * theta
            exact = (p * cache_size / pool_size / average if average else 0.0) + carried
            carried = exact - int(exact)
            held[index] = min(int(exact), offered)
            out.append(("miss", held[index], max(0, offered - int(exact))))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.table([rows["global_index"], rows["use_count"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["global_index", "use_count", "status", "newly_cached", "dropped"])

    kinds = {f.name: f.dataType.simpleString() for f in uses.schema.fields}
    schema = f"global_index {kinds['global_index']}, use_count {kinds['use_count']}, status string, newly_cached bigint, dropped bigint"
    slim = uses.select("global_index", "use_count", "position", "probability", F.lit(0).alias("pool"))
    return slim.groupBy("pool").applyInArrow(run, schema)


def use_counts(emitted: DataFrame, chunk: str, sequence: str) -> DataFrame:
    """emitted with use_count: how often the chunk was emitted before."""
    return emitted.withColumn("use_count", F.row_number().over(Window.partitionBy(chunk).orderBy(sequence)) - F.lit(1))


def acceptance(weight: Column, max_weight: Column, gamma: float) -> Column:
    """The probability of accepting a chunk; one where no weight is positive."""
    return F.when(max_weight <= 0, F.lit(1.0)).otherwise(F.pow(weight / max_weight, F.lit(gamma)))


def accepted(weights: DataFrame, gamma: float, seed: str, weight: str = "weight", chunk: str | list[str] = "chunk", most_of: DataFrame | None = None) -> DataFrame:
    """weights with probability and accepted: u < (weight / greatest weight) ** gamma, u drawn by the chunk's columns.

    The greatest is over all rows (of most_of, if given), not those seen so far.
    """
    most = (weights if most_of is None else most_of).agg(F.max(weight).alias("max_weight"))
    keys = [chunk] if isinstance(chunk, str) else chunk
    found = weights.crossJoin(F.broadcast(most)).withColumn("probability", acceptance(F.col(weight), F.col("max_weight"), gamma))  # most is one row
    return found.withColumn("accepted", rng.uniform(seed, *[F.col(c) for c in keys]) < F.col("probability"))


def matched_requests(requests: DataFrame, uses: DataFrame, chunk: str = "global_index") -> DataFrame:
    """Requests with status: matched if next_use is the chunk's use_count, mismatched if not, not_found without the chunk."""
    state = uses.select(chunk, F.col("use_count").alias("_uses"))
    status = F.when(F.col("_uses").isNull(), "not_found").when(F.col("_uses") == F.col("next_use"), "matched").otherwise("mismatched")
    return requests.join(state, chunk, "left").withColumn("status", status).drop("_uses")


def since_anchor(sources: DataFrame, anchor: str, key: str = "sort_key", count: str = "chunk_count") -> DataFrame:
    """One row: chunks of sources strictly newer than the anchor."""
    return sources.where(F.col(key) > anchor).agg(F.coalesce(F.sum(count), F.lit(0)).alias("chunks_since_anchor"), F.count("*").alias("sources"))


def without_dropped(chunks: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks not on the list of unreadable ones."""
    return chunks.join(dropped.select(*keys).distinct(), keys, "left_anti")
