"""What the training-data operators share: tables, Arrow batches and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.storage import new_path, stored

__all__ = ["bound_batches", "components", "hot_join", "id_remainder", "map_batches", "new_path", "placed", "stored", "table"]

#: Rows of an Arrow batch and bytes it may take, so that very long texts don't meet in one batch.
BATCH_BYTES = 4 << 20
#: Edges, sixteen bytes each, of a graph that one task takes whole, or whose nodes' least neighbours are broadcast once
#: steps have made it so small; a larger graph's are joined by a shuffle.
BROADCAST_EDGES = 500_000
#: A key with one of so many rows is hot: at most so many keys are, and their few rows are broadcast.
HOT_SHARE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that go to Python, unless the session has a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (None, "2147483647b", "2147483647") or int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def placed(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1, ... by place, so that their names may be equal or hold any sign."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def hot_join(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with side, which has one row a key and n, how many of the total rows have it (or more).

    Keys of over total / HOT_SHARE rows, at most HOT_SHARE of them, are broadcast, so their rows stay where they are; the
    others meet in a shuffle. n is dropped.
    """
    least = max(1, total // HOT_SHARE)
    hot, cold = F.broadcast(side.where(F.col("n") > least).drop("n")), side.where(F.col("n") <= least).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) of every end of the edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def whole_graph(edges: DataFrame) -> DataFrame:
    """(a, component) of each end of the edges (a, b), bigints, worked out in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if held:
            node, least = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["a", "component"])

    return map_batches(edges.select("a", "b").coalesce(1), run, "a bigint, component bigint")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over edges (a, b), itself included.

    A graph of up to BROADCAST_EDGES distinct edges of bigints is one task's: steps would cost the driver a hundred
    plans. A larger one takes alternating large-star and small-star steps (Kiveris et al. 2014), each cut by a written
    table. What a step groups is combined before it is shuffled, and what it joins is broadcast up to BROADCAST_EDGES
    edges; beyond, nodes of very many neighbours are (hot_join). Nodes without an edge stay alone. Edges with a null or
    equal ends are ignored; repeated edges count once.
    """

    def met(rows: DataFrame, side: DataFrame, total: int) -> DataFrame:
        return rows.join(F.broadcast(side.drop("n")), "a") if total <= BROADCAST_EDGES else hot_join(rows, side, "a", 2 * total)

    now = edges.where("a is not null and b is not null and a <> b")
    now = stored(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, total = None, now.count()
    alone = total <= BROADCAST_EDGES and {kind for _, kind in now.dtypes} == {"bigint"}
    while not alone:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = met(both.where("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = met(large, low, total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        now, seen, total = after, mark, mark[0]
    found = whole_graph(now) if alone else now.groupBy("a").agg(F.min("b").alias("component"))
    found = F.broadcast(found) if total <= BROADCAST_EDGES else found
    return nodes.join(found, nodes["node"] == found["a"], "left").select("node", F.coalesce("component", "node").alias("component"))
