"""Sharding along a Hilbert curve, in DataFrame functions alone.

Each metadata dimension is quantised to 2**bits cells at its own exact quantiles, found among its distinct values and
their counts. The cells' coordinates become an index on the Hilbert curve, the rows are sorted by it and cut into runs of equal row counts. Neighbours on the curve are
neighbours in every dimension, so a file's minima and maxima prune on each of them.

The sort is a range partitioning over (index, text checksum, id), so equal texts and a hot source spread over many
tasks. The ranges are written once; each task numbers its own rows, and the tasks' counts (one row each) give the
global ranks.

Nulls and edges: a null in a dimension is in the first cell; a null text has size 1, checksum 0; a null id sorts
first; fully equal rows take neighbouring slots in any order; an empty table gives no rows; columns besides those
named are not read. Strings order by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import stored
from tidewater.operators.ordering import prefixed

BITS = 5
SHARDS = 16


@dataclass(frozen=True)
class Dimension:
    """A column to shard by."""

    name: str


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def cut_points(df: DataFrame, name: str, bits: int) -> list:
    """Up to 2**bits - 1 increasing cut points of a column: the values at its exact quantiles, nulls left out."""
    values = stored(df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("rows")), "values")
    total = values.agg(F.sum("rows")).first()[0] or 0
    before = prefixed(values, [F.col(name)], {"before": F.col("rows")})
    reached = lambda n: F.expr(f"(({n}) * {1 << bits} + {total - 1}) div {max(total, 1)}")
    cuts = before.where((F.col("before") > 0) & (reached("before") < reached("before + rows")))
    return [r[name] for r in cuts.select(name, "before").orderBy("before").collect()]  # a row a cell at most


def quantised(value: Column, cuts: list) -> Column:
    """How many cuts are at or below value, none for null, by halving: a depth of log2 comparisons."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("long")
        mid = (low + high) // 2
        return F.when(value >= F.lit(cuts[mid]), between(mid + 1, high)).otherwise(between(low, mid))

    return between(0, len(cuts))


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The index on the Hilbert curve of cell coordinates of that many bits (Skilling 2004), folded over array functions."""
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]) if bits > 1 else None
    x = F.array(*[a.cast("long") for a in axes])

    def unwound(x: Column, s: Column) -> Column:
        at, low = x[s["i"]], s["q"] - F.lit(1)
        swap = x[0].bitwiseXOR(at).bitwiseAND(low)
        inverted = at.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, k: F.when(inverted, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v))

    if steps is not None:
        x = F.aggregate(steps, x, unwound)
    grey = F.aggregate(F.slice(x, 2, n - 1), F.slice(x, 1, 1), lambda got, v: F.concat(got, F.array(F.element_at(got, -1).bitwiseXOR(v)))) if n > 1 else x
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)] or [F.lit(0).cast("long")])
    turned = F.aggregate(masks, F.struct(grey.alias("x"), F.lit(0).cast("long").alias("t")), lambda acc, q: F.struct(acc["x"].alias("x"), F.when(F.element_at(acc["x"], -1).bitwiseAND(q) != 0, acc["t"].bitwiseXOR(q - F.lit(1))).otherwise(acc["t"]).alias("t")), lambda acc: F.transform(acc["x"], lambda v: v.bitwiseXOR(acc["t"])))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    start = F.struct(turned.alias("x"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(places, start, lambda acc, p: F.struct(acc["x"].alias("x"), (acc["h"] * 2).bitwiseOR(F.getbit(acc["x"][p["i"]], p["b"]).cast("long")).alias("h")), lambda acc: acc["h"])


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with rank (from 0, in order) and total: range partitions are written once, numbered apart and shifted by the counts before them."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), *order)
    placed = stored(ranges.withColumn("range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    bases = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    numbered = placed.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy(*order)) - F.lit(1))
    return numbered.join(F.broadcast(bases), "range").withColumn("rank", F.col("rank") + F.col("base")).drop("range", "base")


def hilbert_shards(df: DataFrame, dimensions: list[Dimension], shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, curve, law, shard, slot, grown_shard): law ``rows``, so the shards' counts are at most one apart."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    names = [f"d{i}" for i in range(len(dimensions))]
    values = [F.col(d.name).cast("double" if is_number(df, d.name) else "string").alias(n) for d, n in zip(dimensions, names, strict=True)]
    slim = df.select(*values, F.col(id_col).alias("doc_id"), (F.length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    cuts = {n: cut_points(slim.select(n), n, bits) for n in names}
    cells = slim.select("doc_id", "size", "text_crc32", *[quantised(F.col(n), cuts[n]).alias(n) for n in names])
    curve = cells.select("doc_id", "size", "text_crc32", hilbert_index([F.col(n) for n in names], bits).alias("curve"))
    at = ranked(stored(curve, "curve"), ["curve", "text_crc32", "doc_id", "size"])  # texts are read once
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_runs(df: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """df as one folder a shard, each sorted along the curve; ids must be unique and not null."""
    placed = df.join(shards.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
