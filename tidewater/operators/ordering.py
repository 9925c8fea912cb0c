"""Row numbers and prefix sums over a whole table's order, without a task that sees the whole table.

By columns: the table is dealt to range partitions, written once, and numbered partition by partition; the partitions'
totals (a row each) shift them. By a random number: its leading part names the bucket, so no range has to be sampled
and nothing is written. As rows come: their numbers are made where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.storage import stored


def prefixed(df: DataFrame, order: list[Column], sums: dict[str, Column], number: str = "row_number", descending: bool = False) -> DataFrame:
    """df with a row number from 1 and, for each of sums, the sum over all rows before. order should tell rows apart."""
    spark = df.sparkSession
    keys = [f"_order{i}" for i in range(len(order))]
    vals = [f"_value{i}" for i in range(len(sums))]
    by = [F.col(k).desc() if descending else F.col(k) for k in keys]
    rows = df.select("*", *[c.alias(k) for k, c in zip(keys, order, strict=True)], *[c.alias(v) for v, c in zip(vals, sums.values(), strict=True)])
    dealt = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
    placed = stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(v).alias(v) for v in vals]).orderBy("_range").collect()
    bases, row = [], [0] * (1 + len(vals))
    for t in totals:  # a row a partition
        bases.append((t["_range"], *row))
        row = [row[0] + t["_rows"], *(a + (t[v] or 0) for a, v in zip(row[1:], vals, strict=True))]
    kinds = dict(placed.dtypes)
    kind = {v: "double" if kinds[v] in ("double", "float") else "bigint" for v in vals}
    bases = [(k, n, *(float(x) if kind[v] == "double" else x for v, x in zip(vals, rest, strict=True))) for k, n, *rest in bases]
    base = spark.createDataFrame(bases, ", ".join(["_range int", "_base bigint", *(f"_b{v} {kind[v]}" for v in vals)]))
    w = Window.partitionBy("_range").orderBy(*by)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn(number, F.row_number().over(w))
    for v, name in zip(vals, sums, strict=True):
        found = found.withColumn(name, F.coalesce(F.sum(v).over(before), F.lit(0)))
    found = found.join(F.broadcast(base), "_range").withColumn(number, F.col(number) + F.col("_base"))
    for v, name in zip(vals, sums, strict=True):
        found = found.withColumn(name, F.col(name) + F.col(f"_b{v}"))
    return found.select(*df.columns, number, *sums)


def numbered(df: DataFrame, order: list[Column], number: str = "row_number") -> DataFrame:
    return prefixed(df, order, {}, number)


def shifted(found: DataFrame, totals: DataFrame, part: str, number: str) -> DataFrame:
    """found with number raised by the rows of all lesser parts; totals is (part, n), a row a part."""
    bases, base = [], 0
    for r in totals.orderBy(part).collect():
        bases.append((r[part], base))
        base += r["n"]
    side = found.sparkSession.createDataFrame(bases, f"{part} bigint, _base bigint")
    return found.join(F.broadcast(side), part).withColumn(number, F.col(number) + F.col("_base")).drop(part, "_base")


def shuffled(df: DataFrame, draw: Column, ties: list[Column], number: str, group: Column | None = None, buckets: int | None = None) -> DataFrame:
    """df with a row number from 1 in the order of group (a whole number), draw (in [0, 1)) and ties."""
    n = buckets or 4 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.floor(draw * n) if group is None else group.cast("bigint") * n + F.floor(draw * n)
    rows = df.select("*", draw.alias("_draw"), at.cast("bigint").alias("_bucket"))
    totals = rows.groupBy("_bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("_bucket").orderBy("_draw", *ties)
    found = rows.withColumn(number, F.row_number().over(order).cast("bigint"))
    return shifted(found, totals, "_bucket", number).drop("_draw")


def arrivals(df: DataFrame, number: str = "row_number") -> DataFrame:
    """df, written as it comes, with a row number from 1: by partition and by place in it, whatever the rows hold."""
    placed = stored(df.withColumn("_at", F.monotonically_increasing_id()), "arrivals")
    rows = placed.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    found = rows.withColumn(number, F.col("_place") + F.lit(1))
    return shifted(found, rows.groupBy("_part").agg(F.count("*").alias("n")), "_part", number).drop("_at", "_place")
