"""Unions of streams, merges by key, differences of id sets, alignments and index maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_positions(inputs: list[DataFrame]) -> DataFrame:
    """All inputs' rows, by column name; works on streams too."""
    if not inputs:
        raise ValueError("no input")
    out = inputs[0]
    for x in inputs[1:]:
        out = out.unionByName(x)
    return out


def newest_not_in(a: DataFrame, b: DataFrame, id_: str, window: int) -> DataFrame:
    """The newest ``window`` ids of a that are not in b."""
    return a.select(id_).orderBy(F.col(id_).desc()).limit(window).join(b.select(id_).distinct(), id_, "left_anti")


def rewritten(path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The path a leaf goes to by the first rule (kind, prefix, new prefix) that meets it: move, keep, or ignore (null)."""
    out = None
    for kind, prefix, new in rules:
        met = (path == prefix) | path.startswith(prefix + ".")
        value = F.lit(None).cast("string") if kind == "ignore" else path if kind == "keep" else F.concat(F.lit(new), F.substr(path, F.lit(len(prefix) + 1)))
        out = F.when(met, value) if out is None else out.when(met, value)
    return path if out is None else out.otherwise(path)


def merged_paths(old: DataFrame, new: DataFrame, rules: list[tuple[str, str, str]], path: str = "path", value: str = "value") -> DataFrame:
    """(path, status, value) of the leaves of new filled from old: copied, missing in old (+), or left over from it (-)."""
    moved = old.select(rewritten(F.col(path), rules).alias(path), F.col(value).alias("_old")).where(F.col(path).isNotNull())
    both = moved.join(new.select(path, F.col(value).alias("_new"), F.lit(True).alias("_there")), path, "full")
    status = F.when(F.col("_there").isNull(), "-").when(F.col("_old").isNull(), "+").otherwise("copied")
    return both.select(path, status.alias("status"), F.when(status == "copied", F.col("_old")).otherwise(F.col("_new")).alias("value"))


def aligned(ours: DataFrame, reference: DataFrame, shape: str, size: str, order: str) -> DataFrame:
    """(ours, reference) of outputs paired by shape in order, then what is left of either by size in order."""

    def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(key).orderBy(order))
        left, right = a.withColumn("_n", n), b.withColumn("_n", n)
        return left.select(key, "_n", F.col(order).alias("ours")).join(right.select(key, "_n", F.col(order).alias("reference")), [key, "_n"]).select("ours", "reference")

    first = paired(ours, reference, shape)
    rest = [df.join(first.select(F.col(c).alias(order)), order, "left_anti") for df, c in ((ours, "ours"), (reference, "reference"))]
    return first.union(paired(*rest, size))


def gathered(values: Column, index_map: list[int]) -> Column:
    """Elements of an array at the given places, in their order."""
    return F.transform(F.array(*[F.lit(i) for i in index_map]), lambda i: F.get(values, i))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once."""
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def batches(df: DataFrame, size: int, number: str = "row_number") -> DataFrame:
    """Numbered rows with batch_id and place in it; an incomplete last batch is dropped."""
    batch = F.floor((F.col(number) - F.lit(1)) / size)
    whole = F.floor(F.lit(df.count()) / size)
    return df.withColumn("batch_id", batch).withColumn("place", F.pmod(F.col(number) - F.lit(1), F.lit(size))).where(F.col("batch_id") < whole)


def latest(df: DataFrame, order: str, n: int, allow_less: bool = False) -> DataFrame:
    """The n rows of the greatest order; an error if there are fewer, unless allowed."""
    if not allow_less and df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return df.orderBy(F.col(order).desc()).limit(n)
