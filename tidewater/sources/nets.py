"""Nets as files: tables of layers whose values are coded in sixteen bits, column by column.

A net is (path, shape, values), values row by row. The files are Parquet tables of our own layout, as the schema of the
network files elsewhere is not public; codecs and order of values are those files'.
"""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import codecs, text

ENCODINGS = ("LINEAR16", "FLOAT16", "BFLOAT16")


def lists(values: np.ndarray, like: pa.ListArray, kind: pa.DataType) -> pa.ListArray:
    """values cut as a list array without gaps is."""
    lengths = like.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(values, kind), mask=like.is_null())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def half_codes(values: pa.Array) -> pa.Array:
    return lists(values.flatten().to_numpy().astype(np.float16).view(np.uint16).astype(np.int32), values, pa.int32())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def of_half(codes: pa.Array) -> pa.Array:
    return lists(codes.flatten().to_numpy().astype(np.uint16).view(np.float16).astype(np.float64), codes, pa.float64())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def brain_codes(values: pa.Array) -> pa.Array:
    return lists((values.flatten().to_numpy().astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.int32), values, pa.int32())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def of_brain(codes: pa.Array) -> pa.Array:
    return lists((codes.flatten().to_numpy().astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64), codes, pa.float64())


def turned(values: Column, rows: Column, columns: Column) -> Column:
    """A rows by columns matrix's values column by column; the same with both swapped turns it back."""
    places = F.sequence(F.lit(0), F.size(values) - F.lit(1))
    return F.when(F.size(values) > 0, F.transform(places, lambda i: F.get(values, (i % rows * columns + F.floor(i / rows)).cast("int")))).otherwise(values)


def sides() -> tuple[Column, Column]:
    """Rows and columns of a layer: those of a matrix, else one row of all."""
    flat = F.size("shape") != 2
    n = F.greatest(F.size("values"), F.lit(1))
    return F.when(flat, 1).otherwise(F.get("shape", F.lit(0))), F.when(flat, n).otherwise(F.get("shape", F.lit(1)))


def write_net(net: DataFrame, path: str, encoding: str) -> None:
    """A net as (path, shape, encoding, low, high, values) with coded values."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}")
    rows = net.select("path", "shape", F.col("values").cast("array<float>").alias("values"))
    rows = rows.withColumn("values", turned(F.col("values"), *sides()))
    none = F.lit(None).cast("double")
    if encoding == "LINEAR16":
        coded = rows.withColumn("c", codecs.linear16_encode(F.col("values"))).select("path", "shape", F.col("c.low").alias("low"), F.col("c.high").alias("high"), F.col("c.codes").alias("values"))
    else:
        f = half_codes if encoding == "FLOAT16" else brain_codes
        coded = rows.select("path", "shape", none.alias("low"), none.alias("high"), f("values").alias("values"))
    coded.withColumn("encoding", F.lit(encoding)).write.mode("overwrite").parquet(path)


def read_net(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, values) of a net's file, whatever encodings its layers have."""
    rows = spark.read.parquet(path)
    parts = []
    for encoding in ENCODINGS:
        r, c = sides()
        own = rows.where(F.col("encoding") == encoding).withColumn("values", turned(F.col("values"), c, r))
        linear = codecs.linear16_decode(F.struct("low", "high", F.col("values").alias("codes")))
        values = linear if encoding == "LINEAR16" else of_half("values") if encoding == "FLOAT16" else of_brain("values")
        parts.append(own.select("path", "shape", values.alias("values")))
    return parts[0].union(parts[1]).union(parts[2])


def export(net: DataFrame, folder: str, template: str, step: int, at: datetime.datetime, encoding: str = "LINEAR16") -> str:
    """Writes a net under the name that a template gives for a step and a time; gives its path. Sending it on is the caller's."""
    spark = net.sparkSession
    name = spark.range(1).select(text.rendered(template, F.lit(step), F.lit(at).cast("timestamp_ntz"))).first()[0]
    write_net(net, f"{folder}/{name}", encoding)
    return f"{folder}/{name}"
