"""Sixteen-bit codecs of weights and arithmetic of nets kept as (path, values) rows."""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.tensors import let

FLAT = 1e-8


def linear16_encode(values: Column) -> Column:
    """(low, high, codes): 65535 steps between the extremes, halves to even; a range under FLAT is coded in the middle."""

    def coded(x: Column) -> Column:
        code = lambda ends: lambda v: F.bround(F.lit(65535.0) * F.when(ends["high"] - ends["low"] < FLAT, 0.5).otherwise((v - ends["low"]) / (ends["high"] - ends["low"]))).cast("int")
        ends = F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high"))
        return let(ends, lambda e: F.struct(e["low"].alias("low"), e["high"].alias("high"), F.transform(x, code(e)).alias("codes")))

    return let(values.cast("array<double>"), coded)


def linear16_decode(coded: Column) -> Column:
    return F.transform(coded["codes"], lambda c: c / F.lit(65535.0) * coded["high"] + (F.lit(1.0) - c / F.lit(65535.0)) * coded["low"])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def float16(values: pd.Series) -> pd.Series:
    """Through IEEE half precision."""
    return values.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bfloat16(values: pd.Series) -> pd.Series:
    """Through bfloat16, the low sixteen bits cut off."""
    return values.map(lambda v: None if v is None else (np.asarray(v, np.float32).view(np.uint32) & np.uint32(0xFFFF0000)).view(np.float32))


def combined(a: DataFrame, b: DataFrame, scale_a: float = 1.0, scale_b: float = 1.0, path: str = "path", values: str = "values") -> DataFrame:
    """scale_a * a + scale_b * b layer by layer; layers of one net alone are an error of the caller and are dropped."""
    both = a.select(path, F.col(values).alias("_a")).join(b.select(path, F.col(values).alias("_b")), path)
    return both.select(path, F.zip_with("_a", "_b", lambda x, y: x * F.lit(scale_a) + y * F.lit(scale_b)).alias(values))


def scaled(net: DataFrame, by: float, values: str = "values") -> DataFrame:
    return net.withColumn(values, F.transform(values, lambda x: x * F.lit(by)))


def grafted(net: DataFrame, donor: DataFrame, prefixes: list[str], path: str = "path", values: str = "values") -> DataFrame:
    """net with the donor's layers under the given prefixes; a layer that the donor lacks stays."""
    chosen = F.lit(False)
    for p in prefixes:
        chosen = chosen | F.col(path).startswith(p)
    return net.join(donor.select(path, F.col(values).alias("_new")), path, "left").withColumn(values, F.when(chosen & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(values))).drop("_new")


class BadScript(ValueError):
    """A script with more in it than arithmetic of nets."""


def script(nets: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """The nets that the lines of a script name, after the last; nothing of it is executed.

    Lines are ``name = expression``, of nets' sums, differences and products or quotients with numbers, or
    ``name["prefix"] = other["prefix"]``, which grafts the layers under a prefix.
    """
    known = dict(nets)

    def net(name: str) -> DataFrame:
        if name not in known:
            raise BadScript(f"no net {name}")
        return known[name]

    def value(node: ast.expr) -> DataFrame | float:
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return float(node.value)
        if isinstance(node, ast.Name):
            return net(node.id)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            found = value(node.operand)
            return -found if isinstance(found, float) else scaled(found, -1.0)
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            plain = isinstance(a, float), isinstance(b, float)
            if isinstance(node.op, ast.Add | ast.Sub) and plain == (False, False):
                return combined(a, b, 1.0, 1.0 if isinstance(node.op, ast.Add) else -1.0)
            if isinstance(node.op, ast.Mult) and any(plain):
                return a * b if all(plain) else scaled(b, a) if plain[0] else scaled(a, b)
            if isinstance(node.op, ast.Div) and plain[1]:
                return a / b if plain[0] else scaled(a, 1.0 / b)
        raise BadScript(f"line {node.lineno} is no arithmetic of nets")

    def place(node: ast.expr) -> tuple[str, str]:
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return node.value.id, node.slice.value
        raise BadScript(f"line {node.lineno} grafts no layers")

    for line in ast.parse(source).body:
        if not isinstance(line, ast.Assign) or len(line.targets) != 1:
            raise BadScript(f"line {line.lineno} is no assignment")
        target = line.targets[0]
        if isinstance(target, ast.Name):
            found = value(line.value)
            if isinstance(found, float):
                raise BadScript(f"line {line.lineno} gives a number")
            known[target.id] = found
        else:
            (name, prefix), (donor, same) = place(target), place(line.value)
            if prefix != same:
                raise BadScript(f"line {line.lineno} grafts {same} as {prefix}")
            known[name] = grafted(net(name), net(donor), [prefix])
    return known


def transposed(values: Column, rows: int, columns: int) -> Column:
    """A row-major rows by columns matrix from its transpose's row-major values."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.get(values, (i % columns) * rows + F.floor(i / columns).cast("int")))
