"""Names of files, numbers in words, templates and nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/?$", 1)


def extension(path: Column) -> Column:
    """The last extension with its dot, empty for none; a leading dot is none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^(.+?)(?:\.[^.]+)?$", 1)


def file_id(path: Column) -> Column:
    """The last number in a file's name before its extension; null without one."""
    found = F.regexp_extract(basename(path), r"(\d+)(?:\.[^.\d]*)?$", 1)
    return F.when(found != "", found.try_cast("bigint"))


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/]")


def number(text: Column) -> Column:
    """A decimal or 0x number as an unsigned 64-bit value in a long; null for anything else."""
    t = F.lower(F.trim(text))
    read = F.when(t.rlike(r"^0x[0-9a-f]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, -10)).when(t.rlike(r"^\d+$"), F.conv(t, 10, -10))
    return read.cast("bigint")


def numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), number)


def tenth(value: Column) -> Column:
    """A number of one or more with a digit after the point as C prints it: by its exact value, ties to even.

    Java rounds the shortest decimal up at ties. The bits behind the point are a whole number here; from 2^63 on, where
    there are none, Java's digits stay.
    """
    whole = F.floor(value)
    tens = F.floor((value - whole.cast("double")) * F.lit(2.0**52)) * 10
    digit, rest = F.shiftright(tens, 52), tens.bitwiseAND(F.lit((1 << 52) - 1))
    half = F.lit(1 << 51)
    digit = digit + F.when((rest > half) | ((rest == half) & (digit % 2 == 1)), 1).otherwise(0)
    own = F.format_string("%d.%d", whole + F.when(digit == 10, 1).otherwise(0), digit % 10)
    return F.when(value < 2.0**63, own).otherwise(F.format_string("%.1f", value))


def si(value: Column) -> Column:
    """A count with k, M or G, three digits or so, rounded as C does; null for null."""
    value = value.cast("double")
    scale = lambda by, unit: F.concat(tenth(value / F.lit(by)), F.lit(unit))
    text = F.when(value >= 1e9, scale(1e9, "G")).when(value >= 1e6, scale(1e6, "M")).when(value >= 1e3, scale(1e3, "k")).otherwise(F.format_string("%.0f", F.rint(value)))
    return F.when(value.isNotNull(), text)


def duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    text = F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
    return F.when(s.isNotNull(), text)


def rendered(template: str, step: Column, time: Column) -> Column:
    """{step:08d}, {step} and {datetime} of a template."""
    out = F.lit(template)
    for mark, value in (("{step:08d}", F.format_string("%08d", step)), ("{step}", step.cast("string")), ("{datetime}", F.date_format(time, "yyyyMMdd-HHmmss"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def flattened(df: DataFrame, struct: str, keep: list[str], separator: str = "/") -> DataFrame:
    """(keep, tag, value): the numbers inside a nested struct by their path; what isn't a number is left out."""
    leaves: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, col: Column, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, col.getField(f.name), f"{path}{separator}{f.name}" if path else f.name)
        elif isinstance(kind, T.NumericType):
            leaves.append((path, col.cast("double")))

    walk(df.schema[struct].dataType, F.col(struct), "")
    pairs = F.array(*[F.struct(F.lit(p).alias("tag"), c.alias("value")) for p, c in leaves])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.tag", "_p.value").where(F.col("value").isNotNull())


def to_json(df: DataFrame) -> DataFrame:
    """Each row as a line of JSON."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
