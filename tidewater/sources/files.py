"""Checkpoints by step, names of training files, events of files and shuffles of whole chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import rng, text
from tidewater.operators.ordering import numbered


def write_checkpoint(leaves: DataFrame, step: int, path: str) -> None:
    """(path, shape, values) leaves as one step of a checkpoint; a step that is there is written over."""
    leaves.withColumn("step", F.lit(step)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)


def checkpoint_steps(spark: SparkSession, path: str, least: int | None = None, most: int | None = None) -> list[int]:
    """The steps kept, in order, within the bounds; partitions alone are listed."""
    steps = spark.read.parquet(path).select("step").distinct()
    if least is not None:
        steps = steps.where(F.col("step") >= least)
    if most is not None:
        steps = steps.where(F.col("step") <= most)
    return sorted(r["step"] for r in steps.collect())


def read_checkpoint(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    """The leaves of a step, the last by default."""
    step = checkpoint_steps(spark, path)[-1] if step is None else step
    return spark.read.parquet(path).where(F.col("step") == step).drop("step")


def training_names(files: DataFrame, base: int, path: str = "path") -> DataFrame:
    """files with new_name training.<number>.gz, numbered from base in the order of the ids in their names, then of names."""
    rows = files.withColumn("_id", text.file_id(F.col(path)))
    named = numbered(rows, [F.col("_id"), F.col(path)], "_n")
    return named.withColumn("new_name", F.concat(F.lit("training."), (F.col("_n") + F.lit(base - 1)).cast("string"), F.lit(".gz"))).drop("_n", "_id")


def new_events(events: DataFrame, initial: DataFrame, path: str = "path") -> DataFrame:
    """Events of files that the initial scan didn't list, each file once."""
    return events.dropDuplicates([path]).join(initial.select(path).distinct(), path, "left_anti")


def whole_records(size: Column, record: int) -> Column:
    """Whether a file's size is a positive multiple of its record's."""
    return (size > 0) & (size % F.lit(record) == 0)


def shuffled_chunks(frames: DataFrame, seed: str, partitions: int, chunk: list[str], order: str = "frame_idx") -> DataFrame:
    """Frames with whole chunks dealt at random over partitions and in random order within; a chunk's frames stay in order."""
    key = rng.uniform(seed, *[F.col(c) for c in chunk])
    return frames.withColumn("_key", key).repartition(partitions, "_key").sortWithinPartitions("_key", *chunk, order).drop("_key")
