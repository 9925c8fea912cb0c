"""Anchors: how many chunks came since a marked source, over a stream of sources, and the loop that waits for them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.storage import folders, removed


@dataclass(frozen=True)
class State:
    """The anchor's key, the newest key seen, the chunks counted and the last batch that was."""

    key: str = ""
    newest: str = ""
    chunks: int = 0
    loaded: bool = False
    batch: int = -1


class Anchor:
    """A state kept as a table of one row under path, so that a restart goes on from it.

    The initial load counts the sources of the window whose key is over the anchor; afterwards every new source counts.
    Each change writes a new version, whole or not at all, before the one before goes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        done = sorted(int(n.partition("=")[2]) for n in folders(spark, path) if folders_done(spark, f"{path}/{n}"))
        self.version = done[-1] if done else 0
        self.state = State(**spark.read.parquet(f"{path}/version={self.version}").first().asDict()) if done else State()

    @property
    def key(self) -> str:
        return self.state.key

    @property
    def newest(self) -> str:
        return self.state.newest

    @property
    def chunks(self) -> int:
        return self.state.chunks

    def keep(self, **changes) -> None:
        after = State(**asdict(self.state) | changes)
        schema = "key string, newest string, chunks bigint, loaded boolean, batch bigint"
        self.spark.createDataFrame([tuple(asdict(after).values())], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={self.version + 1}")
        self.version, self.state = self.version + 1, after
        for n in folders(self.spark, self.path):
            if int(n.partition("=")[2]) < self.version:
                removed(self.spark, f"{self.path}/{n}")

    def add(self, sources: DataFrame, batch: int | None = None) -> None:
        """Counts a batch of (sort_key, chunk_count); one that comes again after a failure counts once."""
        if batch is not None and batch <= self.state.batch:
            return
        counted = F.lit(True) if self.state.loaded else F.col("sort_key") > self.state.key
        row = sources.agg(F.sum(F.when(counted, F.col("chunk_count"))).alias("n"), F.max("sort_key").alias("top")).first()
        self.keep(chunks=self.chunks + (row["n"] or 0), newest=max(self.newest, row["top"] or ""), loaded=True, batch=self.state.batch if batch is None else batch)

    def reset(self) -> tuple[str, int]:
        """Anchors at the newest key; gives that key and what was counted before."""
        before = self.chunks
        self.keep(key=self.newest, chunks=0)
        return self.key, before

    def set(self, key: str) -> None:
        """Moves the anchor alone; the count stays."""
        self.keep(key=key)

    def follow(self, sources: DataFrame, checkpoint: str) -> StreamingQuery:
        """Counts a stream of sources, batch by batch, until there is no more for now. The checkpoint and the state go together."""
        return sources.writeStream.foreachBatch(lambda df, i: self.add(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folders_done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
