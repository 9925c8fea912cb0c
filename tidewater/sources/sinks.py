"""Sinks: pull of batches, CSV reports, text dumps, scalar series, graphs and status lines."""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class Pull:
    """Batches of a DataFrame one by one, fetched ahead by a thread: ``get`` blocks and raises StopIteration at the end,
    ``maybe`` returns at once, with None where no batch is ready or none is left (``ended`` tells which)."""

    def __init__(self, df: DataFrame, batch_size: int, keep_rest: bool = False, ahead: int = 2):
        self.ready: queue.Queue = queue.Queue(ahead)
        self.ended = self.closed = False
        threading.Thread(target=self.fetch, args=(df, batch_size, keep_rest), daemon=True).start()

    def offer(self, item: list[Row] | BaseException | None) -> None:
        while not self.closed:
            try:
                self.ready.put(item, timeout=0.1)
            except queue.Full:
                continue
            return

    def fetch(self, df: DataFrame, size: int, keep_rest: bool) -> None:
        try:
            held = []
            for row in df.toLocalIterator(prefetchPartitions=True):
                held.append(row)
                if len(held) == size:
                    self.offer(held)
                    held = []
                if self.closed:
                    return
            if held and keep_rest:
                self.offer(held)
            self.offer(None)
        except BaseException as e:  # it is raised where the batches are asked for
            self.offer(e)

    def taken(self, item: list[Row] | BaseException | None) -> list[Row] | None:
        if isinstance(item, BaseException):
            raise item
        self.ended = item is None
        return item

    def get(self) -> list[Row]:
        found = None if self.ended else self.taken(self.ready.get())
        if found is None:
            raise StopIteration
        return found

    def maybe(self) -> list[Row] | None:
        try:
            return None if self.ended else self.taken(self.ready.get_nowait())
        except queue.Empty:
            return None

    def close(self) -> None:
        self.closed = self.ended = True

    def __iter__(self) -> Iterator[list[Row]]:
        while not self.ended:
            try:
                found = self.get()
            except StopIteration:
                return
            yield found


def write_csv(df: DataFrame, path: str, header: bool) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def dump(df: DataFrame, most: int = -1) -> DataFrame:
    """(value): each row's fields as lines of text; most rows, -1 for all."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in df.columns])
    return (df if most < 0 else df.limit(most)).select(lines.alias("value"))


def scalars(df: DataFrame, path: str) -> None:
    """(run, step, tag, value) rows added to a table partitioned by run."""
    df.select("run", "step", "tag", "value").write.mode("append").partitionBy("run").parquet(path)


def dot(spec: dict[str, Any]) -> str:
    """A pipeline spec as a graph in the DOT language."""
    lines = ["digraph pipeline {"]
    for s in spec["stages"]:
        lines.append(f"  {json.dumps(s['name'])} [label={json.dumps(s['name'] + chr(10) + s['type'])}];")
        for source in s.get("inputs", []):
            stage, _, output = source.partition(".")
            lines.append(f"  {json.dumps(stage)} -> {json.dumps(s['name'])}" + (f" [label={json.dumps(output)}]" if output else "") + ";")
    return "\n".join([*lines, "}"])


def status_line(kind: str, payload: dict[str, Any]) -> str:
    """One line of JSON of a status stream."""
    return json.dumps({"type": kind, "payload": payload}, sort_keys=True, separators=(",", ":"))


def read_status(line: str, known: set[str]) -> tuple[str, dict[str, Any]]:
    found = json.loads(line)
    if found.get("type") not in known:
        raise ValueError(f"unknown type {found.get('type')!r}")
    return found["type"], found["payload"]
