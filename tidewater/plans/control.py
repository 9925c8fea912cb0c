"""Control messages to the stages of a pipeline: each goes to all stages, and those that know it answer.

A message is {kind: {field: value}}. The pools know ``chunk_pool``: {"reset_anchor": true} anchors at the newest source
and answers with what was counted before, {"set_anchor": key} moves the anchor alone, {} asks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import spec
from tidewater.streaming.anchors import Anchor

Answer = dict[str, Any]
#: Kinds of messages that a stage type knows, and how it answers them.
HANDLERS: dict[tuple[str, str], Callable[[Anchor, dict], Answer]] = {}


def handler(stage_type: str, kind: str) -> Callable:
    """Registers how a stage type answers a kind of message."""

    def register(f: Callable[[Anchor, dict], Answer]) -> Callable:
        if (stage_type, kind) in HANDLERS:
            raise spec.BadSpec(f"{stage_type} answers {kind} already")
        HANDLERS[stage_type, kind] = f
        return f

    return register


@handler("shuffling_chunk_pool", "chunk_pool")
def _(anchor: Anchor, request: dict) -> Answer:
    if request.get("reset_anchor"):
        key, chunks = anchor.reset()
        return {"anchor": key, "chunks_since_anchor": chunks}
    if "set_anchor" in request:
        anchor.set(request["set_anchor"])
    return {"anchor": anchor.key, "chunks_since_anchor": anchor.chunks}


class Controls:
    """The control side of a spec; its pools' anchors are tables under path, so that they outlast the driver."""

    def __init__(self, spark: SparkSession, text: str | bytes | dict, path: str):
        self.stages = {s["name"]: s["type"] for s in spec.checked(spec.read(text))}
        self.anchors = {name: Anchor(spark, f"{path}/{name}") for name, kind in self.stages.items() if kind == "shuffling_chunk_pool"}

    def ingested(self, pool: str, sources: DataFrame, batch: int | None = None) -> None:
        """Tells a pool of new (sort_key, chunk_count) sources."""
        self.anchors[pool].add(sources, batch)

    def send(self, message: dict[str, dict]) -> list[tuple[str, Answer]]:
        """(stage, answer) of the stages that know the message."""
        out = []
        for name, kind in self.stages.items():
            for asked, request in message.items():
                if (kind, asked) in HANDLERS:
                    out.append((name, HANDLERS[kind, asked](self.anchors[name], request)))
        return out
