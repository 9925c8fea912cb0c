"""The ``chunks`` data source: archives of chunks (.tar), single chunks (.gz) and packs (.bz2) as frames.

The driver lists files and plans partitions of at most ``filesPerPartition``; executors index and read them. Options:
version (auto, 3 to 7), firstFrameOnly, corrupt (drop, or keep as a row with frame_idx -1 and null fields), recursive,
hidden files are skipped. Files are read through Python, from folders that all executors mount.
"""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import os
import shutil
import struct
import tarfile
import zlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidewater.sources import frames

KEYS = [T.StructField("sort_key", T.StringType()), T.StructField("chunk_index", T.LongType()), T.StructField("frame_idx", T.IntegerType())]
SCHEMA = T.StructType([*KEYS, *frames.FIELDS])
ARROW = pa.schema([pa.field("sort_key", pa.string()), pa.field("chunk_index", pa.int64()), pa.field("frame_idx", pa.int32()), *frames.ARROW])
IGNORED = "LICENSE"
KINDS = {".gz": "gz", ".tar": "tar", ".bz2": "bz2"}
#: Frames of an Arrow batch, about eight kilobytes each, and bytes of a file read at a time.
BATCH, READ = 512, 1 << 16


def listed(paths: list[str], recursive: bool = True) -> list[str]:
    """Regular files under paths or globs, without hidden names, by path."""
    found = []
    for path in paths:
        for top in sorted(glob.glob(path)) or [path]:
            if os.path.isfile(top):
                found.append(top)
                continue
            for folder, names, files in os.walk(top):
                names[:] = sorted(n for n in names if not n.startswith(".")) if recursive else []
                found += [os.path.join(folder, f) for f in sorted(files) if not f.startswith(".")]
    return found


def kind_of(path: str) -> str | None:
    return KINDS.get(os.path.splitext(path)[1])


def gunzipped(stream: BinaryIO, most: int | None = None) -> bytes | None:
    """All or the first bytes of a gzip stream of any number of members, read as far as it takes; None where it is broken."""
    out, d, left = [], zlib.decompressobj(31), most
    try:
        while left is None or left > 0:
            data = d.unused_data or stream.read(READ)
            if d.eof:
                if not data:
                    break
                d = zlib.decompressobj(31)
            elif not data:
                return None  # it ends inside a member
            while data and (left is None or left > 0):
                out.append(d.decompress(data, left or 0))
                left = None if left is None else left - len(out[-1])
                data = d.unconsumed_tail
    except zlib.error:
        return None
    return b"".join(out) or None


def members(path: str, most: int | None = None) -> Iterator[tuple[int, bytes | None]]:
    """(chunk index, bytes) of each chunk of a file, the first bytes alone if asked; None for one that can't be read."""
    kind = kind_of(path)
    if kind == "gz":
        with open(path, "rb") as f:
            yield 0, gunzipped(f, most)
    elif kind == "tar":
        index = 0
        with tarfile.open(path, "r:", ignore_zeros=False) as tar:
            for m in tar:
                if not m.isfile() or os.path.basename(m.name) == IGNORED:
                    continue
                stream = tar.extractfile(m)
                data = gunzipped(stream, most) if m.name.endswith(".gz") else stream.read(-1 if most is None else most)
                yield index, data or None
                index += 1
    elif kind == "bz2":
        yield from unpacked(path)


def unpacked(path: str) -> Iterator[tuple[int, bytes | None]]:
    """Games of a pack: records of version 3, then the games' plies as int16, then their number as uint32."""
    with bz2.open(path, "rb") as f:
        data = f.read()
    (games,) = struct.unpack("<I", data[-4:])
    plies, at = np.frombuffer(data[-4 - 2 * games : -4], "<i2"), 0
    for i, n in enumerate(plies.tolist()):
        yield i, data[at : at + n * frames.SIZES[3]]
        at += n * frames.SIZES[3]


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        flag = lambda name: options.get(name.lower(), options.get(name, "false")).lower() == "true"
        self.paths = options["path"].split(",")
        self.version = options.get("version", "auto")
        self.first, self.keep = flag("firstFrameOnly"), options.get("corrupt", "drop") == "keep"
        self.per = int(options.get("filesperpartition", options.get("filesPerPartition", "1")))

    def partitions(self) -> list[InputPartition]:
        files = [f for f in listed(self.paths) if kind_of(f)]
        return [Files(files[i : i + self.per]) for i in range(0, len(files), self.per)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.read_files(partition.paths)

    def read_files(self, paths: list[str]) -> Iterator[pa.RecordBatch]:
        for path in paths:
            key = os.path.splitext(os.path.basename(path))[0]
            try:
                for index, data in members(path, max(frames.SIZES.values()) if self.first else None):
                    yield from self.batches(key, index, data)
            except (OSError, tarfile.TarError, EOFError, struct.error):
                yield from self.batches(key, 0, None)

    def batches(self, key: str, index: int, data: bytes | None) -> Iterator[pa.RecordBatch]:
        try:
            if data is None:
                raise frames.BadFrames("unreadable")
            version = frames.sniffed(data) if self.version == "auto" else int(self.version)
            if self.first:
                data = data[: frames.SIZES.get(version, 0)]
            found = frames.widened(data, version)
        except frames.BadFrames:
            if self.keep:
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([index], pa.int64()), pa.array([-1], pa.int32()), *(pa.nulls(1, f.type) for f in frames.ARROW)], schema=ARROW)
            return
        for at in range(0, len(found), BATCH):
            part = found[at : at + BATCH]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array([index] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()), *frames.arrays(part)], schema=ARROW)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class ChunkWriter(DataSourceWriter):
    """One <sort_key>_<chunk_index><suffix>.gz a chunk. A task's rows must hold whole chunks, in order of frames.

    Tasks write into a folder of the job's own, each attempt under its own name; commit moves the files of the attempts
    that count to their final names and abort removes the folder, so a job that fails leaves and replaces nothing.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.version = options["path"], options.get("suffix", ""), int(options.get("version", "6"))
        self.aside = os.path.join(self.path, f".writing-{uuid.uuid4().hex}")

    def write(self, rows: Iterator) -> Written:
        folder = os.path.join(self.aside, uuid.uuid4().hex)
        os.makedirs(folder, exist_ok=True)
        held: list[dict] = []
        done, at = [], None
        for r in rows:
            key = (r["sort_key"], r["chunk_index"])
            if held and key != at:
                done.append(self.flush(folder, at, held))
                held = []
            held.append(r.asDict())
            at = key
        if held:
            done.append(self.flush(folder, at, held))
        return Written(done)

    def flush(self, folder: str, key: tuple[str, int], rows: list[dict]) -> str:
        name = os.path.join(folder, f"{key[0]}_{key[1]}{self.suffix}.gz")
        with open(name, "wb") as f:
            f.write(gzip.compress(frames.encode(frames.from_rows(sorted(rows, key=lambda r: r["frame_idx"])), self.version), 6, mtime=0))
        return name

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name in m.names if m else []:
                os.replace(name, os.path.join(self.path, os.path.basename(name)))
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ChunkReader:
        return ChunkReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkSource)


def frames_of(files: DataFrame, version: str = "auto", first: bool = False, corrupt: str = "drop", path: str = "path") -> DataFrame:
    """The frames of the files that a table lists, each task reading its own rows' files."""
    options = {"path": "", "version": version, "firstFrameOnly": str(first).lower(), "corrupt": corrupt}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ChunkReader(options)
        for batch in batches:
            yield from reader.read_files([p.removeprefix("file://").removeprefix("file:") for p in batch.column(0).to_pylist() if kind_of(p)])

    return files.select(path).mapInArrow(run, SCHEMA)


def tar_archives(frames_: DataFrame, path: str) -> DataFrame:
    """Writes <sort_key>.tar of one gzipped member a chunk under path, a task a source; gives (sort_key, chunks, path)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        os.makedirs(path, exist_ok=True)
        name, aside = os.path.join(path, f"{key[0].as_py()}.tar"), os.path.join(path, f".{uuid.uuid4().hex}")
        rows, n = table.sort_by([("chunk_index", "ascending"), ("frame_idx", "ascending")]), 0
        index = rows["chunk_index"].to_numpy()
        with tarfile.open(aside, "w", format=tarfile.USTAR_FORMAT) as tar:
            for at in np.flatnonzero(np.diff(index, prepend=-1)):
                own = rows.slice(at, int(np.searchsorted(index, index[at], "right")) - int(at))
                data = gzip.compress(frames.encode(frames.from_rows(own.to_pylist()), 6), 1, mtime=0)
                info = tarfile.TarInfo(f"chunk.{index[at]:08d}.gz")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                n += 1
        os.replace(aside, name)  # a task that runs again writes the same file
        return pa.table({"sort_key": [key[0].as_py()], "chunks": [n], "path": [name]})

    return frames_.groupBy("sort_key").applyInArrow(run, "sort_key string, chunks bigint, path string")


def pack_bytes(games: list[bytes]) -> bytes:
    """A pack of games of version 3 records, before compression: the records, the games' plies and their number."""
    plies = np.asarray([len(g) // frames.SIZES[3] for g in games], "<i2")
    return b"".join(games) + plies.tobytes() + struct.pack("<I", len(games))


def packed(games: DataFrame, path: str, name: str, per_pack: int, number: str = "row_number") -> DataFrame:
    """Writes packs of so many games under path, a task a pack; gives (pack, games, path).

    games has a row a game, numbered from 1: its plies, and values of frame fields that all its records share. A rest
    under one pack joins the last.
    """
    last = max(games.count() // per_pack - 1, 0)
    fields = [c for c in games.columns if c in {n for n, _, _ in frames.COLUMNS}]
    keyed = games.withColumn("pack", F.least(F.expr(f"({number} - 1) div {per_pack}"), F.lit(last)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        os.makedirs(path, exist_ok=True)
        found = os.path.join(path, f"{name}_{key[0].as_py():05d}.bz2")
        data = [frames.encode(frames.from_rows([{c: r[c] for c in fields} | {"version": 3}] * r["plies"]), 3) for r in table.sort_by(number).to_pylist()]
        aside = os.path.join(path, f".{uuid.uuid4().hex}")
        with bz2.open(aside, "wb") as f:
            f.write(pack_bytes(data))
        os.replace(aside, found)  # a task that runs again writes the same file
        return pa.table({"pack": [key[0].as_py()], "games": [len(data)], "path": [found]})

    return keyed.groupBy("pack").applyInArrow(run, "pack bigint, games bigint, path string")


def pack_games(games: list[bytes], path: str, per_pack: int) -> list[str]:
    """Packs of so many games of version 3 records; a rest under one pack joins the last."""
    packs = [games[i : i + per_pack] for i in range(0, len(games), per_pack)]
    if len(packs) > 1 and len(packs[-1]) < per_pack:
        packs[-2:] = [packs[-2] + packs[-1]]
    out = []
    for i, pack in enumerate(packs):
        name = f"{path}_{i:05d}.bz2"
        with bz2.open(name, "wb") as f:
            f.write(pack_bytes(pack))
        out.append(name)
    return out
