"""Packing by concatenating and cutting: two-pass prefix sums over partition token totals, then fixed windows.

Pass one tokenises each partition where it lies and writes, for each document, its ids and where it starts in its
partition. The partitions' totals (one row each) give the partitions' global starts. Pass two cuts each document at
the multiples of the window and writes one record for each piece; a document over a boundary has several. No text or
id is shuffled, and the two passes read one written table, so a task that runs again yields the same rows.

Nulls and edges: a null text is empty and yields the end id alone; a null or repeated id is carried as it is, one set
of pieces for each row; an empty table yields no pieces; columns besides the id and the text are not read. Only the
last window may be short, so padding is under one window for a whole corpus.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, stored

WINDOW = 2048
END_ID = 1
#: Distinct space-separated strings whose ids a worker remembers, none longer than LONG, and characters of text that it
#: splits at a time.
REMEMBERED, LONG, AT_A_TIME = 900_000, 40, 1 << 18
#: The normaliser and the splitter, as their files have them, of vocabularies whose ids are found string by string.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Partitions whose starts, twelve bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Signs that are stripped from a string's end before it is encoded; they are a run of their own for the splitter.
SIGNS = ".,;:!?*#%&$|"

_known: dict[str, dict[str, bytes]] = {}
_tokenizers: dict = {}


def by_strings(vocabulary: dict) -> bool:
    """Whether a vocabulary's ids of a text are those of its space-separated strings."""
    model, splitter = vocabulary["model"], vocabulary["pre_tokenizer"] or {}
    steps = splitter.get("pretokenizers", [])
    split = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": SPLITTER} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    level = split and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    plain = all(t["special"] for t in vocabulary["added_tokens"])  # others would be cut out of a text first
    return bool(level) and plain and vocabulary["normalizer"] == NORMALISER and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")


class Ids:
    """Token ids as little-endian uint32 bytes, string by string between spaces where the vocabulary allows it.

    A normaliser that composes, folds white space and lower-cases character by character, and a splitter that never
    joins over white space, make a text's ids those of its space-separated strings, in order. ``whole`` encodes a text
    in one call; the tests hold the two against each other. Other vocabularies' texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            found = Tokenizer.from_file(path)
            found.encode_special_tokens = True  # their strings in a text are ordinary text
            ends = np.zeros(max(found.get_vocab().values(), default=0) + 1, bool)
            ends[[i for token, i in found.get_vocab().items() if token.endswith("</w>")]] = True
            _tokenizers[path] = found, ends, by_strings(json.loads(found.to_str()))
        (self.tokenizer, self.ends, self.by_strings), self.known = _tokenizers[path], _known.setdefault(path, {})

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids, a few texts at a time."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > AT_A_TIME:
                yield from self.few(part)
                part, size = [], 0
        yield from self.few(part)

    def few(self, texts: list[str]) -> list[bytes]:
        if not self.by_strings:
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(known)
        plain, parts = set(), []
        for w in (*new, *plain):
            base = w.rstrip(SIGNS)
            if base is not w and base.isalpha():
                low = base.lower() if base.isascii() else base
                parts.append((w, low, w[len(base) :]))
                plain.add(low)
                plain.add(w[len(base) :])
            else:
                plain.add(w)
        fresh = [w for w in plain if w not in known]
        known.update(self.ascii_letters([w for w in fresh if w.isalpha() and w.isascii()]))
        known.update(self.letters([w for w in fresh if w.isalpha() and not w.isascii()]))
        rest = [w for w in fresh if w not in known]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = np.asarray(e.ids, dtype="<u4").tobytes()
        for w, low, signs in parts:
            known[w] = known[low] + known[signs]
        done = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in (*new, *plain):
            if len(w) > LONG:  # long strings are few, or else would fill the memory
                known.pop(w, None)
        return done

    def ascii_letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of words of ASCII letters: what the normaliser and the splitter leave of each is itself in small letters, so the model alone is asked."""
        model, pack = self.tokenizer.model.tokenize, struct.pack
        for w in words:
            ids = [t.id for t in model(w.lower())]
            yield w, pack(f"<{len(ids)}I", *ids)

    def letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of words of letters alone: each is one run, and only a run's last id is a word end."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):  # else they are encoded one by one
                data, ends = ids.tobytes(), (4 * ends).tolist()
                yield from zip(part, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenised(df: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, start, doc_id, ids, tokens): ids are little-endian uint32 bytes with the end id; start counts within the partition."""
    path, end = vocabulary, np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, start = Ids(path or default_vocabulary()), TaskContext.get().partitionId(), 0
        for batch in batches:
            done = [x + end for x in ids.texts([t or "" for t in batch.column(1).to_pylist()])]
            n = np.asarray([len(x) // 4 for x in done], dtype=np.int64)
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), batch.column(0), pa.array(done, pa.binary()), pa.array(n)], ["part", "start", "doc_id", "ids", "tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, f"part int, start bigint, doc_id {kind}, ids binary, tokens bigint")


def cut_ids(ids: bytes, at: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of ids that begin at the global position at."""
    n, done, pieces = len(ids) // 4, 0, []
    while done < n:
        sequence, offset = divmod(at + done, window)
        length = min(window - offset, n - done)
        pieces.append((done, length, sequence, offset))
        done += length
    return pieces


def pack(df: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds the piece's ids as little-endian uint32 bytes."""
    spark = df.sparkSession
    done = stored(tokenised(df, vocabulary, end_id, id_col, text_col), "tokens")
    totals = sorted((r["part"], r["n"]) for r in done.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # a row a partition
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    starts = spark.createDataFrame(bases, "part int, base bigint")
    placed = done.join(F.broadcast(starts) if len(bases) <= BROADCAST_ROWS else starts, "part").select("doc_id", "ids", "tokens", (F.col("base") + F.col("start")).alias("at"))
    kind = df.schema[id_col].dataType.simpleString()
    more = ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows, kept = [], [], []
            for i, (ids, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for start, length, sequence, offset in cut_ids(ids, at, window):
                    own = ids[4 * start : 4 * (start + length)]
                    index.append(i)
                    rows.append((start, length, zlib.crc32(own), sequence, offset))
                    if with_ids:
                        kept.append(own)
            take = pa.array(index, pa.int32())
            start, length, crc, sequence, offset = (pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5))
            columns = [batch.column(0).take(take), start, length, crc, batch.column(2).take(take), sequence, offset]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(placed, run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint{more}")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>) of pack(..., with_ids=True), the last one padded with pad_id: a window in a group."""

    def build(key, table):
        out = np.full(window, pad_id, dtype=np.int32)
        for offset, ids in zip(table["offset"].to_pylist(), table["ids"].to_pylist(), strict=True):
            out[offset : offset + len(ids) // 4] = np.frombuffer(ids, dtype="<u4")
        return pa.table({"sequence_id": [key[0].as_py()], "ids": [out]}, schema=pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(build, "sequence_id bigint, ids array<int>")
