"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 hashes (seed 42, repeats included) have
it. Fingerprints link at ``radius`` or fewer differing bits; a document's component is the smallest id reachable.

Candidates. The 64 bits are cut into m segments on a ring. Two linked fingerprints differ in at most ``radius``
segments, so m - radius of them are equal: each fingerprint is indexed under every choice of so many segments, and only
fingerprints of a common key are compared. m grows with the number of distinct fingerprints, so that a key is shared by
few; no m loses a link. Before the full Hamming check, a candidate must have a chain: a start on the ring from which the
differences of every 1, 2, ... m consecutive segments stay within radius * length / m (Qin and Xiao, 2018: any pair
within the radius has one).

Groups. Equal fingerprints are one node. A key with more than BLOCK fingerprints is split into blocks and its pairs of
blocks go to different tasks. Within a task, a large bucket yields a spanning forest of its links, by search from each
fingerprint over those not reached yet, never all its pairs.

Nulls and edges: a null text has no words; a text without words has fingerprint zero and links like any other; a text
of fewer words than a shingle is one shingle; very long texts are hashed whole, a slice of shingles at a time; a null
id belongs to its fingerprint's component but never names one unless there is no other id (then null); repeated rows
keep their rows; an empty table gives no rows; columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import components, hot_join, map_batches, stored

BITS, SEED = 64, 42
SHINGLE, RADIUS = 4, 4
#: Fingerprints of a key that one task may hold; more are split into pairs of blocks.
BLOCK = 20_000
#: Up to so many fingerprints of a key are compared pair by pair.
FEW = 16
#: m is the least whose keys are shared by fewer other fingerprints than this, all keys of one together.
COMPANY = 8
SLICE = 1 << 15


def shingles(text: str | None, size: int) -> list[bytes]:
    """The text's space-joined shingles, A-Z lower-cased; the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(ends) - size])]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :], strict=True)]


def hashes(text: str | None, size: int) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles(text, size)]), ">u8")


def fingerprint(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes, unsigned."""
    if not len(h):
        return 0
    rows = h.astype(">u8", copy=False).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(rows), SLICE):
        ones += np.unpackbits(rows[i : i + SLICE], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes())


def fingerprints(df: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(hashes(t, size)) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp bigint")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def segments(m: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of m segments as equal as can be."""
    edges = [i * BITS // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def segments_for(n: int, radius: int = RADIUS) -> int:
    """The least m at which a fingerprint's keys are shared with fewer than COMPANY others of n random ones."""
    for m in range(radius + 1, 2 * radius + 6):
        if n * comb(m, radius) < COMPANY * 2 ** (BITS * (m - radius) / m):
            return m
    return 2 * radius + 6


def chained(x: np.ndarray, m: int, radius: int = RADIUS) -> np.ndarray:
    """Whether each difference x has a chain within the budgets from some start of the ring."""
    counts = np.stack([np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << n) - 1)) for a, n in segments(m)], axis=1).astype(np.int16)
    sums = np.concatenate([np.zeros((len(x), 1), np.int16), np.cumsum(np.hstack([counts, counts]), axis=1)], axis=1)
    budgets = np.asarray([radius * n // m for n in range(1, m + 1)])
    found = np.zeros(len(x), bool)
    for i in range(m):
        found |= (sums[:, i + 1 : i + m + 1] - sums[:, i : i + 1] <= budgets).all(1)
    return found


def linked(x: np.ndarray, m: int, radius: int = RADIUS) -> np.ndarray:
    """Whether each difference has at most radius bits; those without a chain are never counted in full."""
    out = chained(x, m, radius)
    out[out] = np.bitwise_count(x[out]) <= radius
    return out


def forest(fps: np.ndarray, m: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = linked(fps[at] ^ fps[left], m, radius)
            new = left[near]
            a.append(np.full(len(new), at))
            b.append(new)
            reached += new.tolist()
            left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def bucket_links(keys: np.ndarray, fps: np.ndarray, m: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: all of small runs', a forest of each large one's."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    size = np.diff(np.append(starts, len(keys)))
    small = np.repeat(size <= FEW, size)
    a, b = [], []
    for step in range(1, FEW):
        i = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not len(i):
            break
        i = i[linked(fps[i] ^ fps[i + step], m, radius)]
        a.append(fps[i]), b.append(fps[i + step])
    for at, n in zip(starts[size > FEW], size[size > FEW], strict=True):
        own = np.unique(fps[at : at + n])
        i, j = forest(own, m, radius)
        a.append(own[i]), b.append(own[j])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def keyed(distinct: DataFrame, m: int, radius: int = RADIUS) -> DataFrame:
    """(key, fp): each fingerprint under each choice of m - radius segments."""
    keys = []
    for number, chosen in enumerate(combinations(segments(m), m - radius)):
        key = F.lit(number).cast("bigint")
        for low, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")))
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): enough links among distinct fingerprints to connect whatever links connect."""
    m = segments_for(distinct.count(), radius)
    rows = keyed(distinct, m, radius)
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", own)
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def found(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            key, p, q, fp = columns
            run_ = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)]))
            a, b = bucket_links(run_, fp.view(np.uint64), m, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(c) for c in zip(*held, strict=True))

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            key, p, q, _ = held[-1]
            same = (key == key[-1]) & (p == p[-1]) & (q == q[-1]) if len(key) else np.zeros(0, bool)
            if len(key) and not same[0]:  # all but the last run are whole
                whole = joined()
                n = len(whole[0]) - int(same.sum())
                yield found(tuple(c[:n] for c in whole))
                held[:] = [tuple(c[n:] for c in whole)]
        if held and len(held[0][0]):
            yield found(joined())

    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return map_batches(dealt, run, "a bigint, b bigint")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, fp) rows."""
    prints = stored(prints, "fingerprints")
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    edges = stored(links(groups.select("fp"), radius), "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    classes = stored(components(nodes, edges), "classes")  # only fingerprints with a link
    named = groups.join(classes, groups["fp"] == classes["node"]).groupBy("component").agg(F.min("least").alias("named"))
    members = classes.join(named, "component").select(F.col("node").alias("fp"), "named")
    ids = stored(groups.join(members, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"), "n"), "ids")
    return hot_join(prints, ids, "fp", prints.count()).select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    found = grouped(fingerprints(df, size, id_col, text_col), radius)
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
