"""Language-model scoring by a probabilistic suffix tree over words.

Tokens are a text's words (A-Z lower-cased) and one end. The tree's states are contexts of zero to DEPTH words. A
context of LEAST occurrences or more in training is a candidate, and is retained if its next-token distribution
diverges from its suffix's by DIVERGENCE nats a token or more (a retained state's suffixes are retained with it). A
state's distribution is smoothed towards its suffix's, down to add-TENTH counts over the whole vocabulary:

    P(x | s) = (n(s, x) + (MASS + n of pairs under the floor) * P(x | suffix of s)) / (n(s) + MASS)

which sums to one. Scoring takes the longest state that ends at each token. Pairs count from two occurrences on.

All counts cover every training document and the tree grows with them: every word and pair of TWICE occurrences and
every context of LEAST is in it. No machine holds its pairs. Texts are numbered in chunks of some HELD_TOKENS tokens; a
chunk sends its distinct pairs to parts by their context's last word (frequent ones are dealt over several parts by the
next word), so that a pair and its suffixes' pairs meet; a part adds the counts up and sends each chunk those of its own
pairs of TWICE occurrences or more, by which the chunk's texts are scored. Contexts, and the MAX_WORDS most frequent words
(but all of LEAST occurrences, which contexts consist of), are on the driver and in the workers; a chunk's other words get
their numbers and counts by a join with the table of counts. The README has the figures.

learn gives a whole tree in one piece, for small corpora and for a look inside. A caller who asks for a bounded tree gets
such a one of at most MAX_WORDS words, MAX_STATES contexts and MAX_PAIRS pairs a depth: the floor rises until the rest
fit, a pair left out is in its state's smoothing mass, and a word left out is in no context, but has its exact count.

Nulls and edges: a null text is empty and has the end token alone; a null id counts as the empty text in the folds;
repeated ids are scored row by row; very long texts are scored whole; with no training documents every probability is
one, and an empty table gives no rows; columns besides the named ones are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import id_remainder, map_batches, new_path, stored
from tidewater.operators.ordering import arrivals
from tidewater.storage import removed

TENTH = 0.1
DEPTH = 3
#: Occurrences of a context, and of a word or a pair.
LEAST, TWICE = 100, 2
DIVERGENCE = 0.02
MASS = 20.0
#: Of a bounded tree; words also of those that are broadcast where the tree is whole.
MAX_WORDS, MAX_STATES, MAX_PAIRS = 300_000, 200_000, 1_000_000
#: The end token; no word has a line end in it.
END = b"\n"
#: Distinct words and bytes of words, or tokens, that a task holds before it sends counts.
HELD_WORDS, HELD_BYTES, HELD_TOKENS = 300_000, 16 << 20, 2_000_000
#: What a part's rows are: its pairs with their counts, their sums by state, those of LEAST or more, and a chunk's own ones.
PAIRS, SUMS, OFTEN, BACK = range(4)


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


@dataclass
class Depth:
    """The states of one context length. Sorted arrays; entries' keys are state * words + next word."""

    states: np.ndarray  # keys of contexts: first word * number of states one shorter + that state; words at length one
    total: np.ndarray  # n(s)
    kept: np.ndarray
    entries: np.ndarray
    counts: np.ndarray
    rest: np.ndarray  # n(s) less its entries
    child: np.ndarray  # each entry's state of the next length, or -1

    def find(self, keys: np.ndarray) -> np.ndarray:
        return lookup(self.states, keys)


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's place in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Tree:
    words: list[bytes]
    unigrams: np.ndarray
    n: int
    v: int
    depths: list[Depth]

    def __post_init__(self):
        self.at: dict[bytes, int] = {}

    def __getstate__(self):
        return {**self.__dict__, "at": {}, "words": b" ".join(self.words)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = self.words.split(b" ") if self.words else []

    @property
    def denominator(self) -> float:
        return self.n + TENTH * (self.v + 1)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; -1 for words that the tree lacks."""
        if len(self.at) < len(self.words):
            self.at = {w: i for i, w in enumerate(self.words)}
        get = self.at.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def first(self, k: int, state: np.ndarray) -> np.ndarray:
        """The first word of states of length k."""
        keys = self.depths[k - 1].states[state]
        return keys if k == 1 else keys // len(self.depths[k - 2].states)

    def suffix(self, k: int, state: np.ndarray) -> np.ndarray:
        """The states one shorter that states of length k end in; of length one, the root's -1."""
        return np.full(len(state), -1) if k == 1 else self.depths[k - 1].states[state] % len(self.depths[k - 2].states)

    def extended(self, k: int, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state of length k of a state one shorter and the word after it, or -1."""
        if k == 1:
            return self.depths[0].find(word)
        tail = self.extended(k - 1, self.suffix(k - 1, state), word)
        return np.where(tail >= 0, self.depths[k - 1].find(self.first(k - 1, state) * len(self.depths[k - 2].states) + np.maximum(tail, 0)), -1)

    def probability(self, k: int, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(word | state of length k) with all suffixes; the root's at length zero."""
        if k == 0:
            return (self.unigrams[word] + TENTH) / self.denominator
        d, below = self.depths[k - 1], self.probability(k - 1, self.suffix(k, state), word)
        entry = lookup(d.entries, state * len(self.words) + word)
        n = np.where(entry >= 0, d.counts[np.maximum(entry, 0)] if len(d.counts) else 0, 0)
        return (n + (MASS + d.rest[state]) * below) / (d.total[state] + MASS)

    def walk(self, ids: np.ndarray) -> Iterator[tuple[Depth, np.ndarray, np.ndarray]]:
        """(depth, the candidate before each token, its entry for the token) of each context length; -1 where there is none.

        ids are whole texts one after another. Their end tokens are in no context, so none reaches into another text. A
        longer context is found from the entry that it grew from, one token before.
        """
        top = np.full(len(self.words) + 1, -1, np.int64)  # its last place is that of -1, for words that the tree lacks
        if self.depths:
            top[self.depths[0].states] = np.arange(len(self.depths[0].states))
        state = np.concatenate([[-1], top[ids[:-1]]]) if len(ids) else ids
        for d in self.depths:
            entry = np.full(len(ids), -1)
            on = np.flatnonzero((state >= 0) & (ids >= 0)) if len(d.entries) else np.zeros(0, np.int64)
            entry[on] = lookup(d.entries, state[on] * len(self.words) + ids[on])
            yield d, state, entry
            state = np.full(len(ids), -1)
            there = np.flatnonzero(entry[:-1] >= 0)
            state[there + 1] = d.child[entry[there]]

    def log10(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(base, score) of each token; a word that the tree lacks has base 0 and only its states' smoothing in score."""
        root = np.where(ids < 0, 1.0, (self.unigrams[np.maximum(ids, 0)] + TENTH) / self.denominator if self.words else 1.0)
        p = root.copy()
        for d, state, entry in self.walk(ids):
            own = np.flatnonzero(state >= 0)
            own = own[d.kept[state[own]]]
            s, e = state[own], entry[own]
            n = np.where(e >= 0, d.counts[e], 0) if len(d.counts) else 0
            p[own] = (n + (MASS + d.rest[s]) * p[own]) / (d.total[s] + MASS)
        return np.log10(root), np.log10(p)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all tokens of a text column."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                size += len(text or "") if len(text or "") > HELD_BYTES // 16 else 0
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield rows(held)
                    held.clear()
                    size = 0
        if held:
            yield rows(held)

    return map_batches(texts, run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def floor_within(counts: DataFrame, least: int, most: int) -> int:
    """The least floor of n, an eighth of a doubling at a time, at which no more than so many rows are left."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.where(F.col("n") >= least).groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()  # a row a step
    left = 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        left += r["rows"]
        if left > most:
            return max(least, math.floor(2 ** ((r["step"] + 1) / 8)) + 1)
    return least


def numbered_texts(df: DataFrame, sent, id_col: str, text_col: str, folds: int, held: int) -> DataFrame:
    """(key, doc_id, held_out, ids, rare, times): ids are the tokens' numbers as little-endian int32 bytes, rare the words that the tree lacks."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (id_remainder(F.col(id_col), folds) == held).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, rare, times = [], [], []
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                found = own.ids(words)
                ids.append(found.astype("<i4").tobytes())
                seen = Counter(words[i] for i in np.flatnonzero(found < 0).tolist())
                rare.append(list(seen))
                times.append(list(seen.values()))
            key = np.arange(at, at + len(ids))
            at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], ["key", "doc_id", "held_out", "ids", "rare", "times"])

    return map_batches(slim, run, f"key bigint, doc_id {df.schema[id_col].dataType.simpleString()}, held_out boolean, ids binary, rare array<binary>, times array<int>")


def joined_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, start of each text) of many texts' ids."""
    size = np.fromiter((len(t) // 4 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), "<i4").astype(np.int64), np.cumsum(size) - size


def pair_counts(ids: DataFrame, sent) -> DataFrame:
    """(key, n): counts of (candidate of the last depth, next word) pairs, both of them in the tree's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value

        def counted(held: list[bytes]) -> pa.RecordBatch:
            tokens_, _ = joined_ids(held)
            *_, (_, state, _) = own.walk(tokens_)
            good = (state >= 0) & (tokens_ >= 0)
            keys, n = np.unique(state[good] * len(own.words) + tokens_[good], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int32))], ["key", "n"])

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text) // 4
                if size > HELD_TOKENS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return map_batches(ids, run, "key bigint, n int").groupBy("key").agg(F.sum("n").alias("n"))


def fitted(spark: SparkSession, ids: DataFrame, tree: Tree, states: np.ndarray, total: np.ndarray, bounded: bool) -> tuple[Depth, int]:
    """(the depth of the given candidates, with its pairs counted, the pairs' floor); nothing is tested yet."""
    none = np.zeros(0, np.int64)
    depth = Depth(states, total, np.zeros(len(states), bool), none, none, total.astype(np.float64), none)
    if not len(states):
        return depth, TWICE
    sent = spark.sparkContext.broadcast(Tree(tree.words, tree.unigrams, tree.n, tree.v, [*tree.depths, depth]))
    pairs = stored(pair_counts(ids, sent).where(F.col("n") >= TWICE), "pairs")
    floor = floor_within(pairs, TWICE, MAX_PAIRS) if bounded else TWICE
    found = pairs.where(F.col("n") >= floor).toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    depth.entries, depth.counts = keys[order], n[order]
    depth.rest = total - np.bincount(depth.entries // len(tree.words), depth.counts, len(states))
    return depth, floor


def divergent(tree: Tree, k: int) -> np.ndarray:
    """Whether the distribution of each state of length k is DIVERGENCE nats a token or more from its suffix's."""
    d = tree.depths[k - 1]
    state, word = d.entries // len(tree.words), d.entries % len(tree.words)
    q = tree.probability(k - 1, tree.suffix(k, state), word)
    p = (d.counts + (MASS + d.rest[state]) * q) / (d.total[state] + MASS)
    gain = np.bincount(state, p * np.log(p / q), len(d.states)).astype(np.float64)
    return diverges(d, gain, np.bincount(state, q, len(d.states)))


def diverges(d: Depth, gain: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Whether a state is retained, by the sums over its pairs of their gain and their probability under its suffix."""
    rest = (MASS + d.rest) / (d.total + MASS)  # the other words share q, scaled by this
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gain + np.where(rest > 0, np.maximum(1 - seen, 0) * rest * np.log(rest), 0)
    return gain >= DIVERGENCE


def most_frequent(n: np.ndarray, least: int, most: int) -> np.ndarray:
    """Places of the numbers of least or more: all, or those over what the most frequent leave out."""
    floor = max(least, int(np.partition(n, -most - 1)[-most - 1]) + 1) if len(n) > most else least
    return np.flatnonzero(n >= floor)


def seeds(spark: SparkSession, counts: DataFrame, bounded: bool = False, floor: int = TWICE) -> tuple[Tree, int]:
    """(a tree without states, the words' floor) of word_counts."""
    row = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    floor = floor_within(counts, TWICE, MAX_WORDS) if bounded else floor
    found = counts.where(F.col("n") >= floor).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return Tree(found["word"].to_pylist(), found["n"].to_numpy().astype(np.int64), row["n"] or 0, row["v"], []), floor


def grown(spark: SparkSession, tree: Tree, ids: DataFrame, depth: int = DEPTH, bounded: bool = False) -> Tree:
    """The tree with states of up to depth words, from a column of training texts' ids."""
    end = tree.words.index(END) if END in tree.words else -1
    most = lambda n: MAX_STATES if bounded else len(n)
    own = most_frequent(tree.unigrams, LEAST, most(tree.unigrams))
    keys, total = own[own != end].astype(np.int64), tree.unigrams[own[own != end]]
    for k in range(1, depth + 1):
        d, floor = fitted(spark, ids, tree, keys, total, bounded)
        tree.depths.append(d)
        if not len(keys):
            break
        d.kept = divergent(tree, k)
        for j in range(k, 1, -1):  # a retained state's suffixes are retained
            tree.depths[j - 2].kept[tree.suffix(j, np.flatnonzero(tree.depths[j - 1].kept))] = True
        own = most_frequent(d.counts, max(LEAST, floor), most(d.counts))
        state, word = d.entries[own] // len(tree.words), d.entries[own] % len(tree.words)
        shorter = tree.suffix(k, state)
        tail = tree.extended(k, shorter, word) if k > 1 else d.find(word)
        good = (tail >= 0) & (word != end)
        keys, total = tree.first(k, state[good]) * len(d.states) + tail[good], d.counts[own][good]
        order = np.argsort(keys)
        d.child = np.full(len(d.entries), -1, np.int32)
        d.child[own[good][order]] = np.arange(len(order)) if k < depth else -1
        keys, total = keys[order], total[order]
    return tree


def learn(spark: SparkSession, texts: DataFrame, counts: DataFrame, depth: int = DEPTH, bounded: bool = False) -> Tree:
    """The tree of a text column whose word_counts are given."""
    tree, _ = seeds(spark, counts, bounded)
    named = texts.select(F.lit("1").alias("doc_id"), F.col(texts.columns[0]).alias("text"))
    ids = stored(numbered_texts(named, spark.sparkContext.broadcast(tree), "doc_id", "text", 1, 1), "ids")
    return grown(spark, tree, ids.select("ids"), depth, bounded)


def trained(df: DataFrame, folds: int, held: int, id_col: str, text_col: str) -> DataFrame:
    """The texts that are learned from."""
    return df.where(id_remainder(F.col(id_col), folds) != held).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def summed(done: DataFrame, words: DataFrame, seldom: DataFrame, tree: Tree) -> DataFrame:
    """The result, of documents' (key, ..., base, score) by the tree and (key, word, times) of words that it lacks."""
    looked = words.join(seldom, "word", "left").select("key", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = looked.groupBy("key").agg(F.sum(F.col("times") * F.log10((F.col("n") + F.lit(TENTH)) / F.lit(tree.denominator))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    more = F.coalesce("more", F.lit(0.0))
    return done.join(sums, "key", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tree.n).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def scored_bounded(df: DataFrame, folds: int, held: int, id_col: str, text_col: str, depth: int) -> DataFrame:
    """scored by a tree that each worker holds."""
    spark = df.sparkSession
    counts = stored(word_counts(trained(df, folds, held, id_col, text_col)), "words")
    tree, floor = seeds(spark, counts, True)
    numbered = stored(numbered_texts(df, spark.sparkContext.broadcast(tree), id_col, text_col, folds, held), "ids")  # texts are split once more, then never again
    tree = grown(spark, tree, numbered.where("not held_out").select("ids"), depth, True)
    sent, kind = spark.sparkContext.broadcast(tree), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            n, known, base, score = [], [], [], []
            texts = batch.column(3).to_pylist()
            for lo in range(0, len(texts), 256):
                ids, start = joined_ids(texts[lo : lo + 256])
                b, s = own.log10(ids)
                n += np.diff(start, append=len(ids)).tolist()
                known += np.add.reduceat(ids >= 0, start, dtype=np.int64).tolist()
                base += np.add.reduceat(b, start).tolist()
                score += np.add.reduceat(s, start).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    done = map_batches(numbered.select("key", "doc_id", "held_out", "ids"), run, f"key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    words = numbered.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    return summed(done, words, counts.where(F.col("n") < floor), tree)


@dataclass
class Contexts:
    """A tree's states without its pairs: lists by length, arrays by state. Pairs' keys are state * words + next word."""

    words: int  # over all numbers of words; those of the tree's words are the least
    top: np.ndarray  # each of the tree's words' state of length one, or -1; the last place is that of all others
    spread: np.ndarray  # by state of length one: how many parts its pairs are dealt over
    keys: list[np.ndarray]
    total: list[np.ndarray] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)
    root: np.ndarray | None = None  # probability of each of the tree's words without a context
    denominator: float = 1.0

    def suffix(self, k: int, state: np.ndarray) -> np.ndarray:
        return self.keys[k - 1][state] % len(self.keys[k - 2])

    def walk(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """The state before each token of whole texts one after another, or -1, of each length."""
        state = np.concatenate([[-1], self.top[np.where(ids[:-1] < len(self.top) - 1, ids[:-1], -1).clip(-1)]]) if len(ids) else ids
        yield state
        for k in range(2, len(self.keys) + 1):
            on = np.flatnonzero(state[k:] >= 0) + k
            found = lookup(self.keys[k - 1], ids[on - k] * len(self.keys[k - 2]) + state[on])
            state = np.full(len(ids), -1)
            state[on] = found
            yield state

    def part(self, k: int, keys: np.ndarray, parts: int) -> np.ndarray:
        """The part of each pair: the same for a pair and those of its suffixes."""
        state, word = keys // self.words, keys % self.words
        for j in range(k, 1, -1):
            state = self.suffix(j, state)
        mixed = state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (word % self.spread[state]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def packed(a: np.ndarray) -> bytes:
    """Whole numbers, compressed by the place of their bytes."""
    return len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).reshape(-1).view("<i8") if n else np.zeros(0, np.int64)


def rising(data: bytes) -> np.ndarray:
    """Of packed differences."""
    return np.cumsum(unpacked(data))


def runs(a: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers, none below zero, begins."""
    return np.flatnonzero(np.diff(a, prepend=-1))


def numbered_chunks(df: DataFrame, sent, id_col: str, text_col: str, folds: int, held: int) -> DataFrame:
    """(chunk, doc_id, held_out, size, ids, lacking): a row for some HELD_TOKENS tokens of whole texts.

    size are the texts' tokens and ids their numbers, packed; -1 and below tell places in lacking, the chunk's words that
    the tree lacks.
    """
    slim = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (id_remainder(F.col(id_col), folds) == held).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk, docs, outs, ids, size, lacking = sent.value, TaskContext.get().partitionId() << 12, [], [], [], [], {}

        def row() -> pa.RecordBatch:
            columns = [pa.array([chunk]), listed(pa.concat_arrays(docs)), *(pa.array([packed(x)]) for x in (np.asarray(outs, np.int64), np.asarray(size, np.int64), np.concatenate(ids))), listed(pa.array(list(lacking), pa.binary()))]
            for x in (docs, outs, ids, size, lacking):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "held_out", "size", "ids", "lacking"])

        tokens_ = 0
        for batch in batches:
            for i, (text, out) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = tokens(text)
                found = own.ids(words)
                for j in np.flatnonzero(found < 0).tolist():
                    found[j] = -1 - lacking.setdefault(words[j], len(lacking))
                docs.append(batch.column(0).slice(i, 1))
                outs.append(out)
                ids.append(found.astype(np.int32))
                size.append(len(words))
                tokens_ += len(words)
                if tokens_ > HELD_TOKENS:
                    yield row()
                    chunk, tokens_ = chunk + 1, 0
        if size:
            yield row()

    return map_batches(slim, run, f"chunk bigint, doc_id array<{df.schema[id_col].dataType.simpleString()}>, held_out binary, size binary, ids binary, lacking array<binary>")


def listed(a: pa.Array) -> pa.Array:
    """A column of one row, which has all of a."""
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def completed(chunks: DataFrame, seldom: DataFrame, words: int) -> DataFrame:
    """(chunk, doc_id, held_out, size, ids, also, times) of numbered chunks whose lacking words have met (word, number, n).

    Such a word of TWICE occurrences gets words + its number; of the others, -1 stands for one occurrence and -2 for none.
    also are the numbers from words on, times their occurrences.
    """
    kind = chunks.schema["doc_id"].dataType.simpleString()
    met = chunks.select("chunk", F.posexplode("lacking").alias("at", "word")).join(seldom, "word").select("chunk", "at", "number", "n")

    def run_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches if batch.num_rows]
        chunk, at, number, n = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
        order = np.argsort(chunk, kind="stable")
        each = np.split(order, runs(chunk[order])[1:]) if len(order) else []
        yield pa.RecordBatch.from_arrays([pa.array([chunk[x[0]] for x in each], pa.int64()), *(pa.array([packed(c[x]) for x in each], pa.binary()) for c in (at, number, n))], ["chunk", "at", "number", "n"])

    met = map_batches(met.select("chunk", F.col("at").cast("bigint"), F.col("number").cast("bigint"), "n"), run_met, "chunk bigint, at binary, number binary, n binary")
    rows = chunks.select("chunk", F.lit(1).alias("last"), "ids", "size", "held_out", "doc_id", F.size("lacking").alias("lacking"))
    rows = rows.union(met.select("chunk", F.lit(0), "at", "number", "n", F.lit(None).cast(kind), F.lit(None).cast("int")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i, (chunk, last, *row, lacking) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 6)), strict=True)):
                if not last:
                    held.append(row)
                    continue
                at, number, n = (np.concatenate([np.zeros(0, np.int64), *(unpacked(x[j]) for x in held)]) for j in range(3))
                held = []
                often = n >= TWICE
                new = np.full(lacking, -2)
                new[at] = np.where(often, words + number, -1)
                ids = unpacked(row[0])
                low = np.flatnonzero(ids < 0)
                ids[low] = new[-1 - ids[low]]
                order = np.argsort(number[often])
                columns = [pa.array([chunk]), batch.column(5).slice(i, 1), *(pa.array([x]) for x in (row[2], row[1], packed(ids), packed(words + number[often][order]), packed(n[often][order])))]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "held_out", "size", "ids", "also", "times"])

    return map_batches(rows.repartition("chunk").sortWithinPartitions("chunk", "last"), run, f"chunk bigint, doc_id {kind}, held_out binary, size binary, ids binary, also binary, times binary")


def parted_pairs(chunks: DataFrame, sent, parts: int) -> DataFrame:
    """(part, chunk, keys, n, times): each chunk's distinct pairs of the longest states and how often training texts have them.

    times are the occurrences of the next words that the tree lacks, for pairs of one word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for chunk, out, size, ids, also, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = unpacked(ids)
                also, times = unpacked(also), unpacked(times)
                *_, state = own.walk(ids)
                good = np.flatnonzero((state >= 0) & (ids >= 0))
                if not len(good):
                    continue
                keys, n = np.unique((state[good] * own.words + ids[good]) * 2 + np.repeat(unpacked(out), unpacked(size))[good], return_counts=True)
                n[keys % 2 == 1] = 0
                keys = keys // 2
                first = runs(keys)
                keys, n = keys[first], np.add.reduceat(n, first)
                part = own.part(len(own.keys), keys, parts)
                order = np.argsort(part, kind="stable")
                first = runs(part[order])
                each, word = np.split(order, first[1:]), keys % own.words
                rare = [w[w >= len(own.top) - 1] if len(own.keys) == 1 else w[:0] for w in (word[x] for x in each)]
                yield pa.RecordBatch.from_arrays([pa.array(part[order][first]), pa.array([chunk] * len(each)), pa.array([packed(np.diff(keys[x], prepend=0)) for x in each]), pa.array([packed(n[x]) for x in each]), pa.array([packed(times[np.searchsorted(also, w)] if len(w) else w) for w in rare])], ["part", "chunk", "keys", "n", "times"])

    return map_batches(chunks.select("chunk", "held_out", "size", "ids", "also", "times"), run, "part int, chunk bigint, keys binary, n binary, times binary")


def merged_pairs(rows: DataFrame, words: int, own: int, k: int) -> DataFrame:
    """(part, kind, chunk, keys, n, times) of parted pairs whose parts have come together; own is the number of the tree's words."""

    def merged(part: int, found: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
        keys, n, times_of = [rising(x[1]) for x in found], np.concatenate([unpacked(x[2]) for x in found]), np.concatenate([unpacked(x[3]) for x in found])
        chunk, keys = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in keys]), np.concatenate(keys)
        root = np.zeros(len(keys), np.int64)
        if k == 1:
            root[keys % words >= own] = times_of
        order = np.argsort(keys, kind="stable")
        keys, n, chunk = keys[order], n[order], chunk[order]
        first = runs(keys)
        root = root[order][first]
        n = np.add.reduceat(n, first)
        times = np.diff(first, append=len(keys))
        good = n >= TWICE
        chunk, times, keys, n, root = chunk[np.repeat(good, times)], times[good], keys[first[good]], n[good], root[good]
        state = keys // words
        first = runs(state)
        out = [(PAIRS, -1, keys, n), (SUMS, -1, state[first], np.add.reduceat(n, first) if len(n) else n), (OFTEN, -1, keys[n >= LEAST], n[n >= LEAST])]
        order, pair = np.argsort(chunk, kind="stable"), np.repeat(np.arange(len(keys)), times)
        for x in np.split(order, runs(chunk[order])[1:]) if len(order) else ():
            out.append((BACK, found[chunk[x[0]]][0], keys[pair[x]], n[pair[x]]))
        return pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([packed(np.diff(x[2], prepend=0)) for x in out]), pa.array([packed(x[3]) for x in out]), pa.array([packed(root)] + [None] * (len(out) - 1), pa.binary())], ["part", "kind", "chunk", "keys", "n", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append(row)
        while held:
            yield merged(*held.popitem())

    return map_batches(rows, run, "part int, kind int, chunk bigint, keys binary, n binary, times binary")


def state_sums(pairs: DataFrame, states: int) -> np.ndarray:
    """The counts of each state's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(rising(keys)), pa.array(unpacked(n))], ["state", "n"])

    found = map_batches(pairs.where(F.col("kind") == SUMS).select("keys", "n"), run, "state bigint, n bigint").groupBy("state").agg(F.sum("n").alias("n")).toArrow()  # a row a state
    return np.bincount(found["state"].to_numpy(), found["n"].to_numpy(), states)


def gains(pairs: list[DataFrame], sent, parts: int) -> DataFrame:
    """(length, state, gain, seen) of parts: how far pairs take a state from its suffix, and what the suffix gives to them."""
    rows = [x.where(F.col("kind") == PAIRS).select("part", F.lit(k).alias("length"), "keys", "n", "times") for k, x in enumerate(pairs, 1)]
    both = rows[0]
    for x in rows[1:]:
        both = both.union(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = sent.value, {}
        for batch in batches:
            for part, length, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append((length, *row))
        while held:
            _, found = held.popitem()
            shorter = p = None
            for k, keys, n, times in sorted(found):
                keys, n = rising(keys), unpacked(n)
                state, word = keys // own.words, keys % own.words
                q = np.where(word < len(own.root), own.root[word.clip(max=len(own.root) - 1)], (unpacked(times) + TENTH) / own.denominator) if k == 1 else p[np.searchsorted(shorter, own.suffix(k, state) * own.words + word)]  # a suffix has all pairs of its state
                p = (n + (MASS + own.rest[k - 1][state]) * q) / (own.total[k - 1][state] + MASS)
                shorter, first = keys, runs(state)
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(state[first]), pa.array(np.add.reduceat(p * np.log(p / q), first)), pa.array(np.add.reduceat(q, first))], ["length", "state", "gain", "seen"])

    return map_batches(both.repartition(parts, "part"), run, "length int, state bigint, gain double, seen double").groupBy("length", "state").agg(F.sum("gain").alias("gain"), F.sum("seen").alias("seen"))


def parted(spark: SparkSession, tree: Tree, chunks: DataFrame, words: int, depth: int) -> tuple[Contexts, list[DataFrame]]:
    """(the tree's contexts, merged pairs by length); the tree's depths get the states alone."""
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, none = 2 * shuffles, np.zeros(0, np.int64)
    end = tree.words.index(END) if END in tree.words else -1
    own = np.flatnonzero(tree.unigrams >= LEAST)
    keys, total = own[own != end].astype(np.int64), tree.unigrams[own[own != end]]
    top = np.full(len(tree.words) + 1, -1, np.int64)
    top[keys] = np.arange(len(keys))
    contexts, pairs = Contexts(words, top, total * parts // max(tree.n, 1) + 1, [], root=(tree.unigrams + TENTH) / tree.denominator, denominator=tree.denominator), []
    for k in range(1, depth + 1):
        if not len(keys):
            break
        tree.depths.append(d := Depth(keys, total, np.zeros(len(keys), bool), none, none, total.astype(np.float64), none))
        contexts = replace(contexts, keys=[*contexts.keys, keys], total=[*contexts.total, total])
        sent = spark.sparkContext.broadcast(replace(contexts, total=[], root=None))
        pairs.append(stored(merged_pairs(parted_pairs(chunks, sent, parts).repartition(shuffles, "part"), words, len(tree.words), k), "pairs"))
        sent.destroy()
        d.rest = total - state_sums(pairs[-1], len(keys))
        often = pairs[-1].where(F.col("kind") == OFTEN).select("keys", "n").toArrow()  # at most a hundredth of the tokens
        key, n = (np.concatenate([none, *map(f, often[c].to_pylist())]) for c, f in (("keys", rising), ("n", unpacked)))
        state, word = key // words, key % words
        tail = tree.extended(k, tree.suffix(k, state), word) if k > 1 else d.find(word)
        good = (tail >= 0) & (word != end)
        keys, total = tree.first(k, state[good]) * len(d.states) + tail[good], n[good]
        order = np.argsort(keys)
        keys, total = keys[order], total[order]
    if not pairs:
        return contexts, pairs
    contexts = replace(contexts, rest=[d.rest for d in tree.depths])
    sent = spark.sparkContext.broadcast(contexts)
    found = gains(pairs, sent, shuffles).toArrow()  # a row a state
    sent.destroy()
    length, state = found["length"].to_numpy(), found["state"].to_numpy()
    for k, d in enumerate(tree.depths, 1):
        gain, seen = (np.bincount(state[length == k], found[c].to_numpy()[length == k], len(d.states)) for c in ("gain", "seen"))
        d.kept = diverges(d, gain, seen)
    for k in range(len(tree.depths), 1, -1):  # a retained state's suffixes are retained
        tree.depths[k - 2].kept[tree.suffix(k, np.flatnonzero(tree.depths[k - 1].kept))] = True
    return replace(contexts, kept=[d.kept for d in tree.depths]), pairs


def chunk_scores(chunks: DataFrame, pairs: list[DataFrame], sent, n: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of chunks' texts, which meet their own pairs; n is train_tokens."""
    kind = chunks.schema["doc_id"].dataType.simpleString()
    rows = chunks.select("chunk", F.lit(len(pairs) + 1).alias("length"), F.col("ids").alias("keys"), F.col("size").alias("n"), "held_out", "also", "times", "doc_id")
    for k, x in enumerate(pairs, 1):
        rows = rows.union(x.where(F.col("kind") == BACK).select("chunk", F.lit(k), "keys", "n", *[F.lit(None).cast("binary")] * 3, F.lit(None).cast(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = sent.value, [[] for _ in pairs_]
        for batch in batches:
            for i, (_, length, keys, n, out, also, times) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True)):
                if length <= len(held):
                    held[length - 1].append((keys, n))
                    continue
                ids, size, out = unpacked(keys), unpacked(n), unpacked(out)
                also, times = unpacked(also), unpacked(times)
                c = (ids == -1).astype(np.float64)  # -2 has none
                rare = np.flatnonzero(ids >= len(own.root))
                c[rare] = times[np.searchsorted(also, ids[rare])] if len(rare) else 0
                p = (c + TENTH) / own.denominator
                common = np.flatnonzero((ids >= 0) & (ids < len(own.root)))
                p[common] = own.root[ids[common]]
                base = np.log10(p)
                for k, state in enumerate(own.walk(ids) if held else (), 1):
                    entries, counts = (np.concatenate([np.zeros(0, np.int64), *(f(x[j]) for x in held[k - 1])]) for j, f in ((0, rising), (1, unpacked)))
                    order = np.argsort(entries, kind="stable")
                    on = np.flatnonzero(state >= 0)
                    on = on[own.kept[k - 1][state[on]]]
                    s, x = state[on], ids[on]
                    at = lookup(entries[order], np.where(x >= 0, s * own.words + x, -1))
                    m = np.where(at >= 0, counts[order][at], 0) if len(counts) else 0
                    p[on] = (m + (MASS + own.rest[k - 1][s]) * p[on]) / (own.total[k - 1][s] + MASS)
                held = [[] for _ in held]
                start = np.cumsum(size) - size
                columns = [batch.column(7).slice(i, 1).flatten(), pa.array(out == 1), *map(pa.array, (size, np.add.reduceat(ids >= -1, start, dtype=np.int64), np.full(len(size), n_), np.add.reduceat(base, start), np.add.reduceat(np.log10(p), start)))]
                done = pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                yield from (done.slice(lo, 10_000) for lo in range(0, len(size), 10_000))

    n_, pairs_ = n, range(len(pairs))
    return map_batches(rows.repartition("chunk").sortWithinPartitions("chunk", "length"), run, f"doc_id {kind[6:-1]}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def scored(df: DataFrame, folds: int = 10, held: int = 0, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, bounded: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from those not held out."""
    if bounded:
        return scored_bounded(df, folds, held, id_col, text_col, depth)
    spark = df.sparkSession
    counts = arrivals(word_counts(trained(df, folds, held, id_col, text_col)), "number")
    tree, floor = seeds(spark, counts, floor=min(LEAST, floor_within(counts, TWICE, MAX_WORDS)))
    sent = spark.sparkContext.broadcast(tree)
    first = numbered_chunks(df, sent, id_col, text_col, folds, held)  # texts are split once more, then never again
    first.write.option("compression", "zstd").parquet(path := new_path(spark, "ids"))
    sent.destroy()
    chunks = stored(completed(spark.read.schema(first.schema).parquet(path), counts.where(F.col("n") < floor), len(tree.words)), "ids")
    removed(spark, path)
    contexts, pairs = parted(spark, tree, chunks, len(tree.words) + tree.v + 1, depth)
    return chunk_scores(chunks, pairs, spark.sparkContext.broadcast(contexts), tree.n)


def perplexity(log10_score: float, n_tokens: int) -> float:
    return math.inf if not n_tokens else 10 ** (-log10_score / n_tokens)
