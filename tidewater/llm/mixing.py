"""Mixing by iterative proportional fitting.

Token totals of (source, language, topic) cells are raked to target marginals: each round scales the cells of every
value of every dimension to that value's target, until all three marginals hold. A cell's rate is its raked weight over
its tokens; documents are sampled with probability min(1, c * rate), where c makes the expected tokens ``keep`` of all,
by a hash of their id, so the same documents are chosen whatever the partitions.

``targets`` gives shares of tokens for the values of any dimension; values that it leaves out get none. A dimension
without targets takes its own shares raised to TEMPERATURE, so small values gain. marginal_gap is how far the worst
marginal is from its target, as a share of all tokens: some targets contradict each other. With targets given, a gap
over REACHED is an error unless ``strict`` is false.

The tables have no topic column, so topics are found: a document's words of five bytes or more are hashed to DIMS
counts, whose square roots make a unit vector; the mean vector of its language is taken off, so that topics aren't
languages again; and k-means over all documents (whole numbers throughout, so that no order of summing matters) gives
TOPICS classes. ``topic`` takes any function of a text instead.

Cells are combined by Spark and fitted on the driver up to MAX_CELLS of them; beyond, the same rounds run on a
distributed table. Nulls and edges: nulls in source or language are a value of their own (with targets, None); a null
text and one without such words has topic -1; a cell without tokens has rate 1 at most; a null id hashes like any
other; rows of equal id and tokens are chosen together; an empty table gives no rows; ``sampled`` carries all columns,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import rng
from tidewater.llm.common import map_batches, placed, stored

TOPICS, DIMS, MEANS_ROUNDS = 6, 128, 8
#: Length of a document's vector, whose numbers are whole.
SCALE = 1000
TEMPERATURE = 0.7
KEEP = 0.8
TOLERANCE, ROUNDS = 1e-9, 500
REACHED = 1e-6
MAX_CELLS = 200_000
#: Languages whose means are broadcast, DIMS numbers each; more are joined by a shuffle.
BROADCAST_ROWS = 10_000
SEED = "mix-1"
#: Words whose class a task remembers, none longer than LONG bytes.
REMEMBERED, LONG = 300_000, 40
DIMENSIONS = ("source", "lang", "topic")
Targets = Mapping[str, Mapping]


def term_vector(words: list[bytes], known: dict[bytes, int]) -> list[int] | None:
    """The text's unit vector times SCALE; None without a word of five bytes."""
    slots = []
    for w in words:
        k = known.get(w)
        if k is None:
            k = zlib.crc32(w) % DIMS if len(w) >= 5 else -1
            if len(w) <= LONG:
                known[w] = k
        slots.append(k)
    counts = np.bincount(np.asarray(slots, np.int64) + 1, minlength=DIMS + 1)[1:]
    return np.rint(SCALE * np.sqrt(counts / counts.sum())).astype(np.int16) if counts.any() else None


def measured(df: DataFrame, text_col: str = "text", topic: Callable[[str], int] | None = None) -> DataFrame:
    """(row, tokens, topic, vector): df's rows as structs of columns by place, their words counted; a vector where no topic function is given."""
    plain = placed(df)
    rows = plain.select(F.struct("*").alias("row"), plain[df.columns.index(text_col)].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            tokens, topics, vectors = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                tokens.append(len(words))
                topics.append(topic(text or "") if topic else -1)
                vectors.append(None if topic else term_vector(words, known))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(topics, pa.int32()), pa.array(vectors, pa.list_(pa.int16()))], ["row", "tokens", "topic", "vector"])

    return map_batches(rows, run, T.StructType([T.StructField("row", plain.schema), T.StructField("tokens", T.LongType()), T.StructField("topic", T.IntegerType()), T.StructField("vector", T.ArrayType(T.ShortType()))]))


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, DIMS)


def summed(rows: DataFrame, keyed: Callable[[pa.RecordBatch], tuple[pa.Array, np.ndarray]], kind: str) -> DataFrame:
    """(key, n, sums): sums of the (key, vector) that keyed makes of each batch, by tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys, vectors = keyed(batch)
            keys = keys.dictionary_encode()
            code = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k in np.unique(code):
                own = vectors[code == k]
                name = keys.dictionary[int(k)].as_py() if k >= 0 else None
                n, s = held.get(name, (0, 0))
                held[name] = n + len(own), s + own.sum(0)
        for name, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMS, rows_kind), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(np.full(DIMS, n)), pa.array(s.astype(np.int64))], ["key", "dim", "n", "x"])

    rows_kind = pa.string() if kind == "string" else pa.int32()
    parts = map_batches(rows, run, f"key {kind}, dim int, n bigint, x bigint").groupBy("key", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return parts.groupBy("key").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("sums"))


def first_classes(vectors: np.ndarray) -> np.ndarray:
    """The classes that k-means begins with: by the greatest number's place."""
    return vectors.argmax(1) % TOPICS


def nearest(vectors: np.ndarray, centres: dict[int, np.ndarray]) -> np.ndarray:
    """The nearest centre's class, the least of equals. All numbers are whole and under 2**53, so sums are exact."""
    names = sorted(centres)
    c = np.stack([centres[k] for k in names])
    return np.asarray(names)[((c * c).sum(1)[None, :] - 2 * (vectors @ c.T)).argmin(1)]


def with_topics(slim: DataFrame) -> DataFrame:
    """slim, a written table with lang and vector, with topic from k-means over its vectors; the vector goes."""
    some = slim.where("vector is not null")
    means = stored(summed(some.select(F.col("lang").cast("string").alias("lang"), "vector"), lambda b: (b.column(0), vectors_of(b.column(1))), "string"), "means")
    side = means.select(F.col("key").alias("_lang"), F.transform("sums", lambda x: F.rint(x / F.col("n")).cast("smallint")).alias("mean"))
    side = F.broadcast(side) if means.count() <= BROADCAST_ROWS else side
    centred = slim.join(side, F.expr("cast(lang as string) <=> _lang"), "left").drop("_lang")
    pairs = stored(centred.where("vector is not null").select("vector", "mean"), "vectors")
    centres: dict[int, np.ndarray] = {}

    def classes(batch: pa.RecordBatch, at: int, own: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        vectors = vectors_of(batch.column(at)) - vectors_of(batch.column(at + 1))
        return (nearest(vectors, own) if own else first_classes(vectors)), vectors

    for _ in range(MEANS_ROUNDS):

        def keyed(batch: pa.RecordBatch, own: dict[int, np.ndarray] = centres) -> tuple[pa.Array, np.ndarray]:
            found, vectors = classes(batch, 0, own)
            return pa.array(found, pa.int32()), vectors

        rows = summed(pairs, keyed, "int").collect()  # a row a topic
        before, centres = centres, {r["key"]: np.rint(np.asarray(r["sums"]) / r["n"]) for r in rows}
        if set(before) == set(centres) and all((before[k] == centres[k]).all() for k in centres):
            break
    others = [c for c in centred.columns if c not in ("topic", "vector", "mean")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column(0).is_valid()
            topics = np.full(batch.num_rows, -1, np.int32)
            some = batch.filter(there)
            if some.num_rows:
                topics[there.to_numpy(zero_copy_only=False)] = classes(some, 0, centres)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(topics)], [*others, "topic"])

    return map_batches(centred.select("vector", "mean", *others), run, T.StructType([*(centred.schema[c] for c in others), T.StructField("topic", T.IntegerType())]))


def tempered(totals: np.ndarray, temperature: float = TEMPERATURE) -> np.ndarray:
    """Target totals of values: shares to the power of temperature, of the same sum; values without tokens get none."""
    powered = np.where(totals > 0, np.maximum(totals, 1e-300) ** temperature, 0.0)
    return powered / max(powered.sum(), 1e-300) * totals.sum()


def wanted(values: list, totals: np.ndarray, shares: Mapping) -> np.ndarray:
    """Target totals of values by given shares; an error for a share that isn't a number of 0 or more or that no row could have."""
    sums = dict(zip(values, totals.tolist(), strict=True))
    for k, v in shares.items():
        if not v >= 0 or v and not sums.get(k):
            raise ValueError(f"the target {v} of {k!r} can't be met")
    return np.asarray([shares.get(v, 0.0) for v in values]) / sum(shares.values()) * totals.sum()


def raked(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights from tokens whose sums over each dimension's codes are its goals."""
    w = tokens.astype(np.float64)
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, w, len(goal))
            scale = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            worst = max(worst, np.abs(scale - 1).max(initial=0.0))
            w *= scale[code]
        if worst < tolerance:
            break
    return w


def gap(weight: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray]) -> float:
    """How far the worst marginal is from its goal, as a share of all."""
    return max((np.abs(np.bincount(c, weight, len(g)) - g).max(initial=0.0) / max(g.sum(), 1e-300) for c, g in zip(codes, goals, strict=True)), default=0.0)


def goal_table(cells: DataFrame, d: str, temperature: float, shares: Mapping | None) -> DataFrame:
    """(value, goal) of a dimension of a cells table."""
    totals = stored(cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("t")), "totals")
    if shares is not None:
        given = totals.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], T.StructType([T.StructField("given", cells.schema[d].dataType), T.StructField("share", T.DoubleType())]))
        both = given.join(totals, F.expr("given <=> value"), "left")
        bad = both.where("not (share >= 0) or (share > 0 and not coalesce(t, 0) > 0)").first()
        if bad:
            raise ValueError(f"the target {bad['share']} of {bad['given']!r} can't be met")
        powered = F.coalesce("share", F.lit(0.0))
        totals = totals.join(given, F.expr("given <=> value"), "left")
    else:
        powered = F.when(F.col("t") > 0, F.pow("t", F.lit(temperature))).otherwise(0.0)
    sums = totals.agg(F.sum("t").alias("all"), F.sum(powered).alias("powers"))
    return stored(totals.crossJoin(F.broadcast(sums)).select("value", (powered / F.greatest("powers", F.lit(1e-300)) * F.col("all")).alias("goal")), "goals")  # sums is one row


def raked_table(cells: DataFrame, temperature: float = TEMPERATURE, rounds: int = ROUNDS, targets: Targets | None = None) -> tuple[DataFrame, float]:
    """raked() and gap() on a table of (source, lang, topic, tokens): adds weight. A round joins one row a value to the cells and writes no more than those rows."""
    goals = {d: goal_table(cells, d, temperature, (targets or {}).get(d)) for d in DIMENSIONS}
    factors = {d: goals[d].select("value", F.lit(1.0).alias("factor")) for d in DIMENSIONS}

    def weighted() -> DataFrame:
        now = cells.withColumn("weight", F.col("tokens").cast("double"))
        for d in DIMENSIONS:
            now = now.join(factors[d].select("value", "factor"), F.col(d).eqNullSafe(F.col("value"))).withColumn("weight", F.col("weight") * F.col("factor")).drop("value", "factor")
        return now

    for _ in range(rounds):
        worst = 0.0
        for d in DIMENSIONS:
            sums = weighted().groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("now"))
            known = goals[d].join(factors[d].select(F.col("value").alias("u"), "factor"), F.expr("value <=> u")).select(F.col("value").alias("v"), "goal", "factor")
            scale = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0)
            factors[d] = stored(sums.join(known, F.expr("value <=> v")).select("value", scale.alias("scale"), (F.col("factor") * scale).alias("factor")), "factors")
            worst = max(worst, factors[d].agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
        if worst < TOLERANCE:
            break
    found, apart = weighted(), 0.0
    for d in DIMENSIONS:
        sums = found.groupBy(F.col(d).alias("v")).agg(F.sum("weight").alias("now"))
        row = goals[d].join(sums, F.expr("value <=> v"), "left").agg(F.max(F.abs(F.col("goal") - F.coalesce("now", F.lit(0.0)))), F.sum("goal")).first()
        apart = max(apart, (row[0] or 0.0) / max(row[1] or 0.0, 1e-300))
    return found, apart


def multiplier(expected: Callable[[float], float], goal: float) -> float:
    """The c at which the expected tokens, sum of tokens * min(1, c * rate), are the goal."""
    low, high = 0.0, 1.0
    if not goal:
        return 1.0
    while expected(high) < goal and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):  # no number is between them
            break
        low, high = (mid, high) if expected(mid) < goal else (low, mid)
    return high


def fitted(cells: DataFrame, temperature: float = TEMPERATURE, keep: float = KEEP, max_cells: int = MAX_CELLS, targets: Targets | None = None, strict: bool | None = None) -> DataFrame:
    """(source, lang, topic, rate, probability, marginal_gap) of (source, lang, topic, tokens) cells."""
    spark = cells.sparkSession
    unknown = set(targets or {}) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"no dimensions: {sorted(unknown)}")
    cells = stored(cells, "cells")

    def tested(apart: float) -> float:
        if (bool(targets) if strict is None else strict) and apart > REACHED:
            raise ValueError(f"the targets contradict each other: a marginal stays {apart:.3g} of all tokens away")
        return apart

    if cells.count() > max_cells:
        found, apart = raked_table(cells, temperature, targets=targets)
        apart = tested(apart)
        rates = stored(found.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)), "rates")
        total = rates.agg(F.sum("tokens")).first()[0] or 0
        # one pass over the cells a step
        c = multiplier(lambda c: rates.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(c) * F.col("rate")))).first()[0], keep * total)
        return rates.select(*DIMENSIONS, "rate", F.least(F.lit(1.0), F.lit(c) * F.col("rate")).alias("probability"), F.lit(apart).alias("marginal_gap"))
    table = cells.toArrow().sort_by([(d, "ascending") for d in DIMENSIONS])
    tokens = table["tokens"].to_numpy().astype(np.float64)
    codes, goals = [], []
    for d in DIMENSIONS:
        values = table[d].to_pylist()
        names = list(dict.fromkeys(values))
        at = {v: i for i, v in enumerate(names)}
        codes.append(np.asarray([at[v] for v in values], np.int64))
        totals = np.bincount(codes[-1], tokens, len(names))
        given = (targets or {}).get(d)
        goals.append(tempered(totals, temperature) if given is None or not names else wanted(names, totals, given))
    weight = raked(tokens, codes, goals)
    apart = tested(gap(weight, codes, goals))
    rate = np.divide(weight, tokens, out=np.ones_like(weight), where=tokens > 0)
    p = np.minimum(1.0, multiplier(lambda c: (tokens * np.minimum(1, c * rate)).sum(), keep * tokens.sum()) * rate)
    out = table.select(list(DIMENSIONS)).append_column("rate", pa.array(rate)).append_column("probability", pa.array(p)).append_column("marginal_gap", pa.array(np.full(len(rate), apart)))
    return spark.createDataFrame(out.to_pylist(), T.StructType([cells.schema[d] for d in DIMENSIONS] + [T.StructField(n, T.DoubleType()) for n in ("rate", "probability", "marginal_gap")]))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Callable[[str], int] | None = None, targets: Targets | None = None, keep: float = KEEP, strict: bool | None = None, with_row: bool = False) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, rate, probability, marginal_gap, kept) of every row; with_row adds the row as a struct of columns by place."""
    rows = measured(df, text_col, topic)
    more = ["row"] if with_row else []
    field = lambda name: F.col("row").getField(f"c{df.columns.index(name)}")
    slim = stored(rows.select(field(id_col).alias("doc_id"), field(source_col).alias("source"), field(lang_col).alias("lang"), "topic", "vector", "tokens", *more), "measured")
    slim = slim.drop("vector") if topic else with_topics(slim)
    cells = fitted(slim.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), keep=keep, targets=targets, strict=strict)
    count = cells.count()
    side = cells.select(*[F.col(d).alias(f"c_{d}") for d in DIMENSIONS], "rate", "probability", "marginal_gap")
    met = F.expr(" and ".join(f"{d} <=> c_{d}" for d in DIMENSIONS))
    found = slim.join(F.broadcast(side) if count <= MAX_CELLS else side, met)
    return found.select("doc_id", *DIMENSIONS, "tokens", "rate", "probability", "marginal_gap", (rng.uniform(SEED, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tokens")) < F.col("probability")).alias("kept"), *more)


def sampled(df: DataFrame, **options) -> DataFrame:
    """df's rows that are chosen, with all their columns; options as mixed takes them."""
    return mixed(df, **options, with_row=True).where("kept").select("row.*").toDF(*df.columns)
