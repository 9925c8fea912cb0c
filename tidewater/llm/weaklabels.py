"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Their votes' patterns are counted over all
documents (at most 3 ** labellers patterns, whatever the data), and expectation-maximisation on the counts estimates
each labeller's chance of every vote on good and bad documents, with nothing labelled by hand. The patterns' posteriors
are the labels of a bounded sample, SAMPLE_ROWS documents expected and twice as many at most, on which a hashed linear
scorer of word, word-shape and document features is trained; it scores every document, and those at THRESHOLD or more
are kept. The sample is of distinct texts by their hash, so rows that repeat a text can't crowd it, and of every
pattern that the hash leaves out the shortest document is added, so no kind of document goes unseen.

Nulls and edges: a null, empty or wordless text is scored 0 and not kept; very long texts are judged whole; repeated
rows get equal results, whatever their ids; on an empty table nothing is learned and no row results; where no labeller ever disagrees with
the first guess the guess stands; columns besides the id and the text are not read by ``classify`` and are carried as
they are by ``kept_rows``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, placed
from tidewater.llm.linerules import repeated_words

GOOD, BAD = 1, 2
#: Documents that the scorer is trained on, as expected of a sample by hash; twice as many at most, and one a pattern.
SAMPLE_ROWS = 8000
DIMENSIONS = 1 << 16
THRESHOLD = 0.5
ROUNDS, EPOCHS, RATE, DECAY = 100, 6, 0.3, 1e-6
WORD_WEIGHT = 4.0
#: Words whose weights a task remembers, none longer than LONG characters.
REMEMBERED, LONG = 300_000, 40
#: Frequent words of English, German, French and Spanish.
STOPWORDS = frozenset(
    "the of and to in a is that it for on was as with be by this are from at or an "
    "der die das und ist von zu den mit sich des auf für nicht ein eine als auch es "
    "le la les de des et en un une du que est pour dans qui sur pas au par avec "
    "el los las del y que se por con para una su al lo como más".split()
)
_marks = "#*$%&|<>~^=_"


@dataclass(frozen=True)
class Facts:
    """What the labellers look at: shares from 0 to 1 and the number of words."""

    words: int
    stop: float
    marked: float
    upper: float
    repeated: float
    separators: float
    shouted: float
    ended: float
    variety: float


def facts(text: str | None) -> tuple[Facts, list[str]]:
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return Facts(0, 0, 0, 0, 0, 0, 0, 0, 0), words
    low = text.lower()
    stop = sum(1 for w in low.split() if w in STOPWORDS)
    marked = sum(1 for w in words if w[-1] in _marks and len(w) > 1) if any(c in text for c in _marks) else 0
    upper = sum(map(str.isupper, words))
    separators = sum(map(words.count, "|>/•·»")) if any(c in text for c in "|>/•·»") else 0
    shouted = sum(1 for w in words if w.endswith(("!!", "??"))) if "!!" in text or "??" in text else 0
    lines = [x for x in map(str.rstrip, text.split("\n")) if x]
    ended = sum(1 for x in lines if x[-1] in '.!?:;"…')
    return Facts(n, stop / n, marked / n, upper / n, repeated_words(words) / n, separators / n, shouted / n, ended / max(1, len(lines)), len(set(words)) / n), words


def by(value: float, bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else 0


#: Each labeller's vote on a document's facts: 0 for none.
LABELLERS = {
    "length": lambda f: by(f.words, f.words < 5, f.words >= 20),
    "stopwords": lambda f: by(f.stop, f.words >= 20 and f.stop < 0.04, f.stop >= 0.12),
    "marks": lambda f: by(f.marked, f.marked > 0.2, f.marked <= 0.02),
    "capitals": lambda f: by(f.upper, f.words >= 5 and f.upper > 0.5, f.upper <= 0.1),
    "repetition": lambda f: by(f.repeated, f.words >= 40 and f.repeated > 0.3, f.words >= 20 and f.repeated <= 0.1),
    "separators": lambda f: by(f.separators, f.separators > 0.1, f.separators <= 0.02),
    "shouting": lambda f: by(f.shouted, f.shouted > 0.2, f.shouted <= 0.02),
    "endings": lambda f: by(f.ended, f.words >= 20 and f.ended < 0.2, f.ended >= 0.6),
    "variety": lambda f: by(f.variety, f.words >= 50 and f.variety < 0.15, f.words >= 20 and f.variety >= 0.3),
}


def votes(f: Facts) -> int:
    """The labellers' votes as one number in base three."""
    code = 0
    for labeller in LABELLERS.values():
        code = 3 * code + labeller(f)
    return code


def ballots(codes: np.ndarray) -> np.ndarray:
    """Votes of each code, a labeller a column."""
    k = len(LABELLERS)
    return codes[:, None] // 3 ** np.arange(k - 1, -1, -1)[None, :] % 3


@dataclass(frozen=True)
class LabelModel:
    prior: float
    chance: np.ndarray  # labellers, class (0 bad, 1 good), vote: chances among votes given; not voting says nothing

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """The probability of good."""
        v = ballots(codes)
        log = np.stack([np.log(self.chance[np.arange(v.shape[1]), c, v]).sum(1) for c in (0, 1)])
        log += np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit_labels(codes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation on counted patterns. The first guess: good where no labeller votes bad."""
    v = ballots(codes)
    p = np.where((v == BAD).any(1), 0.1, 0.9)
    model = LabelModel(0.5, np.ones((v.shape[1], 2, 3)))
    for _ in range(rounds):
        chance = np.ones((v.shape[1], 2, 3))
        for c, weight in enumerate(((1 - p) * n, p * n)):
            for vote in (GOOD, BAD):
                chance[:, c, vote] = ((v == vote) * weight[:, None]).sum(0) + 1.0
        chance[:, :, 1:] /= chance[:, :, 1:].sum(2, keepdims=True)
        chance[:, :, 0] = 1.0
        prior = float(np.clip(((p * n).sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        before, model = model, LabelModel(prior, chance)
        p = model.posterior(codes)
        if np.abs(before.chance - model.chance).max() < 1e-9:
            break
    return model


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % DIMENSIONS


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other signs as they are, runs of up to two."""
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-2:] != [k, k]:
            out.append(k)
    return "".join(out)


def word_slots(word: str) -> tuple[int, int]:
    return slot("w" + word.lower()), slot("s" + shape(word))


def own_slots(f: Facts) -> list[int]:
    """Slots of the document's features: each fact in tenths."""
    shares = (f.stop, f.marked, f.upper, f.repeated, f.separators, f.shouted, f.ended, f.variety)
    return [slot(f"f{i}:{min(9, int(10 * x))}") for i, x in enumerate(shares)] + [slot(f"n{min(16, f.words.bit_length())}")]


def vector(f: Facts, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a document: words and shapes share WORD_WEIGHT by their frequency, own features weigh one."""
    slots = [s for w, n in Counter(words).items() for s in word_slots(w) for _ in range(n)]
    at, n = np.unique(np.asarray(slots, np.int64), return_counts=True)
    own = own_slots(f)
    return np.concatenate([at, own]), np.concatenate([WORD_WEIGHT * n / (2 * max(1, f.words)), np.ones(len(own))])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer, by adaptive gradient steps over rows of (slots, values, probability of good)."""
    weights, seen, bias, order = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6), 0.0, np.random.default_rng(7)
    mass = np.asarray([sum(y for *_, y in rows), sum(1 - y for *_, y in rows)])
    scale = (mass.sum() / (2 * np.maximum(mass, 1.0))).clip(max=10.0)  # either class weighs the same
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ x + bias, -30, 30)))
            step = (p - y) * (y * scale[0] + (1 - y) * scale[1])
            slope = step * x + DECAY * weights[at]
            seen[at] += slope * slope
            weights[at] -= RATE * slope / np.sqrt(seen[at])
            bias -= 0.01 * step
    return weights.astype(np.float32), bias


@dataclass(frozen=True)
class Classifier:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def vector_arrays(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """The slots and the values of vectors, 32 bits each."""
    return [pa.array([at.astype(np.int32) for at, _ in rows], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in rows], pa.list_(pa.float32()))]


def patterns(text: DataFrame) -> DataFrame:
    """(code, n, slots, values): each pattern of votes, its documents and the vector of the shortest of them, by checksum of equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        least: dict[int, tuple] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                f, words = facts(t)
                code = votes(f)
                held[code] += 1
                if code not in least or f.words <= least[code][0]:
                    key = (f.words, zlib.crc32((t or "").encode("utf-8", "surrogatepass")))
                    if code not in least or key < least[code][:2]:
                        least[code] = (*key, f, words)
        codes = list(held)
        first = [least[c] for c in codes]
        rows = vector_arrays([vector(f, words) for *_, f, words in first])
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array([held[c] for c in codes], pa.int64()), pa.array([x[0] for x in first], pa.int64()), pa.array([x[1] for x in first], pa.int64()), *rows], ["code", "n", "words", "crc", "slots", "values"])

    found = map_batches(text, run, "code int, n bigint, words bigint, crc bigint, slots array<int>, values array<float>")
    least = F.min_by(F.struct("slots", "values"), F.struct("words", "crc"))
    return found.groupBy("code").agg(F.sum("n").alias("n"), least.alias("x")).select("code", "n", "x.slots", "x.values")


def learn(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Labels from all rows; the scorer from a sample of distinct texts by hash and a document of each pattern."""
    text = df.select(F.col(text_col).alias("text"))
    found = patterns(text).toArrow().sort_by("code")
    codes, n = found["code"].to_numpy().astype(np.int64), found["n"].to_numpy()
    labels = fit_labels(codes, n)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [facts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(f) for f, _ in rows], pa.int32()), *vector_arrays([vector(f, words) for f, words in rows])], ["h", "code", "slots", "values"])

    share = min(1.0, sample_rows / max(1, int(n.sum())))
    chosen = text.where("text is not null").withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000))
    distinct = chosen.groupBy("h").agg(F.first("text").alias("text"))
    sample = map_batches(distinct, vectors, "h bigint, code int, slots array<int>, values array<float>").limit(2 * sample_rows).toArrow().sort_by("h")
    left_out = found.filter(pa.compute.invert(pa.compute.is_in(found["code"], pa.array(sample["code"].unique().to_pylist(), pa.int32()))))
    rows = pa.concat_tables([t.select(["code", "slots", "values"]) for t in (sample, left_out)])
    y = labels.posterior(rows["code"].to_numpy().astype(np.int64))
    return Classifier(labels, *fit_scorer([(s.values.to_numpy(), v.values.to_numpy().astype(np.float64), float(p)) for s, v, p in zip(rows["slots"], rows["values"], y, strict=True)]))


def scores(texts: list[str | None], model: Classifier, known: dict[str, float]) -> list[tuple[int, float]]:
    """(votes, score) of each text; known remembers words' weights."""
    out = []
    for text in texts:
        f, words = facts(text)
        if not words:
            out.append((votes(f), 0.0))
            continue
        total = 0.0
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            weight = known.get(w)
            if weight is None:
                a, b = word_slots(w)
                weight = float(model.weights[a]) + float(model.weights[b])
                if len(w) <= LONG:
                    known[w] = weight
            total += weight
        raw = WORD_WEIGHT * total / (2 * f.words) + float(model.weights[own_slots(f)].sum()) + model.bias
        out.append((votes(f), float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))))
    return out


def classify(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, weak_label, score, kept): weak_label is the posterior of the labellers' votes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            found = scores(batch.column(1).to_pylist(), model, known)
            weak = model.labels.posterior(np.asarray([c for c, _ in found], np.int64)) if found else np.zeros(0)
            score = np.asarray([s for _, s in found], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(score), pa.array(score >= THRESHOLD)], ["doc_id", "weak_label", "score", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, weak_label double, score double, kept boolean")


def kept_rows(df: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """df's rows that are kept, with all their columns."""
    at, plain = df.columns.index(text_col), placed(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            found = scores(batch.column(at).to_pylist(), model, known)
            yield batch.filter(pa.array([s >= THRESHOLD for _, s in found], pa.bool_()))

    return map_batches(plain, run, plain.schema).toDF(*df.columns)
