"""Language spans of mixed-language text: script ranges narrow the candidates, Viterbi labels the words.

Learning counts hashed character bigrams, trigrams and whole words of each language, and the letters of each script
that it uses, over every learning document; what the tasks send is combined to languages times BUCKETS counts, which
is all that the model holds (languages are a closed code set). A word's score for a language is the mean log
likelihood of its grams times the root of their number; languages that hardly use the word's script are not
candidates. The best path over the words pays PENALTY for each change of language.

A path that never changes is best whenever no run of words gains other languages more than the penalty over it; that
test is a few running sums, so only texts that fail it go through the step-by-step search.

Only text and language of learning documents are used; prediction reads nothing but the text. Nulls and edges: a null
text or one without a letter is ``und`` with score 0, as is every text if nothing was learned; documents without a
language are not learned from; very long texts are labelled whole; repeated rows are labelled alike; an empty table
gives no rows; columns besides the named ones are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import id_remainder, map_batches

BUCKETS = 1 << 15
PENALTY = 12.0
SMOOTHING = 0.5
#: A language is a candidate for a word if the word's script has this share of the language's letters.
SCRIPT_SHARE = 0.01
#: Distinct words, and characters of them, that a task holds before it counts or forgets them.
REMEMBERED, REMEMBERED_CHARS = 300_000, 8 << 20
UNKNOWN = "und"
#: First code points of the letters of scripts, after Unicode's blocks; each range ends where the next begins.
SCRIPTS = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0780, "other"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "other"),
    (0x0B80, "Tamil"),
    (0x0C00, "other"),
    (0x0E00, "Thai"),
    (0x0E80, "other"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "other"),
    (0x3040, "Kana"),
    (0x3100, "other"),
    (0x3400, "Han"),
    (0xA000, "other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"),
    (0xFF00, "other"),
    (0x20000, "Han"),
)
_firsts = np.asarray([a for a, _ in SCRIPTS])
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_script_of_range = np.asarray([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])
_letters = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _letters.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each gram, index of its word, script of each word: that of most of its letters, the first's of equals)."""
    joined = "\x02" + "\x03\x02".join(words) + "\x03"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.cumsum(code == 2) - 1
    two = code[:-1] * np.uint64(0x9E3779B1) + code[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + code[2:] * np.uint64(0x27D4EB2F) + np.uint64(7)
    mixed = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BUCKETS)
    in2, in3 = code[:-1] != 3, (code[:-2] != 3) & (code[1:-1] != 3)
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), np.int64, len(words))
    letter = code > 3
    scripts, kinds = _script_of_range[np.searchsorted(_firsts, code[letter].astype(np.int64), "right") - 1], len(SCRIPT_NAMES)
    of = word[letter]
    share = np.bincount(of * kinds + scripts, minlength=len(words) * kinds).reshape(-1, kinds) * 2
    share[np.arange(len(words)), scripts[np.flatnonzero(np.diff(of, prepend=-1))]] += 1
    script = share.argmax(1)
    bucket = np.concatenate([mixed(two[in2]).astype(np.int64), mixed(three[in3]).astype(np.int64), whole])
    return bucket, np.concatenate([word[:-1][in2], word[:-2][in3], np.arange(len(words))]), script


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS by languages, log likelihoods
    allowed: np.ndarray  # scripts by languages

    def scores(self, words: list[str]) -> np.ndarray:
        """Words by languages; languages that are no candidates get minus 30."""
        bucket, word, script = grams(words)
        n, out = np.bincount(word, minlength=len(words)), np.empty((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word, self.weights[bucket, k], len(words)) / np.sqrt(n)
        out -= out.max(1, keepdims=True)
        return np.where(self.allowed[script], np.maximum(out, -30.0), -30.0)


def counted(df: DataFrame) -> DataFrame:
    """(lang, kind, slot, n) of rows (text, lang): kind 0 counts grams by bucket, kind 1 words by script."""

    def rows(lang: str, words: Counter) -> pa.RecordBatch:
        bucket, word, script = grams(list(words))
        times = np.fromiter(words.values(), np.int64, len(words))
        by_bucket = np.bincount(bucket, times[word], BUCKETS).astype(np.int64)
        by_script = np.bincount(script, times, len(SCRIPT_NAMES)).astype(np.int64)
        b, s = np.flatnonzero(by_bucket), np.flatnonzero(by_script)
        n = len(b) + len(s)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.repeat([0, 1], [len(b), len(s)]), pa.int32()), pa.array(np.concatenate([b, s]), pa.int32()), pa.array(np.concatenate([by_bucket[b], by_script[s]]))], ["lang", "kind", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                held.setdefault(lang, Counter()).update(words)
                if sum(map(len, held.values())) > REMEMBERED or sum(map(len, words)) > REMEMBERED_CHARS:
                    yield from (rows(k, c) for k, c in held.items() if c)
                    held.clear()
        yield from (rows(k, c) for k, c in held.items() if c)

    return map_batches(df, run, "lang string, kind int, slot int, n bigint").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of df's rows that have both a text and a language."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    found = counted(rows).toArrow()
    names = found["lang"].to_pylist()
    langs = sorted(set(names))
    k = np.asarray([langs.index(x) for x in names], dtype=np.int64)
    kind, slot, n = (found[c].to_numpy() for c in ("kind", "slot", "n"))
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    counts[slot[kind == 0], k[kind == 0]] = n[kind == 0]
    scripts[slot[kind == 1], k[kind == 1]] = n[kind == 1]
    weights = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
    allowed = scripts >= SCRIPT_SHARE * scripts.sum(0)
    allowed[~allowed.any(1)] = True
    return Model(langs, weights.astype(np.float32), allowed)


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each row of scores; ties keep the language of the word before, then take the first."""
    n, k = s.shape
    best, back = s[0].tolist(), np.empty((n, k), np.int32)
    for i, row in enumerate(s[1:].tolist(), 1):
        top = max(range(k), key=best.__getitem__)
        limit = best[top] - penalty
        for j in range(k):
            if best[j] < limit:
                best[j], back[i, j] = limit + row[j], top
            else:
                best[j], back[i, j] = best[j] + row[j], j
    path = np.empty(n, np.int32)
    path[-1] = max(range(k), key=best.__getitem__)
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def labelled(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """viterbi(s), by running sums where one language throughout is surely best.

    Each run of another language pays a change, which no run's gain over the best language exceeds; only a path without
    the best language has a change less than runs, so its first and last run must not gain more than one together.
    """
    top = int(s.sum(0).argmax())
    ahead = np.cumsum(s - s[:, top : top + 1], axis=0)
    before = np.vstack([np.zeros((1, s.shape[1])), ahead[:-1]])
    run = (ahead - np.minimum.accumulate(before, axis=0)).max()
    if run <= penalty and ahead.max() + (ahead[-1] - before).max() <= penalty:
        return np.full(len(s), top, np.int32)
    return viterbi(s, penalty)


def spans_of(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, first word, words) of each run."""
    cuts = np.flatnonzero(np.diff(path)) + 1
    starts = np.concatenate([[0], cuts])
    return [(int(path[a]), int(a), int(b - a)) for a, b in zip(starts, np.append(cuts, len(path)), strict=True)]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans): the language of most words, its posterior, and every span of one language."""
    names = np.asarray([*model.langs, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        known, chars = np.zeros((0, len(model.langs))), 0
        for batch in batches:
            split = [words_of(t) for t in batch.column(1).to_pylist()]
            if len(at) > REMEMBERED or chars > REMEMBERED_CHARS:
                at, known, chars = {}, known[:0], 0
            new = list({w for words in split for w in words if w not in at})
            if new and model.langs:
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                known, chars = np.vstack([known, model.scores(new)]), chars + sum(map(len, new))
            preds, sure, spans = [], [], []
            for words in split:
                if not words or not model.langs:
                    preds.append(-1), sure.append(0.0), spans.append([])
                    continue
                s = known[[at[w] for w in words]]
                path = labelled(s, penalty)
                n, total = np.bincount(path, minlength=s.shape[1]), s.sum(0)
                pred = max(range(len(n)), key=lambda k: (n[k], total[k]))
                preds.append(pred)
                sure.append(float(1 / np.exp((total - total[pred]) / np.sqrt(len(words))).clip(max=1e6).sum()))
                spans.append([{"lang": model.langs[k], "start": a, "words": m} for k, a, m in spans_of(path)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[preds].tolist() if preds else [], pa.string()), pa.array(sure, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<lang: string, start: bigint, words: bigint>>")


def held_out_predictions(df: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id") -> DataFrame:
    """predict() of every row by a model of those whose crc32(id) mod folds isn't held; held_out says which weren't learned from."""
    fold = id_remainder(F.col(id_col), folds)
    model = learn(df.where(fold != held))
    found = predict(df, model, id_col)
    return found.withColumn("held_out", id_remainder(F.col("doc_id"), folds) == held)
