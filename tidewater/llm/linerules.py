"""Line-first quality rules: lines are judged and removed first, then documents by what they lost.

Lines are split at \\n; a line without a word is neutral and stays. A line fails by

* punctuation: over half of its words carry symbol runs or doubled exclamation or question marks, or it has capital
  letters and no small one over five words or more, or symbols make up over a third of its word characters;
* navigation: separator tokens (|, >, >>, », ·, •, /) are at least three and a fifth of its words, or every one of three
  words or more is a link or a bare address;
* boilerplate: it has one of the fixed phrases of site notices, in any case.

A document is rejected if it fails the base rules (under ten words; over a fifth of its words in five-word windows
found twice or more) or if the lines removed hold over LOST of its word characters.

Nulls and edges: a null or empty text has no words and fails the base rules; very long texts are judged whole, one
text at a time; repeated rows are judged alike; an empty table gives no rows; columns besides the named ones are not
read by ``judge`` and are carried as they are by ``cleaned``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, placed

LOST = 0.5
WINDOW = 5
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset("| > >> » · • /".split())
#: Fixed phrases of site notices in English, German, French and Spanish, in small letters.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here to subscribe",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to main content",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "datenschutzerklärung",
    "diese website verwendet cookies",
    "newsletter abonnieren",
    "wir verwenden cookies",
    "zum hauptinhalt springen",
    "abonnez-vous à notre newsletter",
    "accepter tous les cookies",
    "aller au contenu principal",
    "ce site utilise des cookies",
    "conditions générales d'utilisation",
    "mentions légales",
    "nous utilisons des cookies",
    "politique de confidentialité",
    "tous droits réservés",
    "aceptar todas las cookies",
    "aviso legal",
    "este sitio utiliza cookies",
    "ir al contenido principal",
    "política de privacidad",
    "suscríbase a nuestro boletín",
    "todos los derechos reservados",
    "términos y condiciones",
    "utilizamos cookies",
)
_word = re.compile(r"[^\x20\x09-\x0D]+")
_marked = re.compile(r"[#*$%&<>^~=_]{2,}|[!?]{2,}")
_lower, _upper = regex.compile(r"\p{Ll}"), regex.compile(r"\p{Lu}")
_link = re.compile(r"(?:https?://|www\.)\S+|\[[^\]]*\]\([^)]*\)")


def repeated_words(words: list[bytes] | list[str], window: int = WINDOW) -> int:
    """Words inside any window of so many words that the text has twice or more, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(window)), strict=True))
    if len(set(windows)) == n:
        return 0
    times, covered, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def has_notice(text: str) -> bool:
    low = text.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def line_fails(line: str, notices: bool = True) -> str | None:
    """The rule that a line fails, or None; notices: whether the line may have a phrase of BOILERPLATE."""
    words = _word.findall(line)
    if not words:
        return None
    n = len(words)
    marked = sum(1 for w in words if _marked.search(w)) if _marked.search(line) else 0
    if 2 * marked > n:
        return "punctuation"
    if n >= 5 and not _lower.search(line) and _upper.search(line):
        return "punctuation"
    symbols = sum(map(line.count, SYMBOLS))
    if symbols and 3 * symbols > sum(map(len, words)):
        return "punctuation"
    separators = sum(1 for w in words if w in SEPARATORS)
    if separators >= 3 and 5 * separators >= n:
        return "navigation"
    if n >= 3 and all(map(_link.fullmatch, words)):
        return "navigation"
    return "boilerplate" if notices and has_notice(line) else None


def judged(text: str | None) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed, text without them)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words, word_chars = len(words), len(text) - sum(map(text.count, SPACE))
    n_symbols, notices = sum(map(text.count, SYMBOLS)), has_notice(text)
    lines, seen, doubled, left, lost, removed = text.split("\n"), set(), 0, [], 0, 0
    for line in lines:
        worded = bool(_word.search(line))
        if worded:
            doubled += line in seen
            seen.add(line)
        if worded and line_fails(line, notices):
            removed += 1
            lost += len(line) - sum(map(line.count, SPACE))
        else:
            left.append(line)
    n_repeat = repeated_words(words)
    base_failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    kept = not base_failed and lost <= LOST * word_chars
    return n_words, word_chars, n_symbols, doubled, n_repeat, base_failed, kept, removed, "\n".join(left) if removed else text


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_lines)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[judged(t)[:8] for t in batch.column(1).to_pylist()], strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, f"doc_id {kind}, {', '.join(f'{n} bigint' for n in names[:5])}, base_failed boolean, kept boolean, n_removed_lines bigint")


def cleaned(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """df's kept rows with their failed lines removed; chars_col, where df has it, counts the characters left."""
    at = df.columns.index(text_col)
    chars = df.columns.index(chars_col) if chars_col in df.columns else None
    plain = placed(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(t) for t in batch.column(at).to_pylist()]
            index = [i for i, x in enumerate(found) if x[6]]
            out = batch.take(pa.array(index, pa.int32()))
            texts = [found[i][8] for i in index]
            columns = list(out.columns)
            columns[at] = pa.array(texts, out.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in texts], out.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=out.schema)

    return map_batches(plain, run, plain.schema).toDF(*df.columns)
