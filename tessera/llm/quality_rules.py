"""Operator 3, quality rules: repetition rules, then distribution divergence.

A document's histogram of character classes and of common words is held against
language references; the Jensen-Shannon distance (base 2, 0 to 1) to the nearest
language must stay below a bound. Short texts, for which a histogram says little,
are not judged by it. The references are counted from all documents themselves: those
of a language that pass the base rule, then those of them that are near what the first
count gave, so that a share of junk doesn't blur them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, materialize

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
_PUNCTUATION = ".,;:!?'\"()-"


@dataclass(frozen=True)
class Thresholds:
    min_words: int = 20
    max_repeat_share: float = 0.30
    #: Below this many words the histograms say too little and are not used.
    min_histogram_words: int = 30
    #: The word histogram needs more words than the character histogram.
    min_common_words: int = 120
    max_character_distance: float = 0.20
    max_word_distance: float = 0.31


def _class_table() -> np.ndarray:
    """The class of each UTF-8 byte; 7 for bytes that continue a character."""
    table = np.full(256, 6, np.uint8)
    for i in range(256):
        c = chr(i)
        if i >= 0x80:
            table[i] = 1 if i >= 0xC0 else 7
        elif c.isalpha():
            table[i] = 0 if c.islower() else 2
        elif c.isdigit():
            table[i] = 3
        elif c in _PUNCTUATION:
            table[i] = 4
        elif c in _BLANKS:
            table[i] = 5
    return table


_CLASS = _class_table()
#: Documents that a language's reference needs.
LEAST_DOCUMENTS = 20
#: Sums that a task holds before it hands them on.
HELD = 200_000
#: Common words of a language.
COMMON = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class References:
    """A row for each language: shares of the seven character classes, and of ``vocabulary`` with all other words last."""

    classes: np.ndarray
    vocabulary: list[str]
    words: np.ndarray

    @cached_property
    def forms(self) -> dict[str, int]:
        """The written forms that count as a word of the vocabulary, each with its place."""
        return {f: k for k, w in enumerate(self.vocabulary) for f in ([] if w[-1:] in (".", ",") else [w]) + [w + ".", w + ","]}


NO_REFERENCES = References(np.zeros((0, 7)), [], np.zeros((0, 1)))


def js_distance(p: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, the root of the divergence in bits, of ``p`` to each reference row."""
    q = references / references.sum(axis=1, keepdims=True)
    mid = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / mid), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / mid), 0.0).sum(axis=1)
    return np.sqrt(np.maximum(0.0, (left + right) / 2))


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` words (a power of two) found twice or more.

    Windows get exact ranks by doubling: two windows are equal if their halves' ranks are.
    """
    n = len(words)
    if n <= window:
        return 0
    # Windows whose hashes all differ all differ.
    mixed, span = np.fromiter(map(hash, words), np.int64, n).view(np.uint64), 1
    while span < window:
        mixed, span = mixed[:-span] * _ODD + mixed[span:], span * 2
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    span, distinct = 1, len(seen)
    while span < window:
        if distinct == len(rank):  # every window differs already
            return 0
        pair = rank[:-span] * distinct + rank[span:]
        found, rank = np.unique(pair, return_inverse=True)
        span, distinct = span * 2, len(found)
    twice = np.bincount(rank, minlength=distinct)[rank] > 1
    if not twice.any():
        return 0
    at = np.flatnonzero(twice)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def class_shares(data: bytes) -> np.ndarray:
    h = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)[:7].astype(float)
    return h / h.sum()


def plain_words(text: str) -> Counter:
    """The lower-cased words of a text without a full stop or comma at their end."""
    return Counter(w[:-1] if w[-1] in ".," else w for w in text.lower().split())


def common_shares(text: str, n: int, references: References) -> np.ndarray:
    """Shares of the vocabulary's words, as ``plain_words`` has them, among a text's ``n`` words, all others last."""
    counts = Counter(text.lower().split())
    h = np.zeros(len(references.vocabulary) + 1)
    for w in counts.keys() & references.forms.keys():
        h[references.forms[w]] += counts[w]
    h[-1] = max(0.0, n - h.sum())
    return h / h.sum()


def measure(text: str | None, limits: Thresholds, references: References) -> tuple:
    """The result row of one text, without its id; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() parts at exactly the six ASCII blanks
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _BLANKS)
    repeated = repeated_words(words)
    failed = n < limits.min_words or 100 * repeated > round(100 * limits.max_repeat_share) * n
    near_class = near_word = None
    if n >= limits.min_histogram_words and len(references.classes):
        near_class = float(js_distance(class_shares(data), references.classes).min())
    if n >= limits.min_common_words and len(references.words):
        near_word = float(js_distance(common_shares(text, n, references), references.words).min())
    diverges = (near_class or 0.0) > limits.max_character_distance or (near_word or 0.0) > limits.max_word_distance
    return n, chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text), repeated, failed, not failed and not diverges, near_class, near_word


def _word_counts(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of texts as ``plain_words`` has them, and for each occurrence its word and its text."""
    lists = [t.lower().split() for t in texts]
    coded = pa.array([w for words in lists for w in words], pa.large_string()).dictionary_encode()
    named: dict[str, int] = {}
    to = [named.setdefault(w[:-1] if w[-1] in ".," else w, len(named)) for w in coded.dictionary.to_pylist()]
    return list(named), np.array(to, np.int64)[coded.indices.to_numpy()], np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _taught(batch: pa.RecordBatch, limits: Thresholds, beyond: References | None) -> Iterator[tuple[str, dict[str, float]]]:
    """(lang, sums) over the texts of a batch that are long enough and pass the base rule, every text with the same weight.

    With ``beyond``, only over those of them that are not near its references.
    """
    found = []
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        n = len(words)
        if n < max(limits.min_words, limits.min_common_words):
            continue
        shares = class_shares(data)
        if beyond:
            diverges = n >= limits.min_histogram_words and float(js_distance(shares, beyond.classes).min()) > limits.max_character_distance
            if not diverges and float(js_distance(common_shares(text, n, beyond), beyond.words).min()) <= limits.max_word_distance:
                continue
        if 100 * repeated_words(words) <= round(100 * limits.max_repeat_share) * n:
            found.append((lang, text, n, shares))
    if not found:
        return
    named, at, of = _word_counts([text for _, text, _, _ in found])
    each = 1 / np.array([n for _, _, n, _ in found])
    langs = np.array([lang for lang, _, _, _ in found], object)
    for lang in sorted(set(langs)):
        mine = langs == lang
        total = {f"class {k}": x for k, x in enumerate(sum(found[i][3] for i in np.flatnonzero(mine)))}
        total["documents"] = float(mine.sum())
        weight = np.bincount(at, np.where(mine, each, 0.0)[of], len(named))
        yield lang, total | {f"word {named[k]}": weight[k] for k in np.flatnonzero(weight)}


def _sums(rows: DataFrame, limits: Thresholds, beyond: References | None = None) -> DataFrame:
    """(lang, name, x): what the texts of ``rows`` (lang, text) teach, as ``_taught`` has it."""

    def flat(held: dict[tuple[str, str], float]) -> pa.RecordBatch:
        columns = [[k[0] for k in held], [k[1] for k in held], [float(x) for x in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["lang", "name", "x"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], float] = {}
        for batch in batches:
            for lang, total in _taught(batch, limits, beyond):
                for name, x in total.items():
                    held[lang, name] = held.get((lang, name), 0.0) + x
            if len(held) > HELD:
                yield flat(held)
                held = {}
        yield flat(held)

    found = rows.mapInArrow(each, "lang string, name string, x double").groupBy("lang", "name").agg(F.sum("x").alias("x"))
    return materialize(found, "references")  # read several times


def _references(sums: DataFrame) -> References:
    # Of each language the seven classes, the number of documents and the commonest words reach the driver.
    top = Window.partitionBy("lang", F.col("name").startswith("word ")).orderBy(F.desc(F.round("x", 9)), "name")
    kept = sums.withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= COMMON).collect()
    found = {(r.lang, r.name): r.x for r in kept}
    langs = sorted(lang for (lang, name), n in found.items() if name == "documents" and n >= LEAST_DOCUMENTS)
    if not langs:
        return NO_REFERENCES
    vocabulary = sorted({name[5:] for (lang, name) in found if name.startswith("word ") and lang in langs})
    # A word that is common in one language may be rare in another.
    rare = sums.where(F.col("name").isin([f"word {w}" for w in vocabulary])).collect()
    found |= {(r.lang, r.name): r.x for r in rare}
    n = np.array([found[lang, "documents"] for lang in langs])[:, None]
    classes = np.array([[found.get((lang, f"class {k}"), 0.0) for k in range(7)] for lang in langs]) / n
    words = np.array([[found.get((lang, f"word {w}"), 0.0) for w in vocabulary] for lang in langs]) / n
    return References(classes, vocabulary, np.hstack([words, np.maximum(0.0, 1 - words.sum(axis=1, keepdims=True))]))


def learn_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Thresholds | None = None) -> References:
    """References of the languages that ``docs`` name, from all documents; their texts are read twice.

    Without a column ``lang_col`` all texts are one language. Null ids, texts and languages
    teach nothing; repeated rows count each. A language needs LEAST_DOCUMENTS texts that pass
    the rules; without any, distances are null and only the base rule decides.
    """
    limits = limits or Thresholds()
    arrow_limits(docs.sparkSession)
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit("all")
    slim = docs.select(docs[id_col].alias("_id"), lang.alias("lang"), docs[text_col].cast("string").alias("text")).where("_id is not null and lang is not null and text is not null").select("lang", "text")
    every = _sums(slim, limits)
    first = _references(every)
    if not len(first.classes):
        return first
    # Those near the first count are all but the few that are not. A text adds far more than what rounding leaves.
    far = _sums(slim, limits, first).withColumn("x", -F.col("x"))
    return _references(every.union(far).groupBy("lang", "name").agg(F.sum("x").alias("x")).where("x > 1e-9"))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds | None = None, references: References | None = None) -> DataFrame:
    """One row per document with its counts, distances and verdict; a map, after the references were learned.

    ``references``: as learned from other documents; by default from ``docs``. Null and empty texts have no words and fail the base rule. Repeated rows and ids
    give a row each; other columns, whatever their names, aren't read.
    Distances are null for texts shorter than the guards.
    """
    limits = limits or Thresholds()
    references = references or learn_references(docs, id_col, text_col, limits=limits)
    arrow_limits(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    slim = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    schema = f"{id_col} {slim.schema['key'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), limits, references) for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])

    return slim.mapInArrow(each, schema)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds | None = None, references: References | None = None) -> DataFrame:
    """The documents that pass, rows and columns unchanged; a map, after the references were learned (from ``docs`` by default).

    Null and empty texts fail. Rows that repeat an id or a text are judged each for itself.
    """
    limits = limits or Thresholds()
    references = references or learn_references(docs, id_col, text_col, limits=limits)
    arrow_limits(docs.sparkSession)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure(t.as_py(), limits, references)[6] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
