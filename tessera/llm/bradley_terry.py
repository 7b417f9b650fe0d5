"""Operator 5, quality classifier: Bradley-Terry ranking of documents.

Preference pairs (a good document over a poor one) teach a linear score by logistic
loss on feature differences; a quantile of the scores is the threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits
from tessera.llm.quality_rules import SYMBOLS, duplicate_lines

# Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein als eine "
    "de la le et les des en un du une que est pour qui dans par au sur pas avec "
    "de la que el en y los se del las un por con no una su para es al lo"
).split()
_STOP = sorted(set(COMMON_WORDS))
FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "bar", "exclaim", "stop_end", "comma", "common", "distinct", "repeat_next", "dup_lines", "long_words", "symbol_words", "upper_words")


def features(text: str | None) -> list[float]:
    """The features of one text, all from the text alone; null counts as empty."""
    text = text or ""
    words = text.split()
    n, size = len(words), max(1, len(text))
    many = max(1, n)
    counts = Counter(w.strip(".,;:!?").lower() for w in words)
    letters = Counter(text)
    lines = text.count("\n") + 1
    symbols = sum(text.count(c) for c in SYMBOLS)
    return [
        np.log1p(n),
        min(20.0, len(text) / many),
        sum(c for x, c in letters.items() if x.isupper()) / size,
        sum(c for x, c in letters.items() if x.isdigit()) / size,
        symbols / size,
        min(1.0, text.count("|") / many),
        min(1.0, text.count("!") / many),
        min(1.0, text.count(".") / many),
        min(1.0, text.count(",") / many),
        sum(counts[w] for w in _STOP) / many,
        len(counts) / many**0.75,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / many,
        duplicate_lines(text) / lines,
        sum(c for w, c in counts.items() if len(w) > 24) / many,
        min(1.0, symbols / many),
        sum(w.isupper() and len(w) > 1 for w in words) / many,
    ]


@dataclass(frozen=True)
class Ranker:
    """A fitted score: w . (x - centre) / scale, and the score at the threshold's quantile."""

    weight: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """In 0 to 1, 0.7 at the threshold."""
        z = np.clip((self.raw(x) - self.threshold) / self.spread + np.log(0.7 / 0.3), -30, 30)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = 60_000, steps: int = 400, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Fit on preference pairs drawn from all (good, poor) combinations with a fixed seed.

    The threshold is the quantile of the training scores at the share of poor documents,
    halfway between the two scores around it. Without both classes every score is neutral.
    """
    centre, scale = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES)), x.std(axis=0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(poor):
        return Ranker(np.zeros(len(FEATURES)), centre, scale, 0.0 if len(good) else 1.0, 1.0)
    z = np.clip((x - centre) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(poor, pairs)]
    w, moment, second = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, steps + 1):
        lost = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        slope = -(lost @ diff) / pairs + ridge * w
        moment, second = 0.9 * moment + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    raw = z @ w
    cut = float(np.quantile(raw, len(poor) / len(raw), method="midpoint"))
    return Ranker(w, centre, scale, cut, float(raw[good].std() + raw[poor].std()) / 4 or 1.0)


def featurize(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x array<double>); a map."""
    arrow_limits(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), rows], names=[id_col, "x"])

    return slim.mapInArrow(each, f"{id_col} {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000) -> Ranker:
    """Fit on at most ``sample`` labelled documents, the first by a hash of the id.

    The sample is the only thing brought to the driver: ``sample`` rows of 17 numbers.
    Rows with a null id, text or label teach nothing.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    chosen = known.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample)
    texts = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(chosen, id_col)
    slim = texts.select(F.struct(id_col, "_label").alias("_key"), F.col(text_col))
    got = featurize(slim, "_key", text_col).select(F.col(f"_key.{id_col}").alias("id"), F.col("_key._label").alias("label"), "x")
    rows = sorted((r.id, r.label, r.x) for r in got.dropDuplicates(["id"]).collect())
    return fit(np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows]))


def score_documents(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text; a map.

    Null and empty texts are scored as texts without words. Equal texts get equal scores;
    repeated rows and null ids give a row each. Other columns, whatever their names, aren't read.
    """
    arrow_limits(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(FEATURES))
            s = ranker.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(s), pa.array((s >= 0.7).astype(np.int32))], names=[id_col, "score", "predicted"])

    return slim.mapInArrow(each, f"{id_col} {kind}, score double, predicted int")
