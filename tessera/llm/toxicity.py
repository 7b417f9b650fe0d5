"""Operator 13, toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, and holds toxic
documents too. A linear score over words and their beginnings minimises the risk as it would
be with known negatives, put together from positives, unlabelled text and the class prior:

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

Where the second part falls below zero, which no true risk does, the step goes the other way,
so that the positives aren't learned by heart. Documents counted as not toxic serve for the
prior alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, materialize

#: Most documents that are learned from: the first by a hash of the id.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Tasks that read the sample.
PARTS = 32
#: Features that the score may use, and how many positives must show one.
FEATURES, MIN_POSITIVES = 8_192, 3
#: G statistic from which a feature counts as more frequent in positives: about one in 10 ** 5 by chance.
MIN_SIGNAL = 20.0
#: Share of toxic text where labels say nothing about it.
DEFAULT_PRIOR = 0.1
#: Lengths of word beginnings.
STEMS = range(3, 9)
#: Words whose score a task remembers at once.
REMEMBERED = 400_000
LONG_TEXT = 1 << 22

_WORD = re.compile(r"[^\W\d_]+")


def text_words(text: str | None) -> Counter:
    """The lower-cased letter runs of a whole text with their counts."""
    text = (text or "").lower()
    return Counter(_WORD.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in _WORD.finditer(text)))


def word_features(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [f"={word}", *(f"^{word[:k]}" for k in STEMS if k < len(word))]


class Remembered(dict):
    """What ``make`` gives of a word, made once; forgotten when it grows too large."""

    def __init__(self, make: Callable) -> None:
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.make(word)
        return out


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the bias; the score of a text is sigmoid(bias + sum(count * weight) / sqrt(words))."""

    weights: dict[str, float]
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        # Most words begin like no feature.
        begin = {f[1 : 1 + STEMS[0]] for f in self.weights}
        of_word = Remembered(lambda word: sum(self.weights.get(f, 0.0) for f in word_features(word)) if word[: STEMS[0]] in begin else 0.0)

        def score(text: str | None) -> float:
            words = text_words(text)
            z = self.bias + sum(map(mul, words.values(), map(of_word.__getitem__, words))) / max(1, sum(words.values())) ** 0.5
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


@dataclass
class Rows:
    """Sparse rows: ``of`` row, ``column`` and ``value`` of each entry."""

    n: int
    of: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, self.value * w[self.column], self.n)

    def back(self, slope: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * slope[self.of], width)


def risk(w: np.ndarray, positive: Rows, unlabelled: Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(the positives' part, the negatives' part, their slopes) of the logistic risk; the last weight is the bias."""
    soft = lambda z: np.logaddexp(0.0, z)
    odds = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    zp, zu = positive.dot(w[:-1]) + w[-1], unlabelled.dot(w[:-1]) + w[-1]
    up = prior * soft(-zp).mean()
    down = soft(zu).mean() - prior * soft(zp).mean()

    def slope(rows: Rows, s: np.ndarray) -> np.ndarray:
        return np.append(rows.back(s, len(w) - 1), s.sum()) / rows.n

    return up, down, -prior * slope(positive, 1 - odds(zp)), slope(unlabelled, odds(zu)) - prior * slope(positive, odds(zp))


def fit(positive: Rows, unlabelled: Rows, width: int, prior: float, steps: int = 300, rate: float = 0.2, ridge: float = 1e-5) -> np.ndarray:
    """Weights (the last one the bias) by Adam on the non-negative risk, over all rows at each step."""
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    if not positive.n or not unlabelled.n:
        return w
    moment, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, down, rise, fall = risk(w, positive, unlabelled, prior)
        slope = -fall if down < 0 else rise + fall
        slope = slope + ridge * np.append(w[:-1], 0)
        moment, second = 0.9 * moment + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w - rate * (1 - t / (steps + 1)) * (moment / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w


def class_prior(labels: DataFrame, label_col: str) -> float:
    """The share of toxic rows among labelled ones; DEFAULT_PRIOR where only one kind is there."""
    n, toxic = labels.where(F.col(label_col).isin(0, 1)).agg(F.count("*"), F.sum(F.col(label_col).cast("long"))).first()
    return min(0.5, max(0.005, toxic / n)) if toxic and toxic < n else DEFAULT_PRIOR


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(key, toxic, text) of the bounded sample, written once: at most POSITIVES confirmed rows and UNLABELLED of all."""

    def first(ids: DataFrame, most: int, toxic: bool) -> DataFrame:
        return ids.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", F.lit(toxic).alias("toxic"))

    known = docs.where(docs[text_col].isNotNull()).select(docs[id_col].alias("_id")).where("_id is not null")
    confirmed = labels.where(F.col(label_col) == 1).select(labels[id_col].alias("_id")).where("_id is not null").distinct()
    chosen = first(confirmed, POSITIVES, True).unionByName(first(known.distinct(), UNLABELLED, False))
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    # The sample's ids are bounded by the two constants.
    rows = texts.join(F.broadcast(chosen), "_id").select(F.col("_id").alias("key"), "toxic", "text")
    return materialize(rows.repartition(PARTS, "key"), "toxicity")


def signals(rows: DataFrame, n_positive: int, n_unlabelled: int, most: int = FEATURES) -> list[str]:
    """The features that more positives show than unlabelled rows do, the clearest first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Remembered(word_features)
        for batch in batches:
            shown: tuple[Counter, Counter] = Counter(), Counter()
            for toxic, text in zip(batch.column("toxic"), batch.column("text"), strict=True):
                shown[toxic.as_py()].update(set().union(*(features[w] for w in text_words(text.as_py()))))
            keys = list(shown[0].keys() | shown[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([shown[1][k] for k in keys], pa.int64()), pa.array([shown[0][k] for k in keys], pa.int64())], names=["feature", "a", "b"])

    counts = rows.select("toxic", "text").mapInArrow(each, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / (n_positive + n_unlabelled)
    part = lambda seen, n: F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0.0)
    g = 2 * (part(F.col("a"), n_positive) + part(F.col("b"), n_unlabelled))
    more = (F.col("a") >= MIN_POSITIVES) & (F.col("a") * n_unlabelled > F.col("b") * n_positive)
    chosen = counts.where(more).select("feature", g.alias("g")).where(F.col("g") >= MIN_SIGNAL).orderBy(F.desc("g"), "feature").limit(most)
    return [r.feature for r in chosen.collect()]


def sparse(rows: DataFrame, features: list[str]) -> tuple[Rows, Rows]:
    """The sample as (positive, unlabelled) rows over ``features``: counts by the root of the number of words."""
    place = {f: k for k, f in enumerate(features)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Remembered(lambda word: [place[f] for f in word_features(word) if f in place])
        for batch in batches:
            columns, values = [], []
            for text in batch.column("text"):
                words = text_words(text.as_py())
                got: Counter = Counter()
                for w, c in words.items():
                    for k in places[w]:
                        got[k] += c
                scale = max(1, sum(words.values())) ** 0.5
                columns.append(list(got))
                values.append([c / scale for c in got.values()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["key", "toxic", "columns", "values"])

    kind = rows.schema["key"].dataType.simpleString()
    got = sorted((r.toxic, r.key, r.columns, r["values"]) for r in rows.mapInArrow(each, f"key {kind}, toxic boolean, columns array<int>, values array<double>").collect())

    def packed(part: list) -> Rows:
        sizes = [len(r[2]) for r in part]
        return Rows(len(part), np.repeat(np.arange(len(part)), sizes), np.array([c for r in part for c in r[2]], np.int64), np.array([v for r in part for v in r[3]], float))

    return packed([r for r in got if r[0]]), packed([r for r in got if not r[0]])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> Model:
    """A model from the rows of ``labels`` marked toxic and from ``docs`` as unlabelled text.

    What reaches the driver is bounded by the constants: the sample's rows over at most
    FEATURES features. Repeated labels count once; null ids, labels and texts teach nothing.
    Without positives or text every score is the prior.
    """
    arrow_limits(docs.sparkSession)
    prior = class_prior(labels, label_col) if prior is None else prior
    rows = training_rows(docs, labels, id_col, text_col, label_col)
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    features = signals(rows, n.get(True, 0), n.get(False, 0)) if len(n) == 2 else []
    positive, unlabelled = sparse(rows, features)
    w = fit(positive, unlabelled, len(features), prior)
    return Model({f: float(x) for f, x in zip(features, w, strict=False)}, float(w[-1]))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text; a map.

    Null and empty texts have the score of no words. Equal texts get equal scores; repeated
    rows and null ids give a row each. Other columns, whatever their names, aren't read.
    """
    arrow_limits(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            s = np.array([score(t.as_py()) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return slim.mapInArrow(each, f"{id_col} {kind}, score double, predicted int")
