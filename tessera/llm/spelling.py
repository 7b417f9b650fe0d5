"""Operator 11, spelling variant grouping by pairless wildcard groups.

Words that differ in one replaced code point share the key (position, prefix, suffix) of that
point; a group of a key keeps its size and its two first words by frequency, from which every
member learns how many near words it has there and the best of them. Words that differ by one
inserted code point meet where a deletion of the longer one equals the shorter: deletions look
up the vocabulary. No pair of words is ever a row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, materialize

#: Fixed value: a word is a maximal run of these.
RUN = "[A-Za-zÀ-ÿ]+"
#: One of so many runs of a document loses a code point (planted misspellings).
NOISE = 199
MIN_LENGTH = 6
MIN_COUNT = 5
#: A word's form occurs so many times as often.
RATIO = 5
#: The place of the replaced code point in a key; no word holds it.
WILD = "*"
#: Texts beyond this many characters are read run by run, not as one list of runs.
LONG_TEXT = 1 << 22
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile(RUN)


def text_words(doc_id: object, text: str | None, noise: int = NOISE, min_length: int = MIN_LENGTH) -> Counter:
    """The words of one text with their counts: lower-cased runs, some of them without a code point."""
    text = text or ""
    runs = Counter(_RUN.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in _RUN.finditer(text)))
    lowered: Counter = Counter()
    for run, n in runs.items():
        lowered[run.translate(_LOWER)] += n
    start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    words: Counter = Counter()
    for run, n in lowered.items():
        if noise:
            h = zlib.crc32(run.encode(), start)
            if h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
        if len(run) >= min_length:
            words[run] += n
    return words


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of all whole texts that occur ``min_count`` times or more; counts are summed by batch first."""
    arrow_limits(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                total.update(text_words(key.as_py(), text.as_py(), noise, min_length))
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    counts = slim.mapInArrow(each, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keys(word: Column, min_length: int) -> Column:
    """All keys under which ``word`` meets near words: (key, kind); kind 0 is the word itself, 1 a deletion, 2 a wildcard."""
    places = F.sequence(F.lit(1), F.length(word))
    before, after = lambda i: F.substring(word, F.lit(1), i - 1), lambda i: F.substring(word, i + 1, F.length(word))
    wild = F.transform(places, lambda i: F.concat(before(i), F.lit(WILD), after(i)))
    # Deleting either of two equal neighbours gives the same.
    less = F.filter(F.array_distinct(F.transform(places, lambda i: F.concat(before(i), after(i)))), lambda d: F.length(d) >= min_length)
    as_kind = lambda kind: lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind"))
    return F.concat(F.transform(F.array(word), as_kind(0)), F.transform(less, as_kind(1)), F.transform(wild, as_kind(2)))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, n_near, best, best_n): how many words of (word, n) are near, and the most frequent of them.

    A group of a key holds at most one word for each character of the alphabet at the
    wildcard, or for each place and character at a deletion, so no group is large.
    """
    keyed = words.select("word", "n", F.inline(_keys(F.col("word"), min_length)))
    place = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    # A key without a wildcard: the word of that spelling, if there is one, then those that have it as a deletion.
    ordered = Window.partitionBy("key").orderBy("kind", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    group = keyed.select(
        "word", "n", "kind", place.alias("own"),
        F.count("*").over(ordered).alias("size"),
        F.first(F.struct("kind", place.alias("at"))).over(ordered).alias("first"),
        F.nth_value(place, 2).over(ordered).alias("second"),
    )
    wild, itself = F.col("kind") == 2, F.col("kind") == 0
    leads = F.col("first.at") == F.col("own")
    found = (
        F.when(wild | itself, F.struct((F.col("size") - 1).alias("near"), F.when(leads, F.col("second")).otherwise(F.col("first.at")).alias("best")))
        .when(F.col("first.kind") == 0, F.struct(F.lit(1).cast("long").alias("near"), F.col("first.at").alias("best")))
        .otherwise(F.struct(F.lit(0).cast("long").alias("near"), F.lit(None).alias("best")))
    )
    met = group.select("word", "n", "kind", found.alias("f")).where((F.col("f.near") > 0) | itself)
    best = F.min("f.best")
    total = met.groupBy("word").agg(F.first("n").alias("n"), F.sum("f.near").alias("n_near"), best.alias("b"))
    return total.select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the chain of forms. Pointers double each round; forms must have no cycle."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        links = step.select("word", "root")
        if not step.where("_moved").take(1):
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, noise: int = NOISE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its near word of largest count (ties: the smaller word) if it occurs
    ``ratio`` times as often or more; its root is the end of the chain of forms, itself
    without one. Null and empty texts have no words; a null id counts as an empty one where
    runs are spoilt; rows that repeat are counted each; an empty table has no words. Columns but
    id and text, whatever their names, aren't read.
    """
    words = materialize(vocabulary(docs, id_col, text_col, noise, min_length, min_count), "vocabulary")
    chosen = F.col("best_n") >= ratio * F.col("n")
    near = materialize(near_words(words, min_length).select("word", "n", "n_near", F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")), "near")
    roots = follow(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
