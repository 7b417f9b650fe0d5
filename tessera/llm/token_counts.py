"""Operator 1, token counts with offset-mapped attribution.

A whole document is encoded once. Token byte spans follow from the token ids, are
mapped to characters, and are joined with the spans of the document's sections; a
token across a boundary is allocated by the rule named, so that over sections that
cover the text the counts add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is shipped to executors; larger files are refused.
MAX_VOCABULARY_BYTES = 32 << 20
# Fixed value: the pattern by which the vocabulary's tokenizer parts a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of so many blanks are parted by hand.
LONG_BLANKS = 10_000
_LONG_BLANKS = regex.compile(rf"(?<!\p{{White_Space}})\p{{White_Space}}{{{LONG_BLANKS},}}")
#: Rules: a token counts where its first, middle or last byte lies, or by shares of its bytes.
RULES = ("first", "middle", "last", "share")

_encoders: dict = {}


class Encoder:
    """Token byte lengths of texts, in order."""

    def __init__(self, data: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.inner = tiktoken.Encoding("shipped", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def token_lengths(self, text: str) -> np.ndarray:
        """Byte lengths of a whole text's tokens.

        The matcher's stack overflows on very long runs of blanks, so these are parted as
        PATTERN parts them: all blanks but one that a word follows are a piece.
        """
        ids: list[int] = []
        at = 0
        for m in _LONG_BLANKS.finditer(text) if len(text) >= LONG_BLANKS else ():
            end = m.end() if m.end() == len(text) else m.end() - 1
            ids += self.inner.encode_ordinary(text[at : m.start()])
            ids += self.inner._encode_single_piece(text[m.start() : end])
            at = end
        ids += self.inner.encode_ordinary(text[at:])
        return self.lengths[np.asarray(ids, np.int64)]


def _encoder(key: int, data: bytes) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def line_sections(text: str) -> list[tuple[int, int]]:
    """The lines of a text as (start, end) in characters; a line's end belongs to it."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def attribute(text: str, lengths: np.ndarray, sections: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) of each section; sections may overlap or leave gaps.

    crossing: tokens that lie only partly in the section.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    first_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    spans = np.asarray(sections, np.int64).reshape(-1, 2)
    low, high = first_byte[np.clip(spans[:, 0], 0, len(first_byte) - 1)], first_byte[np.clip(spans[:, 1], 0, len(first_byte) - 1)]
    high = np.maximum(low, high)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # Tokens that overlap [low, high): from the first that ends after low to the last that starts before high.
    a, b = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
    b = np.maximum(a, np.where(high > low, b, a))
    crossing = np.zeros(len(spans), np.int64)
    if len(starts):
        left = (b > a) & (starts[np.minimum(a, len(starts) - 1)] < low)
        right = (b > a) & (ends[np.minimum(np.maximum(b - 1, 0), len(ends) - 1)] > high)
        crossing = left.astype(np.int64) + right - (left & right & (b - a == 1))
    if rule == "share":
        share = (b - a).astype(float)
        if len(starts):
            i, j = np.minimum(a, len(starts) - 1), np.minimum(np.maximum(b - 1, 0), len(ends) - 1)
            share -= np.where(b > a, np.maximum(0, low - starts[i]) / np.maximum(1, lengths[i]), 0)
            share -= np.where(b > a, np.maximum(0, ends[j] - high) / np.maximum(1, lengths[j]), 0)
        return share, crossing
    place = {"first": starts, "middle": starts + np.maximum(0, lengths - 1) // 2, "last": np.maximum(starts, ends - 1)}[rule]
    return np.searchsorted(place, high, "left") - np.searchsorted(place, low, "left"), crossing


def _ship(docs: DataFrame, vocabulary: str) -> tuple:
    """The vocabulary as a broadcast of at most MAX_VOCABULARY_BYTES, and its key."""
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to ship")
    arrow_limits(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(data), hash(data)


def document_tokens(docs: DataFrame, keep: dict[str, Column], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of the whole text, a row for each of ``docs``; null and empty texts have none."""
    shipped, key = _ship(docs, vocabulary)
    slim = docs.select(*[v.alias(k) for k, v in keep.items()], docs[text_col].cast("string").alias("_text"))
    names, kept = [*keep, "n_tokens"], len(keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shipped.value)
        for batch in batches:
            counts = pa.array([len(encoder.token_lengths(t.as_py() or "")) for t in batch.column("_text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], counts], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(each, f"{kinds}, n_tokens long")


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """(id, section, start, end, n_tokens, n_crossing): a row for each section; a map.

    ``sections_col``: array of structs whose first two fields are start and end in code
    points; without it the sections are the lines, each with its line end. Texts may be of
    any length, runs of blanks too. ``rule``: one
    of RULES; n_tokens is a double. Spans beyond the text are cut to it. Null and empty
    texts have no lines and so no rows; given sections of theirs count no tokens. Repeated
    rows give their rows each; null ids are kept. Other columns aren't read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shipped, key = _ship(docs, vocabulary)
    spans = docs[sections_col] if sections_col else F.lit(None).cast("array<struct<start:int,end:int>>")
    slim = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"), spans.alias("spans"))
    kind = slim.schema["key"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shipped.value)
        for batch in batches:
            counts, starts, ends, tokens, crossing = [], [], [], [], []
            for text, given in zip(batch.column("text"), batch.column("spans"), strict=True):
                text, given = text.as_py() or "", given.as_py()
                sections = line_sections(text) if not sections_col else [tuple(x.values())[:2] for x in given or [] if x and None not in tuple(x.values())[:2]]
                n, c = attribute(text, encoder.token_lengths(text), sections, rule) if sections else ([], [])
                counts.append(len(sections))
                starts += [max(0, min(s, len(text))) for s, _ in sections]
                ends += [max(0, min(e, len(text))) for _, e in sections]
                tokens += list(n)
                crossing += list(c)
            at = np.repeat(np.arange(len(counts)), counts)
            number = np.arange(len(at)) - np.repeat(np.cumsum([0, *counts[:-1]]) if counts else [], counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(np.asarray(tokens, float)), pa.array(np.asarray(crossing, np.int64))], names=[id_col, "section", "start", "end", "n_tokens", "n_crossing"])

    return slim.mapInArrow(each, f"{id_col} {kind}, section int, start long, end long, n_tokens double, n_crossing long")


def field_tokens(docs: DataFrame, fields: list[str], id_col: str = "doc_id", separator: str = "\n", vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """Tokens of each of several text fields when they are encoded as one text.

    The fields are joined by ``separator``, whose characters belong to no field; a null
    field is empty. ``section`` is the field's place in ``fields``.
    """
    parts = [F.coalesce(docs[f].cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for p in parts:
        spans.append(F.struct(at.alias("start"), (at + F.length(p)).alias("end")))
        at = at + F.length(p) + len(separator)
    joined = docs.select(docs[id_col].alias("_id"), F.concat_ws(separator, *parts).alias("_text"), F.array(*spans).alias("_spans"))
    return section_tokens(joined, "_id", "_text", "_spans", vocabulary, rule).withColumnRenamed("_id", id_col)
