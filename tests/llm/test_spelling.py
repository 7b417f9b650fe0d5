"""Spelling variants against all pairs of words."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

from tessera.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, key string"


def distance_one(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def plain_variants(words):
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)
    return sorted(map(tuple, spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_equal_all_pairs(spark):
    rng = random.Random(3)
    stems = ["letter", "lettter", "aabbcc", "abbccc", "größen", "ÀÉÿÿxy", "x×y÷zz", "banana"]
    words = set(stems)
    for _ in range(3):
        for w in list(words)[:60]:
            i, c = rng.randrange(len(w)), rng.choice("abtéz")
            words |= {w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]}
    # Counts over several powers of the ratio, so that forms make chains.
    weights = {w: 5 ** rng.randrange(1, 5) for w in sorted(words)}
    bag = [w if rng.random() < 0.5 else w.upper() if w.isascii() else w for w, n in weights.items() for _ in range(n)]
    rng.shuffle(bag)
    rows = [(i, " ".join(part) + "\n1,end_of") for i, part in enumerate(itertools.batched(bag, 400))]
    rows += [(None, "banana " * 7), (None, None), (9000, ""), (9001, " \n"), (9002, "letter " * 60_000), (9002, "letter " * 60_000), (9003, "ß" * 5000)]
    words = plain_words(rows)
    want = plain_variants(words)
    assert run(spark, rows) == want
    assert sum(w[1] is not None for w in want) > 20
    assert any(w[2] not in (w[0], w[1]) for w in want)


def test_ties_chains_and_empty_tables(spark):
    # Two near words of the same count: the smaller one is the form.
    words = {"zebras": 5, "zebrax": 50, "zebraa": 50, "zebraaa": 300, "zebraaaa": 2000}
    assert run(spark, [(w + str(k), None) for w in () for k in ()]) == []
    rows = [(i, " ".join(w for w, n in words.items() for _ in range(n))) for i in (1, 2, 3)]
    counts = plain_words(rows)
    got = run(spark, rows)
    assert got == plain_variants(counts)
    assert {r[0]: r[1] for r in got}["zebras"] == "zebraa"
    assert {r[0]: r[2] for r in got}["zebras"] == "zebraaaa"


def test_long_texts_are_read_run_by_run(monkeypatch):
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    text = "Letters LETTERS and other words" * 50
    few = spelling.text_words(1, text)
    monkeypatch.undo()
    assert few == spelling.text_words(1, text)
