"""Typed relations against a plain search of every name in every sentence."""

from __future__ import annotations

import random
import re

import pytest

from tessera.operators import relations as R


def plain(text, names):
    out = set()
    for sentence in re.split(r"[.!?\n]", text or ""):
        w = re.findall("[a-z0-9]+", sentence.lower())
        at = lambda p: [(i, i + len(p)) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        found = [(a, b, " ".join(n)) for n in names for a, b in at(n)]
        found = sorted(f for f in found if not any((a, b) != f[:2] and a <= f[0] and f[1] <= b for a, b, _ in found))
        for relation, phrases in R.RELATIONS.items():
            for p in phrases:
                for a, b in at(p.split()):
                    left, right = [f for f in found if f[1] <= a], [f for f in found if f[0] >= b]
                    if left and right and left[-1][2] != right[0][2]:
                        out.add((left[-1][2], relation, right[0][2]))
    return out


@pytest.mark.parametrize("few", [0, 100_000])
def test_relations_equal_a_plain_search(spark, monkeypatch, few):
    monkeypatch.setattr(R, "BROADCAST_NAMES", few)
    rng = random.Random(few)
    names = ["Red Widget", "widget", "Red", "store#01", "the big red widget", "kafka", "part", "inside out", None, "!!", "kafka"]
    bits = ["red", "widget", "Widget", "the", "big", "store 01", "Kafka", "uses", "relies on", "part of", "instead of", "inside", "out", "and", ".", "\n", "needs", ","]
    texts = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(2, 25)))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "red uses kafka. red uses kafka"), (203, "uses"), (204, "kafka uses kafka"), (205, "x " * 20_000 + "red needs kafka"), (1, "kafka replaces red")]
    known = {tuple(re.findall("[a-z0-9]+", n.lower())) for n in names if n} - {()}
    want = {(i, *r) for i, t in texts for r in plain(t, [list(n) for n in known])}
    rows, given = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n, "clash") for n in names], "name string, phrase string")
    got = R.typed_relations(rows, given)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)
    assert R.typed_relations(rows.where("false"), given).count() == 0
    assert R.typed_relations(rows, given.where("false")).count() == 0
