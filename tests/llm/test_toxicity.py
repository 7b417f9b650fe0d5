"""Toxicity: the risk and its slopes, the features against plain counts, and held-out accuracy."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from tessera.llm import toxicity as T

PLAIN = "the of and to a in is that it for was on with as be by this are at from river garden letter window paper winter music".split()
TOXIC = ["idiot", "scum", "vermin", "zorgabel", "zorgamot", "zorgatin"]
SCHEMA = "doc_id long, text string, toxic string, key string, score string"


def prose(rng, n, toxic=0):
    words = [rng.choice(PLAIN) if rng.random() < 0.6 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    for _ in range(toxic):
        words[rng.randrange(n)] = rng.choice(TOXIC)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = []
    for i in range(600):
        n = rng.choice([12, 60, 200, 900])
        bad = i % 6 == 0
        texts.append((i, prose(rng, n, max(2, n // 50) if bad else 0), int(bad)))
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t, *_ in rows], SCHEMA)


def test_held_out_toxic_documents_are_found_and_clean_ones_left(spark, corpus):
    # A third of the toxic rows are confirmed; the others stand among the unlabelled ones.
    labels = spark.createDataFrame([(i, y if not y or i % 18 == 0 else None) for i, _, y in corpus if i % 5], "doc_id long, toxic int")
    learn = [r for r in corpus if r[0] % 5]
    model = T.train(frame(spark, learn), labels, prior=1 / 6)
    got = {r.doc_id: r for r in T.score_documents(frame(spark, corpus), model).collect()}
    held = [(y, got[i].predicted) for i, _, y in corpus if i % 5 == 0]
    caught = sum(p for y, p in held if y)
    assert caught >= 0.9 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_scores_of_odd_rows(spark):
    model = T.Model({"=idiot": 8.0, "^zorg": 6.0}, -3.0)
    texts = [None, "", " \n\t", "IDIOT", "an idiot", "x zorga", "zorgx " * 30_000, "word " * 200_000, "ÀÉ ß 日本 123_4"]
    rows = [*enumerate(texts), (4, "an idiot"), (None, "an idiot")]
    got = [(r.doc_id, r.score) for r in T.score_documents(frame(spark, rows), model).collect()]
    assert len(got) == len(rows)

    def plain(text):
        words = T._WORD.findall((text or "").lower())
        z = -3 + sum((8 if w == "idiot" else 0) + (6 if w.startswith("zorg") and len(w) > 4 else 0) for w in words) / math.sqrt(max(1, len(words)))
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    for (i, s), (j, text) in zip(sorted(got, key=repr), sorted(rows, key=repr), strict=True):
        assert i == j
        assert abs(s - plain(text)) < 1e-12


def test_signals_and_sparse_rows_against_plain_counts(spark, corpus):
    rows = spark.createDataFrame([(i, bool(y), t) for i, t, y in corpus], "key long, toxic boolean, text string")
    n = collections.Counter(bool(y) for _, _, y in corpus)
    got = T.signals(rows, n[True], n[False])
    shown = {True: collections.Counter(), False: collections.Counter()}
    for _, t, y in corpus:
        shown[bool(y)].update({f for w in set(t.lower().split()) for f in T.word_features(w)})
    want = {}
    for f, a in shown[True].items():
        b = shown[False][f]
        share = (a + b) / sum(n.values())
        g = 2 * (a * math.log(a / (n[True] * share)) + (b * math.log(b / (n[False] * share)) if b else 0))
        if a >= T.MIN_POSITIVES and a / n[True] > b / n[False] and g >= T.MIN_SIGNAL:
            want[f] = g
    assert set(got) == set(want)
    assert [want[f] for f in got] == sorted(want.values(), reverse=True)
    positive, unlabelled = T.sparse(rows, got)
    assert (positive.n, unlabelled.n) == (n[True], n[False])
    w = np.arange(1.0, len(got) + 1)
    first = [t for _, t, y in corpus if y]
    words = [t.split() for t in first]
    plain = [sum(w[got.index(f)] for x in ws for f in T.word_features(x) if f in want) / math.sqrt(len(ws)) for ws in words]
    assert np.allclose(positive.dot(w), plain)


def test_risk_is_the_formula_and_its_slopes_are_right():
    rng = np.random.default_rng(0)

    def rows(n, width):
        x = rng.random((n, width)) * (rng.random((n, width)) < 0.4)
        of, column = np.nonzero(x)
        return x, T.Rows(n, of, column, x[of, column])

    (xp, p), (xu, u) = rows(7, 4), rows(20, 4)
    w, prior = rng.normal(size=5), 0.2
    up, down, rise, fall = T.risk(w, p, u, prior)
    loss = lambda z: np.log1p(np.exp(-z))
    zp, zu = xp @ w[:4] + w[4], xu @ w[:4] + w[4]
    assert abs(up - prior * loss(zp).mean()) < 1e-12
    assert abs(down - (loss(-zu).mean() - prior * loss(-zp).mean())) < 1e-12
    for k in range(5):
        e = np.eye(5)[k] * 1e-6
        a, b = T.risk(w + e, p, u, prior), T.risk(w - e, p, u, prior)
        assert abs((a[0] - b[0]) / 2e-6 - rise[k]) < 1e-6
        assert abs((a[1] - b[1]) / 2e-6 - fall[k]) < 1e-6


def test_the_negative_part_does_not_run_below_zero():
    # Every positive has a feature of its own: learning them by heart would take the second part below zero.
    n = 40
    positive = T.Rows(n, np.arange(n), np.arange(n), np.ones(n))
    unlabelled = T.Rows(400, np.array([], np.int64), np.array([], np.int64), np.array([]))
    w = T.fit(positive, unlabelled, n, 0.3)
    assert T.risk(w, positive, unlabelled, 0.3)[1] > -0.05
    assert np.isfinite(w).all()


def test_without_labels_or_rows(spark, corpus):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    none = frame(spark, [])
    model = T.train(frame(spark, corpus[:20]), empty)
    assert {round(r.score, 9) for r in T.score_documents(frame(spark, corpus[:20]), model).collect()} == {T.DEFAULT_PRIOR}
    odd = spark.createDataFrame([(None, 1), (3, None), (0, 1), (0, 1), (1, 0)], "doc_id long, toxic int")
    model = T.train(frame(spark, [*corpus[:9], (None, None), (7, None), (0, corpus[0][1])]), odd)
    assert T.score_documents(none, model).collect() == []
    assert T.train(none, odd).weights == {}
