"""Order statistics, trailing dedup and the pole mean against plain versions."""

from __future__ import annotations

import collections
import datetime as dt
import math
import random

import pytest

from tessera.operators import graph, selection, turns

TURN = "id long, owner string, session_id string, role string, content string, ts timestamp, key string, at string, kept_id string"


@pytest.mark.parametrize("few", [4, 10_000])
def test_order_statistics_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "CELLS", 4)
    rng = random.Random(few)
    rows = [("ties", rng.choice([1.0, 2.0, 2.0, 2.0, 9.0])) for _ in range(400)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(300)]
    rows += [(None, float(i)) for i in range(11)] + [("one", 5.0), ("nulls", None), ("ties", None), ("same", 3.0), ("same", 3.0)]
    rows += [("odd", float("nan")), ("odd", float("inf")), ("odd", -0.5), ("odd", float("-inf"))]
    shares = [0.0, 0.5, 0.95, 0.99, 1.0]
    got = {(r.g, r.share): (r.n, r.found) for r in selection.order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    groups = collections.defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    assert {g for g, _ in got} == set(groups)
    for g, vs in groups.items():
        vs.sort(key=lambda v: (math.isnan(v), v))
        for s in shares:
            n, found = got[g, s]
            want = vs[round(s * (len(vs) - 1))]
            assert n == len(vs)
            assert found == want or (math.isnan(found) and math.isnan(want))
    assert selection.order_statistics(spark.createDataFrame([], "g string, v double"), ["g"], "v", shares).count() == 0


def plain_dedup(rows, width, least):
    """kept id by id, in order, for each key."""
    state, out = {}, []
    for i, owner, session, role, content, ts, *_ in sorted(set(rows), key=lambda r: (r[5] is None, r[5] or 0, r[0])):
        key = owner, session, role, content
        if content is None or len(content) < least or ts is None:
            out.append((i, i))
        elif key in state and ts - state[key][0] < width:
            out.append((i, state[key][1]))
        else:
            state[key] = ts, i
            out.append((i, i))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_dedup_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    base, rows = dt.datetime(2026, 1, 1), []
    for i in range(700):
        dense = i % 2
        seconds = rng.randrange(40_000) if dense else rng.randrange(600) * 300
        key = ("o", "s", "user", "x" * 90) if dense else (rng.choice(["o", None]), rng.choice(["s", None]), rng.choice(["user", None]), rng.choice(["y" * 80, "short", None]))
        rows.append((i, *key, None if i % 50 == 0 else base + dt.timedelta(seconds=seconds, microseconds=rng.choice([0, 0, 1, 999_999])), "clash", "clash", "clash"))
    got = sorted((r.id, r.kept_id) for r in turns.dedup_trailing(spark.createDataFrame([*rows, rows[1]], TURN)).distinct().collect())
    assert got == plain_dedup(rows, dt.timedelta(minutes=10), 80)


def test_trailing_dedup_of_a_key_with_many_turns(spark):
    n = 200_000
    rows = spark.range(n, numPartitions=8).selectExpr("id", "'o' as owner", "'s' as session_id", "'user' as role", "repeat('x', 90) as content", "timestamp_micros(1767225600000000 + id * 1000000) as ts")
    got = turns.dedup_trailing(rows)
    assert got.where("kept_id <> id - id % 600").count() == 0
    assert got.count() == n
    assert turns.dedup_trailing(rows.where("false")).count() == 0


def test_pole_is_the_fold_over_mentions(spark):
    rng = random.Random(9)
    vectors = {t: [rng.uniform(-1, 1) for _ in range(3)] for t in range(40)}
    del vectors[7]
    mentions = [(t, i, rng.choice([1, 2, 3]), rng.choice([0.01, 0.2, 0.3, 0.9]), 0) for t in range(40) for i in range(4)] + [(5, 9, None, 0.5, 0), (None, 0, 1, 0.5, 0)]
    m = spark.createDataFrame(mentions, "turn long, mention_index int, noun_id long, conf double, chunk_id long")
    tv = spark.createDataFrame([*vectors.items(), (8000, None)], "turn long, v array<double>")
    nv = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "noun_id long, v array<double>")
    got = {(r.src, r.tgt): r for r in graph.mention_edge_ema(m, tv, nv).collect()}
    steps = collections.defaultdict(list)
    for t in range(40):
        own = sorted((i, n, c) for tt, i, n, c, _ in mentions if tt == t and n is not None)
        for (_, a, c), (_, b, _) in zip(own, own[1:]):
            if a != b and t in vectors:
                steps[a, b].append((t, c))
    steps = {k: sorted(v) for k, v in steps.items() if k[0] != 3}
    assert set(got) == set(steps)
    for k, own in steps.items():
        pole = vectors[own[0][0]]
        for t, c in own[1:]:
            a = min(max(c, 0.05), 0.4)
            pole = [(1 - a) * x + a * y for x, y in zip(pole, vectors[t])]
        assert all(abs(x - y) < 1e-12 for x, y in zip(pole, got[k].tgt_pole, strict=True))
        assert got[k].provenance == [t for t, _ in own][:32]
        assert abs(got[k].magnitude - min(8.0, sum(c for _, c in own))) < 1e-12
