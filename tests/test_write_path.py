"""Deletion, merging, back-tests, recall and the read path against plain versions."""

from __future__ import annotations

import collections
import datetime as dt
import hashlib
import math
import random
import re

import pytest

from tessera.functions import text as X
from tessera.operators import backtest, cascade, merge, prefetch, recall
from pyspark.sql import functions as F

REFS = "child string, child_id string, parent string, parent_id string, action string"


def plain_closure(refs, seeds):
    refs = {r for r in refs if r[1] is not None and r[3] is not None}
    gone = set(seeds)
    while True:
        new = {(c, i) for c, i, p, j, a in refs if a == "cascade" and (p, j) in gone}
        held = collections.defaultdict(set)
        for c, i, p, j, a in refs:
            if a == "support":
                held[c, i].add((p, j))
        new |= {row for row, parents in held.items() if parents <= gone}
        if new <= gone:
            break
        gone |= new
    lost = {(c, i, "unlink", f"{p}:{j}") for c, i, p, j, a in refs if a == "unlink" and (p, j) in gone and (c, i) not in gone}
    return {(r, i, "delete", None) for r, i in gone} | lost


@pytest.mark.parametrize("seed", range(3))
def test_deletion_closure_is_the_fixpoint(spark, seed):
    rng = random.Random(seed)
    names, refs = ["a", "b", "c"], []
    for _ in range(160):
        refs.append((rng.choice(names), str(rng.randrange(25)), rng.choice(names), str(rng.randrange(25)), rng.choice(["cascade", "unlink", "support", "support", "support"])))
    refs += [("a", None, "b", "1", "cascade"), ("a", "1", "b", None, "cascade"), refs[0], ("a", "100", "a", "101", "cascade"), ("a", "101", "a", "100", "cascade")]
    refs += [("d", str(i + 1), "d", str(i), "cascade") for i in range(7)]
    seeds = [("a", "3"), ("b", "4"), ("d", "0"), ("a", "100")]
    df = spark.createDataFrame(refs, REFS)
    got = {tuple(r) for r in cascade.deletion_closure(df, spark.createDataFrame([*seeds, ("a", None), seeds[0]], "relation string, id string")).collect()}
    assert got == plain_closure(refs, seeds)
    # What is left refers to nothing that went, so a second run finds the seeds alone.
    gone = {(r, i) for r, i, deed, _ in got if deed == "delete"}
    left = [r for r in refs if (r[0], r[1]) not in gone and (r[2], r[3]) not in gone]
    again = cascade.deletion_closure(spark.createDataFrame(left, REFS), spark.createDataFrame(seeds, "relation string, id string")).collect()
    assert {(r.relation, r.id) for r in again} == set(seeds)
    assert cascade.deletion_closure(df, spark.createDataFrame([], "relation string, id string")).count() == 0


def test_merging_folds_every_relation_and_is_idempotent(spark):
    keepers = spark.createDataFrame([(2, 1), (3, 1), (1, 1), (None, 1), (9, None)], "id long, keeper long")
    nodes = spark.createDataFrame([(1, 2.0), (2, 3.0), (4, 1.0), (9, 7.0), (None, 1.0)], "id long, weight double")
    edges = spark.createDataFrame([(2, 4, 1.0), (3, 4, 5.0), (1, 2, 9.0), (4, 3, None), (4, 1, 0.5)], "src long, dst long, weight double")
    aliases = spark.createDataFrame([("x", 2, 1), ("x", 4, 2), ("y", 3, 5), ("y", 3, 5)], "surface string, id long, seen int")
    relations = lambda n, e, a: {
        "node": merge.Relation(n, ("id",), ("id",), {"weight": F.sum("weight")}),
        "edge": merge.Relation(e, ("src", "dst"), ("src", "dst"), {"weight": F.max("weight")}, loops=False),
        "alias": merge.Relation(a, ("id",), ("surface",), {"id": merge.last_by("id", "seen"), "seen": F.max("seen")}),
    }
    once = merge.merge_entities(keepers, relations(nodes, edges, aliases))
    plain = {k: sorted(map(tuple, v.collect()), key=repr) for k, v in once.items()}
    assert plain["node"] == sorted([(1, 5.0), (4, 1.0), (9, 7.0), (None, 1.0)], key=repr)
    assert plain["edge"] == [(1, 4, 5.0), (4, 1, 0.5)]
    assert plain["alias"] == [("x", 4, 2), ("y", 1, 5)]
    twice = merge.merge_entities(keepers, relations(once["node"], once["edge"], once["alias"]))
    assert {k: sorted(map(tuple, v.collect()), key=repr) for k, v in twice.items()} == plain


def test_backtest_controls_are_of_like_degree(spark):
    rng = random.Random(3)
    ids = list(range(300))
    known = {tuple(sorted(rng.sample(ids[:200], 2))) for _ in range(400)}
    later = {tuple(sorted(rng.sample(ids, 2))) for _ in range(600)} - known
    predicted = {tuple(sorted(rng.sample(ids, 2))) for _ in range(200)} | set(list(later)[:60]) | set(list(known)[:9])
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "a long, b long")
    got = backtest.link_backtest(frame(predicted), spark.createDataFrame([(i,) for i in ids], "id long"), frame(known), frame(later)).first()
    degree = collections.Counter(x for p in known for x in p)
    level = {i: int(math.log2(degree[i] + 1)) for i in ids}
    sizes = collections.Counter(level.values())
    md5 = {i: hashlib.md5(str(i).encode()).hexdigest() for i in ids}
    pools = collections.defaultdict(list)
    for i in ids:
        pools[level[i], int(md5[i][:8], 16) % -(-sizes[level[i]] // backtest.POOL)].append(i)
    partner = {}
    for members in pools.values():
        members.sort(key=lambda i: (md5[i], i))
        partner.update(zip(members, members[1:] + members[:1], strict=True))
    candidates = predicted - known
    controls = [tuple(sorted((a, partner[b]))) for a, b in candidates if a != partner[b]]
    controls = [p for p in controls if p not in known]
    assert (got.candidates, got.confirmed) == (len(candidates), len(candidates & later))
    assert (got.controls, got.chance) == (len(controls), sum(p in later for p in controls))
    assert abs(got.lift - (got.confirmed / got.candidates) / (got.chance / got.controls)) < 1e-9


@pytest.mark.parametrize("part", [2, 20_000])
def test_holders_equal_a_search_of_every_text(spark, monkeypatch, part):
    monkeypatch.setattr(recall, "PART", part)
    rng = random.Random(part)
    words = ["Red", "blue", "GREEN", "x-ray", "under_score", "it's", "the", "the"]
    texts = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(60)] + [(60, None), (61, ""), (1, "the red"), (62, "the " * 50_000 + "end")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for i in range(25)] + [(90, ""), (91, None), (92, "!?"), (93, "absent word"), (94, "end"), (0, "the")]
    norm = lambda s: re.sub(" +", " ", re.sub("[^a-z0-9 ]", "", re.sub(r"[\s_\-]+", " ", s.lower()))).strip()
    want = {(j, i) for j, needle in items if needle and norm(needle) for i, t in texts if t is not None and f" {norm(needle)} " in f" {norm(t)} "}
    docs, asked = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(items, "item long, text string")
    found = recall.holders(docs, asked)
    assert {tuple(r) for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert recall.holders(docs.where("false"), asked).count() == 0


def test_answer_quality(spark):
    shown = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z"), (2, "z"), (4, "x")], "question long, name string")
    wanted = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b"), (3, "c"), (1, "a")], "question long, name string")
    foreign = spark.createDataFrame([("z",)], "name string")
    got = recall.answer_quality(shown, wanted, foreign).first()
    assert (got.questions, got.leaked, got.empty) == (3, 2, 1)
    assert got.recall == 1 / 4
    assert got.noise == (2 + 1 + 0) / 3


def test_read_path_steps(spark):
    at = dt.datetime(2026, 1, 1)
    say = lambda i, role, text, v, owner="o", m=0: (i, owner, "s", at + dt.timedelta(minutes=m or i), role, text, v)
    long_ = "word " * 100
    turns = [say(1, "user", "<b>near & dear</b>", [1.0, 0.0]), say(2, "assistant", "so it is", [0.9, 0.1]), say(3, "user", "that's wrong", [0.0, 1.0]), say(4, "user", "password: hunter2hunter2", [1.0, 0.0]), say(5, "user", "theirs", [1.0, 0.0], "p"), say(6, "user", None, [0.8, 0.0])]
    t = spark.createDataFrame(turns, "id long, owner string, session_id string, ts timestamp, role string, content string, v array<double>")
    chunks = spark.createDataFrame([(7, "", "", long_, [1.0, 0.05])], "id long, owner string, session_id string, content string, v array<double>")
    evidence = spark.createDataFrame([(2, "l:1", "assert"), (2, "l:2", "assert"), (2, "l:9", "retract"), (2, "l:8", "retract"), (2, "l:7", "retract")], "span_id long, object_key string, act string")
    q = spark.createDataFrame([(50, "o", [1.0, 0.0]), (100, "o", [0.0, -1.0])], "id long, owner string, v array<double>")
    got = {(r.src, r.id): r for r in prefetch.prefetch(q, t, chunks, evidence).collect()}
    assert set(got) == {("turn", 1), ("turn", 2), ("turn", 6), ("chunk", 7)}
    assert got["turn", 1].line == '<span id="turn:1" role="user" score="1.000">&lt;b&gt;near &amp; dear&lt;/b&gt;</span>'
    two = got["turn", 2]
    assert (two.prev_id, two.next_id, two.uptake, two.live_claims, two.retracted) == (1, 3, "repaired", 2, "l:7,l:8")
    assert got["turn", 6].prev_id is None
    assert (got["chunk", 7].role, got["chunk", 7].uptake) == ("doc", None)
    # Forty tokens for the frame, 12 and 9 for two hits: the long chunk and then ten more don't fit.
    few = prefetch.prefetch(q, t, chunks, evidence, tokens=70).orderBy("rank").collect()
    assert [(r.src, r.id) for r in few] == [("turn", 1), ("turn", 6)]


def test_long_names_take_no_time():
    assert X.assertions("A" * 40 + "_x is a good thing") == []
    assert X.assertions("A" * 200_000 + "_x is a good thing") == []
    assert X.rejection("Pipeline", "green") == "pronoun or process"
    assert [X.rejection("Foo", o) for o in ("", "a `b`", "Working", "a, b", "on V2", "TODO fix it", "not it", "fine")] == ["empty", "quoting", "state", "list", "version", "heading", "negated", None]
    assert [X.rejection(s, "fine") for s in ("foo", "ABC Foo", "Using Foo", "Foo Bar")] == ["not a name", "acronym first", "activity first", None]
