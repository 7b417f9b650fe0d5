"""Steps that once held or moved more than they need."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_round3 import same_as_sql, save


def test_claims_of_one_vector_are_searched_once(spark, monkeypatch):
    from tessera.operators import hybrid

    searched = []
    real = hybrid.search.batch_search
    monkeypatch.setattr(hybrid.search, "batch_search", lambda q, rows, *a: searched.append(rows.count()) or real(q, rows, *a))
    v = {0: [1.0, 0.0], 1: [1.0, 0.1], 2: [2.0, 0.0], 3: [0.0, 1.0]}
    claims = [(c, c * 7 % 4) for c in range(200)]
    vectors = spark.createDataFrame([*v.items(), (9, [1.0, 0.0])], "k long, v array<double>")
    queries = spark.createDataFrame([(-1, [1.0, 0.0]), (-2, [0.0, 1.0])], "id long, v array<double>")
    got = hybrid.nearest_claims(queries, spark.createDataFrame(claims, "claim long, k long"), vectors, 60)
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for q in queries.collect():
        want = [c for _, c in sorted((-cos(q.v, v[k]), c) for c, k in claims)][:60]
        assert [r.claim for r in got.where(F.col("query") == q.id).orderBy("rank").collect()] == want
    assert searched == [4]


def test_walk_ranks_the_edges_of_its_frontier_alone(spark):
    from tessera.operators import graph as G

    rng = random.Random(3)
    claims = spark.createDataFrame([(i, f"c{rng.randrange(30)}", f"p{rng.randrange(40)}", rng.randrange(5) / 10) for i in range(400)], "claim_id long, subject string, object string, distance double")
    start = spark.createDataFrame([("c1",), ("c2",)], "start string")
    asked = []

    def edges(nodes):
        asked.append(nodes.count())
        return G.claim_edges(claims, nodes=nodes)

    assert set(map(tuple, G.claim_walk(start, edges).collect())) == set(map(tuple, G.claim_walk(start, G.claim_edges(claims)).collect()))
    assert asked[0] == 2


def test_lexical_query_counts_a_token_of_an_entity_once(spark, tmp_path):
    rng = random.Random(2)
    words = ["red", "blue", "bolt", "ring", "France"]
    # Some parts are there twice, with one name or with two.
    rows = [(rng.randrange(40), " ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.randrange(3)) for _ in range(80)]
    save(spark, tmp_path, "part", [*rows, *rows[:20]], "p_partkey long, p_name string, p_size int")
    save(spark, tmp_path, "nation", [(1, "France"), (2, "Blue bolt")], "n_nationkey int, n_name string")
    assert len(same_as_sql(spark, tmp_path, "lexical_query")) > 15


def tasks_of(df):
    df.collect()
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("step", ["degree", "mentions", "aliases"])
def test_tasks_grow_with_the_rows(spark, monkeypatch, tmp_path, step):
    from tessera.functions import scratch
    from tessera.operators import entities
    from tessera.operators import graph as G
    from tessera.sources import adapters as A

    lines = [(o, k, (o * 3 + k) % 17, o % 5, 0.5, "R") for o in range(60) for k in range(3)]
    save(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_returnflag string")
    save(spark, tmp_path, "orders", [(o, o % 7, None) for o in range(60)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    links = spark.createDataFrame([(f"p{i}", f"p{i + 1 if i % 5 else i - 4}", i % 3) for i in range(5, 120)], "surface string, canon string, born int")
    make = {"degree": lambda: A.edges(spark, str(tmp_path)).select("subject", "object"), "mentions": lambda: G.mention_edges(A.mentions(spark, str(tmp_path))), "aliases": lambda: entities.resolve_aliases(links)}[step]
    want = sorted(map(tuple, make().collect()))
    monkeypatch.setattr(scratch, "TASK_ROWS", 20)
    got = make()
    assert sorted(map(tuple, got.collect())) == want
    assert tasks_of(got) > 4


def test_vectors_of_pairs_go_once_to_each_cell(spark, monkeypatch):
    from tessera.functions import vectors as V

    monkeypatch.setattr(V, "STRETCH", 4)
    v = {i: [float(i % 3), 1.0, float(i)] for i in range(12)} | {12: None, 13: [], 14: [0.0, 0.0, 0.0], 15: [1.0, 2.0]}
    pairs = [(a, b) for a in range(17) for b in range(17) if (a + b) % 2 == 0]
    table = spark.createDataFrame(list(v.items()), "id long, v array<float>")
    got = {(r.a, r.b): r.cosine for r in V.cosines_of_pairs(spark.createDataFrame(pairs, "a long, b long"), table).collect()}
    assert set(got) == {(a, b) for a, b in pairs if a in v and b in v}
    for (a, b), c in got.items():
        x, y = (np.array(v[k] or [], float) for k in (a, b))
        good = len(x) and len(x) == len(y) and x.any() and y.any()
        assert c is None if not good else c == pytest.approx(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)))


def test_names_are_looked_for_in_sentences_with_a_phrase_alone(spark):
    from tessera.operators import relations as R

    rows = spark.createDataFrame([(1, "red bolt is here. Red bolt RELIES, on blue ring!", 0), (1, "blue ring needsit red bolt", 1), (1, "Blue ring needs red bolt", 2)], "id long, text string, part int")
    assert {r.sentence for r in R.phrases(rows, [2], ["relies on", "needs"]).collect()} == {(0, 1), (2, 0)}
    names = spark.createDataFrame([("Red bolt",), ("blue ring",)], "name string")
    assert sorted(map(tuple, R.typed_relations(rows, names).collect())) == [(1, "blue ring", "depends_on", "red bolt"), (1, "red bolt", "uses", "blue ring")]


def test_an_index_makes_some_rows_at_a_time(spark, monkeypatch):
    from tessera.operators import vector_index as I

    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "id long, v array<double>").coalesce(1)
    index = I.build(rows, cells=6)
    want = [sorted(map(tuple, f().collect())) for f in (lambda: I.nearest_cells(rows.select("id", "v"), index.centroids, 4).select("id", "cell", "nearness"), lambda: I.search(index, rows, 5, 6).select("id", "other", "rank"))]
    monkeypatch.setattr(I, "MADE_ROWS", 8)
    monkeypatch.setattr(I, "CELLS", 12)
    assert sorted(map(tuple, I.nearest_cells(rows.select("id", "v"), index.centroids, 4).select("id", "cell", "nearness").collect())) == want[0]
    assert sorted(map(tuple, I.search(index, rows, 5, 6).select("id", "other", "rank").collect())) == want[1]


def test_a_deletion_reads_the_references_of_a_relation_once(spark, monkeypatch):
    from tessera.operators import cascade

    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for pdf in parts:
            read.add(len(pdf))
            yield pdf

    # A chain of twelve owners; orders of all of them; a note goes with its last order.
    owners = spark.createDataFrame([(i + 1, i) for i in range(12)], "child_id long, parent_id long")
    orders = spark.createDataFrame([(100 + i, i % 20) for i in range(40)], "child_id long, parent_id long").mapInPandas(counted, "child_id long, parent_id long")
    notes = spark.createDataFrame([(f"n{i % 15}", 100 + i) for i in range(40)], "child_id string, parent_id long").mapInPandas(counted, "child_id string, parent_id long")
    refs = [cascade.Reference("owner", "owner", owners, cascade.CASCADE), cascade.Reference("order", "owner", orders, cascade.CASCADE), cascade.Reference("note", "order", notes, cascade.SUPPORT)]
    seeds = spark.createDataFrame([("owner", 3)], "relation string, id long")
    gone = {i for i in range(40) if 3 <= i % 20 <= 12}
    want = {("owner", str(i)) for i in range(3, 13)} | {("order", str(100 + i)) for i in gone} | {("note", f"n{k}") for k in range(15) if {i for i in range(40) if i % 15 == k} <= gone}
    for most in (250_000, 0):
        monkeypatch.setattr(cascade, "BROADCAST_GONE", most)
        start = read.value
        out = cascade.deletion_closure(refs, seeds)
        assert {(r.relation, r.id) for r in out.collect()} == want
        assert read.value - start == 80


def test_cascade_delete_of_odd_rows(spark, tmp_path, monkeypatch):
    from tessera.operators import cascade

    monkeypatch.setattr(cascade, "BROADCAST_GONE", 1)
    rng = random.Random(6)
    save(spark, tmp_path, "customer", [(i,) for i in range(160)], "c_custkey long")
    # Orders of customers that are not known, lines twice, lines of one number in two parts.
    save(spark, tmp_path, "orders", [(i, rng.choice([0, 50, 150, rng.randrange(400)])) for i in range(300)], "o_orderkey long, o_custkey long")
    lines = [(rng.randrange(300), rng.randrange(3), rng.randrange(25)) for _ in range(500)]
    save(spark, tmp_path, "lineitem", [*lines, *lines[:9]], "l_orderkey long, l_linenumber int, l_partkey long")
    save(spark, tmp_path, "events", [(i, rng.choice([None, *range(160)])) for i in range(200)], "event_id long, user_id long")
    rows = same_as_sql(spark, tmp_path, "cascade_delete")
    assert {r[0] for r in rows} >= {"customer", "orders", "lineitem", "claim", "event"}


def test_names_meet_by_two_of_their_rarest_grams(spark, monkeypatch):
    from tessera.operators import search

    names = [f"supplier#{i:09d}" for i in range(2_000)]
    terms = [*names[::100], *(n.replace("pp", "p") for n in names[::100])]
    table = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    index = search._gram_index(table(terms, "term"), table(names, "name"))
    # By one of the grams that may miss all names met, as all share those of the zeros.
    assert 0 < search._met(*index, 0.7).count() < len(terms) * len(names) / 10

    rng = random.Random(8)
    words = [" ".join("".join(rng.choice("abc1") for _ in range(rng.randrange(1, 7))) for _ in range(rng.choice([1, 1, 2, 6]))) for _ in range(150)]
    grams = lambda s: {("  " + w + " ")[i : i + 3] for w in s.split() for i in range(len(w) + 1)}
    asked = [*words[:40], "zzz abc", "b"]
    for floor, most in ((0.3, 24), (0.6, 4), (0.9, 24)):
        monkeypatch.setattr(search, "MOST_PAIRED", most)
        want = {(a, b) for a in asked for b in words if round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6) >= floor}
        assert {(r.term, r.name) for r in search.trigram_links(table(asked, "term"), table(words, "name").selectExpr("1 as entity_id", "name"), floor).collect()} == want


def test_entity_link_searches_a_shared_vector_once(spark, tmp_path, monkeypatch):
    from tessera.operators import search

    searched = []
    real = search.batch_search
    monkeypatch.setattr(search, "batch_search", lambda q, rows, *a: searched.append((q.count(), rows.count())) or real(q, rows, *a))
    # Names that many have, odd ones, and more like each than are shown.
    names = [f"Supplier#{i % 90:09d}" for i in range(240)] + ["Supplier", None, "?", "vendor 59", "suplier 000000050", "Vendor 9"]
    save(spark, tmp_path, "supplier", list(enumerate(names)), "s_suppkey long, s_name string")
    save(spark, tmp_path, "embeddings", [(i, 0, [1.0, float(i % 5), float(i)]) for i in range(9)], "vec_id long, label int, embedding array<float>")
    rows = same_as_sql(spark, tmp_path, "entity_link")
    assert len(rows) == 5 * 20 and {r[2] for r in rows} >= {1, 2}
    assert searched == [(5, 9)]
