"""Block products on bad vectors, and the index against the exact scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import search, vector_index

ROW = "id long, v array<double>"


def test_block_pairs_pass_over_bad_vectors_and_other_sizes(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [1.0, None]), (6, [0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [0.9, 0.0, 0.1])]
    df = spark.createDataFrame(rows, ROW)
    got = {(r.id, r.other) for r in vectors.block_pairs(df, df, 0.5, undirected=True).collect()}
    assert {tuple(sorted(p)) for p in got} == {(1, 2), (7, 8)}
    assert {(r.id, r.other) for r in search.batch_search(df, df, 5).collect()} == {(1, 2), (2, 1), (7, 8), (8, 7)}
    assert vectors.block_pairs(df.where("false"), df, 0.5).count() == 0


def test_blocks_follow_from_counts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(95)], ROW)
    assert vectors.blocks_of(df) == 10
    assert vectors.blocks_of(df.limit(3), least=1) == 1
    few = sorted(map(tuple, vectors.block_pairs(df, df, 0.7, blocks=1).select("id", "other").collect()))
    assert sorted(map(tuple, vectors.block_pairs(df, df, 0.7).select("id", "other").collect())) == few


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 3
    # A third of the rows in one cluster.
    of = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 30, 3000))
    return [(i, (centres[c] + rng.normal(size=16)).tolist()) for i, c in enumerate(of)]


def test_index_reaches_its_recall_and_reads_a_part(spark, monkeypatch, clustered):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 200)
    df = spark.createDataFrame([*clustered, (9001, None), (9002, []), (9003, [1.0])], ROW)
    index = vector_index.build(df)
    assert index.rows.count() == len(clustered)
    assert index.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 400
    queries = df.where("id % 50 = 0")
    curve = vector_index.recall_curve(index, queries, 10)
    probes, recall, share = vector_index.choose_probes(curve, 0.95)
    assert recall >= 0.95
    assert share < 0.5
    exact = {(r.id, r.other) for r in search.batch_search(queries, df, 10).collect()}
    found = {(r.id, r.other) for r in vector_index.search(index, queries, 10, probes).collect()}
    # All queries are measured here, so the curve's recall is that of the search.
    assert abs(len(exact & found) / len(exact) - recall) < 1e-9
    every = vector_index.search(index, queries, 10, len(index.centroids))
    assert {(r.id, r.other) for r in every.collect()} == exact
    assert {(r.id, r.other, r.rank) for r in every.collect()} == {(r.id, r.other, r.rank) for r in search.batch_search(queries, df, 10).collect()}


def test_index_of_nothing(spark):
    index = vector_index.build(spark.createDataFrame([(1, None)], ROW))
    assert index.rows.count() == 0
    assert len(index.centroids) == 0


def test_arms_equal_a_plain_ranking(spark, clustered):
    rows = [(i, f"o{i % 3}", f"s{i % 5}", v, ("memory", "chunk")[i % 2]) for i, v in clustered[:200]]
    df = spark.createDataFrame(rows, "id long, owner string, session_id string, v array<double>, src string")
    queries = df.where("id < 10").select("id", "owner", "v")
    arms = {"memory": (df.where("src = 'memory'"), True), "chunk": (df.where("src = 'chunk'"), False)}
    got = {(r.query, r.rank): (r.src, r.id) for r in search.batch_arms(queries, arms, 4).collect()}
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for q, owner, _, qv, _ in rows[:10]:
        parts = []
        for src in ("memory", "chunk"):
            near = sorted((-cos(qv, v), src, i) for i, o, _, v, s in rows if s == src and i != q and (src == "chunk" or o == owner))
            parts += near[:4]
        want = [(src, i) for _, src, i in sorted(parts)[:4]]
        assert [got[q, k] for k in range(1, 5)] == want
