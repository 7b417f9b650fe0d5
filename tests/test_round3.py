"""Queries on small tables that once gave other rows than their SQL."""

from __future__ import annotations

import collections
import random

import duckdb
from pyspark.sql import functions as F


def same_as_sql(spark, folder, name):
    """The query's rows on ``folder``, if they are those of its SQL."""
    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    got = e.queries()[name](spark, str(folder))
    rows = [tuple(r) for r in got.collect()]
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert collections.Counter(map(repr, rows)) == collections.Counter(map(repr, want))
    return rows


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))


def test_noise_reason_of_short_statements(spark, tmp_path):
    said = ["This is it, he said.", "the Ledger uses ink", "nothing to add", "Running is fun", "It was so", "ok", None, "Ledger\nis here", "x" * 40]
    save(spark, tmp_path, "conversations", [(1, i, "user" if i != 5 else None, t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    got = dict(same_as_sql(spark, tmp_path, "turn_noise_reason"))
    assert got[1000] is None and got[1003] is None and got[1002] == "short_user_without_assertion"


def test_orphans_are_checked_against_all_orders(spark, tmp_path):
    save(spark, tmp_path, "customer", [(i,) for i in range(6)], "c_custkey long")
    save(spark, tmp_path, "orders", [(1, 1), (13, 2), (24, 3)], "o_orderkey long, o_custkey long")
    assert {r[0] for r in same_as_sql(spark, tmp_path, "orphan_chunks")} == {"c0", "c4", "c5"}


def test_inferred_links_count_nouns_of_one_vector_alone(spark, tmp_path):
    rng = random.Random(5)
    # All vectors are alike, so cosines would pair every noun with every other.
    save(spark, tmp_path, "embeddings", [(i, 0, [1.0, 2.0]) for i in range(7)], "vec_id long, label int, embedding array<float>")
    lines = [(o, k, rng.randrange(60), 0.0, 1) for o in range(80) for k in range(4)]
    save(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double, l_suppkey long")
    assert same_as_sql(spark, tmp_path, "inferred_links")[0][0] > 0


def test_references_count_every_document(spark):
    from tessera.llm import quality_rules

    rng = random.Random(8)
    words = [f"word{k}" for k in range(60)]
    # The last documents speak of other things than the rest, so no part of them gives the same shares.
    texts = [" ".join(rng.choices(words if i < 2_200 else [*words, "rare"], k=130)) for i in range(2_600)]
    got = quality_rules.learn_references(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    for w, share in zip(got.vocabulary, got.words[0], strict=False):
        assert abs(share - sum(t.split().count(w) for t in texts) / 130 / len(texts)) < 1e-9


def test_edges_need_no_row_for_each_dimension_and_walks_take_them_on_demand(spark):
    from tessera.operators import graph as G

    rng = random.Random(9)
    mentions = spark.createDataFrame([(t, i, rng.randrange(12), 1.0 - rng.random() / 2) for t in range(40) for i in range(4)], "turn long, mention_index int, noun_id long, conf double")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(5)]
    turns, nouns = spark.createDataFrame(vectors, "turn long, v array<double>"), spark.createDataFrame(vectors, "noun_id long, v array<double>")
    key = lambda c: c % 5
    edges = G.mention_edge_ema(mentions, turns, nouns, key, key)
    plan = edges.select("src", "tgt", F.get("tgt_pole", F.lit(0)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_x1" not in plan and "_x0" in plan
    # The same as with a vector for each turn and noun.
    wide = lambda name, n: spark.createDataFrame([(i, vectors[i % 5][1]) for i in range(n)], f"{name} long, v array<double>")
    rows = lambda df: sorted([round(y, 9) for y in x] if isinstance(x, list) else x for x in map(tuple, df.orderBy("src", "tgt").collect()))
    assert rows(edges) == rows(G.mention_edge_ema(mentions, wide("turn", 40), wide("noun_id", 12)))
    seeds = spark.createDataFrame([(0, n, 10 * n, 0.9) for n in range(4)], "query long, noun long, turn long, similarity double")
    queries = spark.createDataFrame([(0, vectors[0][1])], "query long, qv array<double>")
    shares = G.mention_shares(mentions, turns, key)
    asked = lambda wanted, end: G.edges_of_shares(shares.join(wanted.withColumnRenamed("noun", end), end, "left_semi"), turns, nouns, key, key)
    got, want = (sorted(map(tuple, G.beam_walk(seeds, e, queries, 4).collect())) for e in (asked, edges))
    assert got == want and got


def test_names_of_many_suppliers_are_linked_once(spark, tmp_path):
    names = [f"Supplier#{i % 40:09d}" for i in range(100)] + ["Supplier", "other firm", None, "Supplier#000000001 Supplier"]
    save(spark, tmp_path, "supplier", list(enumerate(names)), "s_suppkey long, s_name string")
    same_as_sql(spark, tmp_path, "entity_link_trigram")
    from tessera.operators import search

    terms, rows = spark.createDataFrame([(n,) for n in names[:3]], "term string"), spark.createDataFrame([(i, n) for i, n in enumerate(names)], "entity_id long, name string")
    for k in (1, 3, 50, 500):
        got = {(r.term, r.entity_id, r.similarity) for r in search.trigram_top(terms, rows, k).collect()}
        every = sorted((r.term, -r.similarity, r.entity_id) for r in search.trigram_links(terms, rows).collect())
        assert got == {(t, i, -s) for t in names[:3] for _, s, i in [r for r in every if r[0] == t][:k]}


def test_products_are_made_some_rows_at_a_time(spark, monkeypatch):
    from tessera.functions import vectors

    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(5)] + [(200, [0.0] * 4)], "id long, v array<double>")
    rows = lambda: sorted((r.id, r.other, round(r.cosine, 12)) for r in vectors.block_pairs(v, v, -1.0, top=3, blocks=2).collect())
    assert vectors.BLOCK_ROWS * vectors.BLOCK_ROWS > 64 * vectors.CELLS
    whole = rows()
    monkeypatch.setattr(vectors, "CELLS", 1)
    assert rows() == whole


def test_hubs_are_joined_in_pieces(spark, monkeypatch):
    from tessera.operators import graph as G

    monkeypatch.setattr(G, "HUB_PIECE", 3)
    edges = spark.createDataFrame([(f"s{i}", f"n{i % 2}") for i in range(30)] + [("n0", "r"), ("n1", "r")], "a string, b string")
    start = spark.createDataFrame([("s0",), ("s1",)], "start string")
    got = {tuple(r) for r in G.khop(edges, start, 2).collect()}
    assert got == {(f"s{k}", n, h) for k in (0, 1) for n, h in [(f"s{k}", 0), (f"n{k}", 1), ("r", 2), *[(f"s{i}", 2) for i in range(k, 30, 2) if i != k]]}
