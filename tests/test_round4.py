"""Steps whose exchanges grew faster than the input."""

from __future__ import annotations

import random

from test_round3 import same_as_sql, save


def test_khop_equals_breadth_first_search(spark, monkeypatch):
    from tessera.operators import graph as G

    monkeypatch.setattr(G, "HUB_PIECE", 3)
    rng = random.Random(6)
    # Hubs with many equal nodes, loops, repeated edges, nodes of two hubs, and a sparse rest.
    edges = [(f"s{i}", f"h{i % 3}") for i in range(30)] + [(f"d{i}", h) for i in range(7) for h in ("h0", "h1")]
    edges += [(f"x{rng.randrange(12)}", f"x{rng.randrange(12)}") for _ in range(14)] + [("h0", "r"), ("h1", "r"), ("r", "r"), ("s0", "h0"), ("x1", "s4"), ("alone", "alone")]
    around = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    starts = ["s0", "s3", "d1", "h2", "r", "x1", "x2", "alone", "unknown", "s0"]
    for hops in (0, 1, 2, 3, 4):
        want = set()
        for s in starts:
            far = {s: 0}
            for hop in range(1, hops + 1):
                for n in [m for n in list(far) for m in around.get(n, ())]:
                    far.setdefault(n, hop)
            want |= {(s, n, h) for n, h in far.items()}
        got = [tuple(r) for r in G.khop(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([(s,) for s in starts], "start string"), hops).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want, hops


def test_khop_of_suppliers_shuffles_no_pairs_and_equals_sql(spark, tmp_path):
    from tessera.plans import graph

    save(spark, tmp_path, "supplier", [(i, i % 3 if i % 10 else None) for i in range(60)] + [(None, 1), (None, None), (7, 2), (7, 2)], "s_suppkey long, s_nationkey long")
    save(spark, tmp_path, "nation", [(0, 0), (1, 1), (2, None)], "n_nationkey long, n_regionkey long")
    assert len(same_as_sql(spark, tmp_path, "khop_entities")) > 1_000
    # Pairs are made last: nothing but projections, filters and unions stand above.
    lines = graph.khop_entities(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(k for k in range(len(lines)) if "Generate explode(xs" in lines[k])
    above = []
    for line in reversed(lines[:at]):
        if depth(line) < depth((above or [lines[at]])[-1]):
            above.append(line)
    assert {x.lstrip(" :+-").split(" ")[0].split("(")[0] for x in above} <= {"Union", "Project", "Filter"}


def test_beam_walk_deals_vectors_once_and_sends_none_with_pairs(spark, tmp_path, monkeypatch):
    from tessera.operators import graph as G
    from tessera.plans import graph

    rng = random.Random(7)
    save(spark, tmp_path, "embeddings", [(i, 0, [rng.gauss(0.4, 1) for _ in range(4)]) for i in range(120)], "vec_id long, label int, embedding array<float>")
    lines = [(o, k, rng.randrange(30), rng.choice([0.0, 0.05, 0.1]), 1) for o in range(120) for k in range(5)]
    save(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double, l_suppkey long")
    turns, nouns, key = graph._vectors(spark, str(tmp_path))
    whole = G.mention_edge_ema(graph.A.mentions(spark, str(tmp_path)), turns, nouns, key, key)
    queries = graph.A.turn_vec(spark, str(tmp_path)).where("id % 50 = 0").selectExpr("id AS query", "embedding AS qv")
    rows = lambda df: sorted((*tuple(r)[:5], round(r.score, 6)) for r in df.collect())
    want = rows(G.beam_walk(graph.seeds_of_queries(spark, str(tmp_path)), whole, queries, graph.C.VECTOR_K))
    assert rows(graph.beam_walk(spark, str(tmp_path))) == want and want
    # The same with all joins by shuffle, and with no vector in an exchange if they are few: shares are dealt, not sums.
    asked = spark.createDataFrame([(n,) for n in range(9)], "tgt long")
    shares = G.mention_shares(graph.A.mentions(spark, str(tmp_path)), turns, key).join(asked, "tgt", "left_semi").repartition("tgt")
    edges = G.edges_of_shares(shares, turns, nouns, key, key, (4, 4), "tgt", False)
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "src_pole" not in plan
    monkeypatch.setattr(G, "BROADCAST_VECTORS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(graph.beam_walk(spark, str(tmp_path))) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
