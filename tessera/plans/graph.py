"""Queries on the graphs: mentions, claims, catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions.scratch import cut_lineage, keep, sent_if_few
from tessera.operators import graph as G
from tessera.plans.readpath import seeds_of_queries
from tessera.plans.registry import query
from tessera.sources import adapters as A

#: Nouns of a hop that are sent to all tasks at most.
BROADCAST_NOUNS = 500_000
PAIRS = "pr AS (SELECT * FROM (SELECT noun_id AS src, lead(noun_id) OVER (PARTITION BY turn ORDER BY mention_index, noun_id, conf) AS tgt, turn, conf FROM mentions) WHERE tgt IS NOT NULL AND src<>tgt AND conf>0)"
ME = ("mentions",)
EDGE2 = "b2 AS (SELECT subject AS source, object AS neighbor, claim_id, distance FROM edges UNION ALL SELECT object, subject, claim_id, distance FROM edges), e2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, claim_id, neighbor) AS node_rank FROM b2) WHERE node_rank<=8)"


def _vectors(spark, sf_dir):
    """Vectors of turns and of nouns, and the key of both: row id mod the number of embeddings."""
    e = A.turn_vec(spark, sf_dir)
    n = A.read(spark, sf_dir, "embeddings").count()
    return e.select(F.col("id").alias("turn"), F.col("embedding").alias("v")), e.select(F.col("id").alias("noun_id"), F.col("embedding").alias("v")), lambda c: c % n


@query(f"WITH {PAIRS} SELECT src, tgt, round(least(8.0, sum(conf)),6) AS magnitude, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM pr GROUP BY 1,2", ME)
def mention_edges(spark, sf_dir):
    return G.mention_edges(A.mentions(spark, sf_dir)).withColumn("magnitude", F.round("magnitude", 6))


@query(
    f"""WITH m AS (SELECT count(*) AS n FROM turn_vec), {PAIRS},
    o AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY turn, conf) AS k FROM pr), a AS (SELECT *, CASE WHEN k=1 THEN 1.0 ELSE least(greatest(conf,0.05),0.4) END AS a FROM o),
    w AS (SELECT *, a*exp(coalesce(sum(CASE WHEN k>1 THEN ln(1-a) END) OVER (PARTITION BY src, tgt ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)) AS w FROM a)
    SELECT w.src, w.tgt, round(least(8.0,sum(conf)),6) AS magnitude, max(turn) AS last_active_turn, CAST(least(count(*),32) AS INT) AS n_provenance, round(sum(w*t.embedding[1]),6) AS pole0, round(sum(w*t.embedding[64]),6) AS pole63
    FROM w, m, turn_vec t WHERE t.id=w.turn%m.n GROUP BY 1,2""",
    ("mentions", "turn_vec"),
)
def mention_edge_ema(spark, sf_dir):
    turns, nouns, key = _vectors(spark, sf_dir)
    e = G.mention_edge_ema(A.mentions(spark, sf_dir), turns, nouns, key, key)
    pole = lambda i: F.round(F.get("tgt_pole", F.lit(i)), 6).alias(f"pole{i}")
    return e.select("src", "tgt", F.round("magnitude", 6).alias("magnitude"), "last_active_turn", F.size("provenance").alias("n_provenance"), pole(0), pole(63))


@query()
def beam_walk(spark, sf_dir):
    turns, nouns, key = _vectors(spark, sf_dir)
    sizes = G.vector_sizes(turns)
    # A walk reads the pairs several times, so they are written once; shares and poles are made for the edges that it meets.
    pairs = keep(G.mention_pairs(A.mentions(spark, sf_dir)), "pairs")

    def edges(asked, end, source=True):
        few = sent_if_few(asked.withColumnRenamed("noun", end), BROADCAST_NOUNS)
        some = pairs.join(few, end, "left_semi").repartition(end)
        return G.edges_of_shares(G.shares_of_pairs(some, turns, key), turns, nouns, key, key, sizes, end, source)

    queries = A.turn_vec(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("qv"))
    return G.beam_walk(seeds_of_queries(spark, sf_dir), edges, queries, C.VECTOR_K, touching=lambda asked, end: edges(asked, end, False), sizes=sizes)


@query(f"WITH {EDGE2} SELECT source, neighbor, claim_id, node_rank FROM e2", ("edges",))
def claim_edges_topk(spark, sf_dir):
    return G.claim_edges(A.edges(spark, sf_dir)).select("source", "neighbor", "claim_id", "node_rank")


@query(
    f"""WITH {EDGE2}, s AS (SELECT 'c'||c_custkey AS start FROM customer),
    r1 AS (SELECT start, source, node_rank, claim_id, neighbor FROM s JOIN e2 ON source=start), f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY source, node_rank, claim_id) AS n FROM r1 QUALIFY row_number() OVER (PARTITION BY start, claim_id ORDER BY source, node_rank)=1) WHERE n<=20),
    n1 AS (SELECT DISTINCT start, neighbor AS node FROM f1 WHERE neighbor<>start),
    r2 AS (SELECT start, source, node_rank, claim_id FROM n1 JOIN e2 ON source=node WHERE NOT EXISTS (SELECT 1 FROM f1 WHERE f1.start=n1.start AND f1.claim_id=e2.claim_id)),
    d2 AS (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY start, claim_id ORDER BY source, node_rank)=1), f2 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY start ORDER BY source, node_rank, claim_id)<=20)
    SELECT start, 1 AS hop, claim_id FROM f1 UNION ALL SELECT start, 2, claim_id FROM f2""",
    ("edges",),
)
def claim_walk(spark, sf_dir):
    start = A.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return G.claim_walk(start, G.claim_edges(A.edges(spark, sf_dir)))


@query(
    f"""WITH {PAIRS}, g AS (SELECT src, tgt, sum(conf) AS m FROM pr GROUP BY 1,2) SELECT src AS noun, tgt AS neighbor, 'out' AS direction, round(m,6) AS weight FROM g UNION ALL SELECT tgt, src, 'in', round(m,6) FROM g""",
    ME,
)
def noun_hop(spark, sf_dir):
    g = G.mention_pairs(A.mentions(spark, sf_dir)).groupBy("src", "tgt").agg(F.round(F.sum("conf"), 6).alias("weight"))
    return g.select(F.col("src").alias("noun"), F.col("tgt").alias("neighbor"), F.lit("out").alias("direction"), "weight").union(g.select("tgt", "src", F.lit("in"), "weight"))


@query("SELECT p_partkey AS concept, count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey=p_partkey GROUP BY 1")
def concept_degree(spark, sf_dir):
    d = A.read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept"))
    return p.join(d, F.col("concept") == F.col("l_partkey"), "left").select("concept", F.coalesce("n", F.lit(0)).alias("degree"))


@query("SELECT node, 1+count(*) AS val FROM (SELECT subject AS node FROM edges UNION ALL SELECT object FROM edges) GROUP BY 1", ("edges",))
def graph_degree(spark, sf_dir):
    return G.degree(A.edges(spark, sf_dir), "subject", "object").select("node", (F.col("degree") + 1).alias("val"))


@query(
    "SELECT count(*) AS edges, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, count(DISTINCT owner) AS owners, min(event_time) AS first_seen, max(event_time) AS last_seen, round(avg(distance),4) AS mean_distance FROM edges",
    ("edges",),
)
def graph_stats(spark, sf_dir):
    e = A.edges(spark, sf_dir)
    return e.agg(F.count("*").alias("edges"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects"), F.count_distinct("owner").alias("owners"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.round(F.avg("distance"), 4).alias("mean_distance"))


@query(
    """SELECT subject AS src, object AS dst, count(*) AS weight, round(exp(-greatest(epoch(TIMESTAMP '1999-01-01')-epoch(max(event_time)),0)/2592000/100),6) AS decay FROM edges GROUP BY 1,2""",
    ("edges",),
)
def catalog_edges(spark, sf_dir):
    age = F.greatest(F.unix_timestamp(F.lit("1999-01-01").cast("timestamp")) - F.unix_timestamp(F.max("event_time")), F.lit(0))
    return A.edges(spark, sf_dir).groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.count("*").alias("weight"), F.round(F.exp(-age / 2592000 / 100), 6).alias("decay"))


@query(
    """SELECT l_returnflag AS label, CAST(l_suppkey AS VARCHAR) AS key, arg_min(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, l_linestatus)) AS weight, arg_min(l_shipdate, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, l_linestatus)) AS created_at, arg_max(l_linestatus, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, l_linestatus)) AS name FROM lineitem GROUP BY 1,2""",
)
def vertex_merge(spark, sf_dir):
    li = A.read(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("label"), F.col("l_suppkey").cast("string").alias("key"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_linestatus").alias("seq"), F.col("l_quantity").alias("weight"), F.col("l_shipdate").alias("created_at"), F.col("l_linestatus").alias("name"))
    return G.merge_vertices(rows)


@query("SELECT l_suppkey AS src, l_partkey AS dst, 'SUPPLIES' AS label, count(*) AS weight, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)) AS flag FROM lineitem GROUP BY 1,2")
def edge_merge(spark, sf_dir):
    li = A.read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("SUPPLIES").alias("label")).agg(F.count("*").alias("weight"), F.max_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("flag"))


@query(
    """SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT') AND (c_acctbal>0 OR c_acctbal IS NULL)""",
)
def orphan_concepts(spark, sf_dir):
    """Nodes without an edge that are old enough; those without a date stay."""
    linked = A.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return A.read(spark, sf_dir, "customer").where("c_acctbal > 0 or c_acctbal is null").join(linked, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"))


@query(
    """WITH b AS (SELECT DISTINCT 's'||s_suppkey AS a, 'n'||s_nationkey AS b FROM supplier UNION SELECT DISTINCT 'n'||n_nationkey, 'r'||n_regionkey FROM nation), u AS (SELECT a,b FROM b UNION SELECT b,a FROM b),
    s AS (SELECT 's'||s_suppkey AS start FROM supplier), h1 AS (SELECT DISTINCT start, b AS node FROM s JOIN u ON a=start), h2 AS (SELECT DISTINCT start, b AS node FROM h1 JOIN u ON a=node)
    SELECT start, node, min(hop) AS hop FROM (SELECT start, start AS node, 0 AS hop FROM s UNION ALL SELECT start, node, 1 FROM h1 UNION ALL SELECT start, node, 2 FROM h2) GROUP BY 1,2""",
)
def khop_entities(spark, sf_dir):
    s, n = A.read(spark, sf_dir, "supplier"), A.read(spark, sf_dir, "nation")
    pre = lambda p, c: F.concat(F.lit(p), c)
    edges = s.select(pre("s", "s_suppkey").alias("a"), pre("n", "s_nationkey").alias("b")).union(n.select(pre("n", "n_nationkey"), pre("r", "n_regionkey")))
    return G.khop(edges, s.select(pre("s", "s_suppkey").alias("start")), 2)


@query(
    """WITH f AS (SELECT noun_id, count(DISTINCT turn) AS df FROM mentions GROUP BY 1), t AS (SELECT DISTINCT m.turn, m.noun_id, df FROM mentions m JOIN f USING (noun_id)), k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY turn ORDER BY df, noun_id)<=6)
    SELECT a.noun_id AS a, b.noun_id AS b, count(*) AS n FROM k a JOIN k b ON a.turn=b.turn AND a.noun_id<b.noun_id GROUP BY 1,2""",
    ME,
)
def co_mention_pairs(spark, sf_dir):
    """Pairs among a turn's six most specific nouns: at most fifteen of a turn."""
    m = A.mentions(spark, sf_dir).select("turn", "noun_id").distinct()
    df = m.groupBy("noun_id").agg(F.count("*").alias("df"))
    k = m.join(df, "noun_id").withColumn("r", F.row_number().over(Window.partitionBy("turn").orderBy("df", "noun_id"))).where("r <= 6")
    a, b = k.select("turn", F.col("noun_id").alias("a")), k.select("turn", F.col("noun_id").alias("b"))
    return a.join(b, "turn").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey)+(SELECT count(*) FROM supplier WHERE s_nationkey=n_nationkey) AS degree, (SELECT count(*) FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey=n_nationkey) AS bridges FROM nation")
def vertex_audit(spark, sf_dir):
    n, c, s, o = (A.read(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders"))
    ends = c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).groupBy("k").agg(F.count("*").alias("degree"))
    bridges = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("bk")).agg(F.count("*").alias("bridges"))
    j = n.join(ends, F.col("n_nationkey") == F.col("k"), "left").join(bridges, F.col("n_nationkey") == F.col("bk"), "left")
    return j.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("bridges", F.lit(0)).alias("bridges"))


@query(
    f"""WITH {PAIRS} SELECT src, tgt, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS provenance FROM (SELECT DISTINCT src, tgt, turn FROM pr WHERE turn IN (SELECT o_orderkey FROM orders WHERE o_custkey%4=1)) GROUP BY 1,2""",
    ME,
)
def owner_scoped_paths(spark, sf_dir):
    """Paths kept if a turn of theirs is the owner's, with their provenance cut to it."""
    own = A.read(spark, sf_dir, "orders").where("o_custkey % 4 = 1").select(F.col("o_orderkey").alias("turn"))
    p = G.mention_pairs(A.mentions(spark, sf_dir)).join(own, "turn", "left_semi")
    return p.groupBy("src", "tgt").agg(F.array_join(F.transform(F.array_sort(F.collect_set("turn")), lambda x: x.cast("string")), ",").alias("provenance"))


@query(
    """SELECT l_partkey AS node, arg_max(l_returnflag, (CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END)) AS label FROM lineitem GROUP BY 1""",
)
def label_precedence(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.max_by("l_returnflag", rank).alias("label"))


@query(
    """WITH e AS (SELECT CASE WHEN l_suppkey%10=0 AND l_suppkey>0 THEN l_suppkey-1 ELSE l_suppkey END AS src, CASE WHEN l_partkey%10=0 AND l_partkey>0 THEN l_partkey-1 ELSE l_partkey END AS dst, l_quantity AS weight FROM lineitem) SELECT src, dst, max(weight) AS weight FROM e WHERE src<>dst GROUP BY 1,2""",
)
def merge_rewire(spark, sf_dir):
    li = A.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"))
    p = A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).union(A.read(spark, sf_dir, "supplier").select("s_suppkey")).distinct()
    return G.rewire(li, p.where("id % 10 = 0 and id > 0").select("id", (F.col("id") - 1).alias("keeper")))


@query(
    """SELECT (SELECT count(*) FROM orders) AS seeds, (SELECT count(*) FROM orders WHERE o_totalprice>=100000) AS over_floor, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE o_totalprice>=100000) AS passports, (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE o_totalprice>=100000) AS nouns""",
)
def retrieval_funnel(spark, sf_dir):
    o, li = A.read(spark, sf_dir, "orders"), A.read(spark, sf_dir, "lineitem")
    a = o.agg(F.count("*").alias("seeds"), F.count_if(F.col("o_totalprice") >= 100000).alias("over_floor"))
    b = li.join(o.where("o_totalprice >= 100000"), F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count("*").alias("passports"), F.count_distinct("l_partkey").alias("nouns"))
    return a.join(b)


@query(
    """WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name),' ')) AS t FROM part), q AS (SELECT DISTINCT n_nationkey AS q, unnest(string_split(lower(n_name),' ')) AS t FROM nation UNION SELECT DISTINCT 1000+p_size, unnest(string_split(lower(p_name),' ')) FROM part),
    m AS (SELECT q, p_partkey, count(*) AS overlap FROM q JOIN w USING (t) GROUP BY 1,2) SELECT q AS query, p_partkey AS entity, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY overlap DESC, p_partkey) AS rank FROM m) WHERE rank<=5""",
)
def lexical_query(spark, sf_dir):
    """Entities by shared name tokens with each query: an inverted index, top five.

    Entities of equal tokens are met once, under their least id: the first five such sets of a
    query hold its first five entities, and of a set the five least ids suffice.
    """
    p, n = A.read(spark, sf_dir, "part"), A.read(spark, sf_dir, "nation")
    tokens = lambda c: F.array_sort(F.array_distinct(F.split(F.lower(c), " "))).alias("ts")
    place = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    w = p.select("p_partkey", tokens("p_name")).where("ts is not null").distinct().groupBy("p_partkey").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("ts"))
    few = cut_lineage(w.select("ts", F.col("p_partkey").alias("entity")).withColumn("_r", place("ts", "entity")).where("_r <= 5").drop("_r"))
    sets = few.groupBy("ts").agg(F.min("entity").alias("first"))
    named = p.select((F.col("p_size") + 1000).alias("query"), tokens("p_name")).distinct()
    q = n.select(F.col("n_nationkey").alias("query"), tokens("n_name")).union(named).select("query", F.explode("ts").alias("t")).distinct()
    m = q.join(sets.select("first", F.explode("ts").alias("t")), "t").groupBy("query", "first").agg(F.count("*").alias("overlap"))
    m = m.withColumn("_r", place("query", F.desc("overlap"), "first")).where("_r <= 5").drop("_r")
    met = m.join(few.join(sets, "ts").select("first", "entity"), "first").select("query", "entity", "overlap")
    return met.withColumn("rank", place("query", F.desc("overlap"), "entity")).where("rank <= 5")
