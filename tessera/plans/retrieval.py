"""Queries on similarity search, fusion and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import text as X
from tessera.functions.scratch import keep
from tessera.functions.vectors import block_pairs, dot
from tessera.operators import search, vector_index
from tessera.operators.prefetch import prefetch as read_path
from tessera.plans.registry import query
from tessera.sources import adapters as A

#: Cosine in DuckDB, over DOUBLE lists.
COS = "list_cosine_similarity"


def _asked(v):
    """Every fiftieth vector asks."""
    return v.where("id % 50 = 0")


@query(
    f"""WITH s AS (SELECT a.id AS query, b.id, b.src, b.session_id, round({COS}(a.embedding, b.embedding), 9) AS c FROM turn_vec a JOIN turn_vec b ON a.id<>b.id AND (b.src='chunk' OR b.owner=a.owner) WHERE a.id%50=0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query, src ORDER BY c DESC, id) AS n FROM s),
    t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, src, id) AS rank FROM r WHERE n<=12)
    SELECT query, id, src, session_id, round(c,6) AS similarity, rank FROM t WHERE rank<=12""",
    ("turn_vec",),
)
def vector_search(spark, sf_dir):
    """Three arms: the query's owner's notes and turns, and everybody's chunks."""
    v = A.turn_vec(spark, sf_dir).withColumnRenamed("embedding", "v")
    arms = {src: (v.where(F.col("src") == src), src != "chunk") for src in ("memory", "chunk", "turn")}
    found = search.batch_arms(_asked(v).select("id", "owner", "v"), arms)
    return found.select("query", "id", "src", "session_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    f"""WITH p AS (SELECT a.id AS query_id, b.id AS id, round({COS}(a.embedding,b.embedding),9) AS c FROM turn_vec a JOIN turn_vec b ON a.id<>b.id WHERE a.id%50=0)
    SELECT query_id, id, round(c,6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM p) WHERE rank<=12""",
    ("turn_vec",),
)
def batch_vector_search(spark, sf_dir):
    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    got = search.batch_search(v.where("id % 50 = 0"), v, C.VECTOR_K)
    return got.select(F.col("id").alias("query_id"), F.col("other").alias("id"), F.round("cosine", 6).alias("similarity"), "rank")


@query(
    f"""WITH p AS (SELECT a.id AS query, b.id, round({COS}(a.embedding,b.embedding),9) AS c FROM turn_vec a JOIN turn_vec b ON a.id<>b.id AND a.owner=b.owner AND b.session_id<>'s0' WHERE a.id%50=0)
    SELECT query, id, round(c,6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM p) WHERE rank<=24""",
    ("turn_vec",),
)
def claim_ann(spark, sf_dir):
    """The nearest current claims of the query's owner."""
    v = A.turn_vec(spark, sf_dir).withColumnRenamed("embedding", "v")
    got = search.batch_search(_asked(v), v.where("session_id <> 's0'"), C.CLAIM_LIMIT, group="owner")
    return got.select(F.col("id").alias("query"), F.col("other").alias("id"), F.round("cosine", 6).alias("similarity"), "rank")


@query(
    f"""WITH p AS (SELECT a.id AS query, b.id, round({COS}(a.embedding,b.embedding),9) AS c FROM turn_vec a JOIN turn_vec b ON a.id<>b.id WHERE a.id%50=0),
    t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, id)<=3)
    SELECT query, id, round(c,6) AS similarity FROM t WHERE c>=0.2""",
    ("turn_vec",),
)
def entity_link_vector(spark, sf_dir):
    """The three nearest names, then the floor."""
    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    near = search.batch_search(_asked(v), v, C.NAME_TOP).where(F.round("cosine", 9) >= 0.2)
    return near.select(F.col("id").alias("query"), F.col("other").alias("id"), F.round("cosine", 6).alias("similarity"))


@query(
    f"""WITH p AS (SELECT a.id AS id, b.id AS other, round({COS}(a.embedding,b.embedding),9) AS c FROM turn_vec a JOIN turn_vec b ON a.id<>b.id AND a.owner=b.owner)
    SELECT id, other, round(c,6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rank FROM p WHERE c>=0.2) WHERE rank<=5""",
    ("turn_vec",),
)
def ghost_knn(spark, sf_dir):
    v = A.turn_vec(spark, sf_dir).select("id", "owner", F.col("embedding").alias("v"))
    out = search.batch_search(v, v, 5, 0.2, group="owner")
    return out.select("id", "other", F.round("cosine", 6).alias("cosine"), "rank")


@query(
    f"""WITH p AS (SELECT a.id AS turn, b.label AS concept, round({COS}(a.embedding,b.c),9) AS c FROM turn_vec a, (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY 1,2) GROUP BY 1) b)
    SELECT turn, concept, round(c,6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY c DESC, concept) AS n FROM p WHERE c>=0.42) WHERE n<=2""",
    ("turn_vec",),
)
def ghost_concept(spark, sf_dir):
    e = A.read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    concept = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    got = block_pairs(v, concept.select((-1 - F.col("label")).cast("long").alias("id"), "v"), 0.42)
    order = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), F.desc("other"))
    best = got.withColumn("n", F.row_number().over(order)).where("n <= 2")
    return best.select(F.col("id").alias("turn"), (-1 - F.col("other")).cast("int").alias("concept"), F.round("cosine", 6).alias("cosine"))


@query(
    f"""SELECT a.id AS a, b.id AS b, round({COS}(a.embedding,b.embedding),6) AS cosine FROM turn_vec a JOIN turn_vec b ON a.id<b.id WHERE round({COS}(a.embedding,b.embedding),9)>=0.4""",
    ("turn_vec",),
)
def near_dup_pairs(spark, sf_dir):
    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    p = block_pairs(v, v, 0.4 - 1e-9, undirected=True)
    return p.where(F.round("cosine", 9) >= 0.4).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.round("cosine", 6).alias("cosine"))


@query(
    f"""WITH p AS (SELECT a.id AS id, b.id AS other, round({COS}(a.embedding,b.embedding),9) AS c FROM turn_vec a JOIN turn_vec b ON a.id<>b.id AND a.owner=b.owner),
    k AS (SELECT * FROM p WHERE c>=0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, other)<=5)
    SELECT least(id,other) AS a, greatest(id,other) AS b, round(max(c),6) AS cosine, count(*)=2 AS mutual FROM k GROUP BY 1,2""",
    ("turn_vec",),
)
def undirected_knn(spark, sf_dir):
    """Pairs of which either side chose the other among its nearest; whether both did."""
    v = A.turn_vec(spark, sf_dir).select("id", "owner", F.col("embedding").alias("v"))
    chosen = search.batch_search(v, v, 5, 0.2, group="owner")
    return chosen.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.round(F.max("cosine"), 6).alias("cosine"), (F.count("*") == 2).alias("mutual"))


@query(
    """SELECT id, round(embedding[1],6) AS x0, round(embedding[2],6) AS x1, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: x*x))),6) AS norm FROM turn_vec""",
    ("turn_vec",),
)
def embedding_preview(spark, sf_dir):
    v = A.turn_vec(spark, sf_dir)
    return v.select("id", F.round(F.get("embedding", F.lit(0)), 6).alias("x0"), F.round(F.get("embedding", F.lit(1)), 6).alias("x1"), F.size("embedding").cast("long").alias("dim"), F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@query(
    """WITH v AS (SELECT p_brand AS query, p_type AS list, CAST(p_partkey AS VARCHAR) AS item, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
    w AS (SELECT p_brand AS query, 'size' AS list, CAST(p_partkey AS VARCHAR) AS item, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part),
    f AS (SELECT query, item, round(sum(1.0/(60+rank)),9) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM w) GROUP BY 1,2)
    SELECT query, item, round(score,6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS place FROM f) WHERE place<=12""",
)
def rrf_fusion(spark, sf_dir):
    p = A.read(spark, sf_dir, "part")
    item = F.col("p_partkey").cast("string")
    by_price = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    by_size = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    one = p.select(F.col("p_brand").alias("query"), F.col("p_type").alias("list"), item.alias("item"), F.row_number().over(by_price).alias("rank"))
    two = p.select(F.col("p_brand").alias("query"), F.lit("size").alias("list"), item.alias("item"), F.row_number().over(by_size).alias("rank"))
    return search.rrf(one.unionByName(two)).where(F.col("place") <= C.MAX_FACTS).withColumn("score", F.round("score", 6))


@query(
    f"""WITH RECURSIVE i AS (SELECT owner||'/'||session_id AS query, id AS item, row_number() OVER (PARTITION BY owner, session_id ORDER BY id)-1 AS position, embedding AS v FROM turn_vec QUALIFY position<24),
    r AS (SELECT query, 0 AS place, CAST([] AS BIGINT[]) AS chosen, CAST([] AS DOUBLE[][]) AS vs, CAST(NULL AS BIGINT) AS item FROM i GROUP BY 1
          UNION ALL SELECT query, place+1, chosen||[item], vs||[v], item FROM (
            SELECT r.query, r.place, r.chosen, r.vs, i.item, i.v, row_number() OVER (PARTITION BY r.query ORDER BY 0.7/(1+position) - 0.3*coalesce(list_max(list_transform(r.vs, lambda u: {COS}(u, i.v))), 0) DESC, position) AS n
            FROM r JOIN i ON i.query=r.query AND NOT list_contains(r.chosen, i.item) WHERE r.place<12) WHERE n=1)
    SELECT query, item, place FROM r WHERE place>0""",
    ("turn_vec",),
)
def mmr(spark, sf_dir):
    v = A.turn_vec(spark, sf_dir)
    order = Window.partitionBy("owner", "session_id").orderBy("id")
    items = v.select(F.concat_ws("/", "owner", "session_id").alias("query"), F.col("id").alias("item"), (F.row_number().over(order) - 1).alias("position"), F.col("embedding").alias("v")).where(F.col("position") < C.CLAIM_LIMIT)
    return search.mmr(items, C.MAX_FACTS)


@query(
    """WITH n AS (SELECT s_suppkey AS id, regexp_replace(lower(s_name),'[^a-z0-9]+',' ','g') AS w FROM supplier),
    m AS (SELECT DISTINCT id, substr('  '||t||' ', i, 3) AS g FROM (SELECT id, unnest(string_split(w,' ')) AS t FROM n) x, range(1, 40) r(i) WHERE t<>'' AND i<=length(t)+1),
    z AS (SELECT id, count(*) AS c FROM m GROUP BY 1),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM m a JOIN m b ON a.g=b.g GROUP BY 1,2),
    s AS (SELECT a AS term_id, b AS entity_id, round(k/CAST(x.c+y.c-k AS DOUBLE),6) AS similarity FROM p JOIN z x ON x.id=a JOIN z y ON y.id=b)
    SELECT term_id, entity_id, similarity FROM s WHERE similarity>=0.6 QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY similarity DESC, entity_id)<=20""",
)
def entity_link_trigram(spark, sf_dir):
    s = A.read(spark, sf_dir, "supplier")
    linked = search.trigram_top(s.select(F.col("s_name").alias("term")), s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name")), C.LINK_LIMIT)
    return linked.join(s.select(F.col("s_name").alias("term"), F.col("s_suppkey").alias("term_id")), "term").select("term_id", "entity_id", "similarity")


@query(
    f"""WITH m AS (SELECT count(*) AS n FROM turn_vec), e AS (SELECT s_suppkey AS id, lower(s_name) AS norm, CASE WHEN s_suppkey%10=9 THEN s_suppkey-1 END AS merged FROM supplier),
    n AS (SELECT id, norm AS surface FROM e UNION SELECT id, 'vendor '||id FROM e WHERE id%3<>0),
    p AS (SELECT id AS query, norm AS term FROM e WHERE id%50=0 UNION SELECT id, replace(norm,'pp','p') FROM e WHERE id%50=0 UNION SELECT id, 'vendor '||(id+9) FROM e WHERE id%50=0),
    w AS (SELECT x, unnest(string_split(regexp_replace(x,'[^a-z0-9]+',' ','g'),' ')) AS t FROM (SELECT surface AS x FROM n UNION SELECT term FROM p)),
    g AS (SELECT DISTINCT x, substr('  '||t||' ', i, 3) AS g FROM w, range(1,40) r(i) WHERE t<>'' AND i<=length(t)+1), z AS (SELECT x, count(*) AS c FROM g GROUP BY 1),
    k AS (SELECT a.x AS term, b.x AS surface, count(*) AS k FROM g a JOIN g b ON a.g=b.g WHERE a.x IN (SELECT term FROM p) GROUP BY 1,2),
    s AS (SELECT term, surface, round(k/CAST(x.c+y.c-k AS DOUBLE),6) AS sim FROM k JOIN z x ON x.x=term JOIN z y ON y.x=surface),
    named AS (SELECT query, coalesce(merged,e.id) AS id, CASE WHEN surface=term THEN 2 ELSE 1 END AS exact, sim AS trigram, 0.0::DOUBLE AS ns FROM p JOIN s USING (term) JOIN n USING (surface) JOIN e ON e.id=n.id WHERE sim>=0.6),
    near AS (SELECT q.id AS query, b.id, round({COS}(t.embedding,u.embedding),9) AS ns FROM e q, m, e b, turn_vec t, turn_vec u WHERE q.id%50=0 AND t.id=(q.id+7)%n AND b.merged IS NULL AND u.id=b.id%n),
    top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query ORDER BY ns DESC, id)<=3),
    best AS (SELECT query, id, max(exact) AS exact, max(trigram) AS trigram, max(ns) AS ns FROM (SELECT * FROM named UNION ALL SELECT query, id, 0, 0.0, ns FROM top WHERE ns>=0.8) GROUP BY 1,2)
    SELECT query, b.id AS entity_id, exact, round(trigram,6) AS trigram, round(ns,6) AS name_similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, ns DESC, trigram DESC, id) AS rank FROM best WHERE id IN (SELECT id FROM e WHERE merged IS NULL)) b WHERE rank<=20""",
    ("turn_vec",),
)
def entity_link(spark, sf_dir):
    """Every fiftieth supplier asks with its name, a misspelt one, an alias of another and a vector, against all."""
    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    n = v.count()
    s = A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("entity_id"), F.lower("s_name").alias("name"))
    entities = s.select("entity_id", F.when(F.col("entity_id") % 10 == 9, F.col("entity_id") - 1).alias("merged_into"))
    alias = lambda c: F.concat(F.lit("vendor "), c.cast("string"))
    surfaces = s.union(s.where("entity_id % 3 <> 0").select("entity_id", alias(F.col("entity_id"))))
    asked = s.where("entity_id % 50 = 0")
    phrases = asked.select(F.col("entity_id").alias("query"), F.explode(F.array("name", F.replace("name", F.lit("pp"), F.lit("p")), alias(F.col("entity_id") + 9))).alias("term"))
    of = lambda c: (c % n).alias("k")
    by_key = v.withColumnRenamed("id", "k")
    vectors = asked.select(F.col("entity_id").alias("query"), of(F.col("entity_id") + 7)).join(by_key, "k").select("query", "v")
    name_vectors = entities.where("merged_into is null").select(F.col("entity_id").alias("id"), of(F.col("entity_id"))).join(by_key, "k").select("id", "v")
    found = search.link_entities(phrases, vectors, entities, surfaces, name_vectors)
    return found.select("query", "entity_id", "exact", F.round("trigram", 6).alias("trigram"), F.round("name_similarity", 6).alias("name_similarity"), "rank")


@query(
    """WITH RECURSIVE t AS (SELECT session_id, id, CAST(least(length(content),400)//4+8 AS BIGINT) AS cost, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM turns),
    f AS (SELECT session_id, id, cost, k, 40+cost<=300 AS kept, CASE WHEN 40+cost<=300 THEN 40+cost ELSE 40 END AS used FROM t WHERE k=1
          UNION ALL SELECT t.session_id, t.id, t.cost, t.k, f.used+t.cost<=300, CASE WHEN f.used+t.cost<=300 THEN f.used+t.cost ELSE f.used END FROM f JOIN t ON t.session_id=f.session_id AND t.k=f.k+1)
    SELECT session_id, id, cost, kept FROM f""",
    ("turns",),
)
def budget_skip(spark, sf_dir):
    t = A.turns(spark, sf_dir).select("session_id", "id", (F.length(F.substring("content", 1, 400)) / 4 + 8).cast("long").alias("cost"))
    return search.budget_skip(t, "session_id", ["id"], "cost", 300, start=40)


@query(
    """SELECT session_id, id, CAST(length(content)//4+20 AS BIGINT) AS cost, sum(length(content)//4+20) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING) <= 600 AS kept FROM turns""",
    ("turns",),
)
def budget_break(spark, sf_dir):
    t = A.turns(spark, sf_dir).select("session_id", "id", (F.floor(F.length("content") / 4) + 20).cast("long").alias("cost"))
    return search.budget_break(t, "session_id", ["id"], "cost", 600)


@query(
    """SELECT o_orderkey AS id, round(o_totalprice/1000000*(1+0.5*exp(-(epoch(TIMESTAMP '1999-01-01')-epoch(o_orderdate))/86400.0/365)),6) AS score FROM orders ORDER BY score DESC, id LIMIT 50""",
)
def pin_boost(spark, sf_dir):
    o = A.read(spark, sf_dir, "orders")
    age = (F.unix_timestamp(F.lit("1999-01-01").cast("timestamp")) - F.unix_timestamp("o_orderdate")) / 86400.0
    score = F.round(F.col("o_totalprice") / 1000000 * (1 + 0.5 * F.exp(-age / 365)), 6)
    return o.select(F.col("o_orderkey").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query(
    """SELECT event_id AS id, round(exp(-greatest(epoch(TIMESTAMP '2024-03-01')-epoch(ts),0)/86400.0/30),6) AS decay FROM events""",
)
def recency_decay(spark, sf_dir):
    from tessera.functions.scoring import recency_decay as decay

    return A.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(decay(F.col("ts"), F.lit(C.CLOCK)), 6).alias("decay"))


@query(
    """WITH b AS (SELECT l_orderkey*10+l_linenumber AS id, l_discount*8 AS sim, greatest(l_tax*10-0.1,0) AS src, greatest(l_discount*10-0.1,0) AS tgt, l_quantity/10 AS mag, exp(-0.05*l_linenumber*(1-l_discount)) AS decay, CASE WHEN l_returnflag='R' THEN 1.0 ELSE 0.0 END AS prov FROM lineitem)
    SELECT id, round((0.4*sim+0.4*src*tgt*prov+0.2*decay)*least(mag,8.0)/8,6) AS score FROM b WHERE (0.4*sim+0.4*src*tgt*prov+0.2*decay)*least(mag,8.0)/8 >= 0.05""",
)
def beam_score(spark, sf_dir):
    from tessera.functions.scoring import beam_score as score

    li = A.read(spark, sf_dir, "lineitem")
    b = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        score(F.col("l_discount") * 8, F.col("l_tax") * 10 - 0.1, F.col("l_discount") * 10 - 0.1, F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0), F.exp(-0.05 * F.col("l_linenumber") * (1 - F.col("l_discount"))), F.col("l_quantity") / 10).alias("s"),
    )
    return b.where(F.col("s") >= C.BEAM_FLOOR).select("id", F.round("s", 6).alias("score"))


@query(
    f"""WITH RECURSIVE m AS (SELECT count(*) AS n FROM turn_vec),
    r AS (SELECT 'turn' AS src, t.id, t.owner, coalesce(t.content,'') AS content, v.embedding AS v FROM turns t, m, turn_vec v WHERE v.id=t.id%m.n UNION ALL SELECT 'chunk', doc_id, NULL, coalesce(text,''), v.embedding FROM documents, m, turn_vec v WHERE v.id=doc_id%m.n),
    p AS (SELECT q.id AS query, r.src, r.id, r.content, round({COS}(q.embedding, r.v),9) AS c FROM turn_vec q JOIN r ON r.src='chunk' OR r.owner=q.owner WHERE q.id%50=0),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query, src ORDER BY c DESC, id)<=12),
    h AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, src, id)<=12),
    s AS (SELECT *, substr(trim(content),1,400) AS excerpt FROM h WHERE c>=0.55 AND NOT regexp_matches(content, '(?i)(api[_-]?key|secret|token|passw(or)?d)\\s*[:=]\\s*\\S{{6,}}')),
    k AS (SELECT *, greatest(1, length(excerpt)//4)+8 AS tokens, row_number() OVER (PARTITION BY query ORDER BY c DESC, src, id) AS pos FROM s),
    f AS (SELECT query, pos, CASE WHEN 40+tokens<=1200 THEN 40+tokens ELSE 40 END AS used, 40+tokens<=1200 AS kept FROM k WHERE pos=1
          UNION ALL SELECT k.query, k.pos, CASE WHEN f.used+k.tokens<=1200 THEN f.used+k.tokens ELSE f.used END, f.used+k.tokens<=1200 FROM f JOIN k ON k.query=f.query AND k.pos=f.pos+1),
    o AS (SELECT id, role, lag(id) OVER w AS pi, lag(content) OVER w AS pc, lead(id) OVER w AS ni, lead(content) OVER w AS nc, lead(role) OVER w AS nr FROM turns WINDOW w AS (PARTITION BY owner, session_id ORDER BY ts, id)),
    e AS (SELECT span_id, count(DISTINCT object_key) FILTER (WHERE act='assert') AS live, list_sort(list(DISTINCT object_key) FILTER (WHERE act='retract')) AS gone FROM evidence GROUP BY 1),
    x AS (SELECT k.*, o.role AS r0, CASE WHEN trim(coalesce(pc,''))<>'' AND NOT regexp_matches(pc, '(?i)(api[_-]?key|secret|token|passw(or)?d)\\s*[:=]\\s*\\S{{6,}}') THEN pi END AS prev_id, CASE WHEN trim(coalesce(nc,''))<>'' AND NOT regexp_matches(nc, '(?i)(api[_-]?key|secret|token|passw(or)?d)\\s*[:=]\\s*\\S{{6,}}') THEN ni END AS next_id,
            nc, nr, e.live, e.gone FROM k JOIN f ON f.query=k.query AND f.pos=k.pos AND f.kept LEFT JOIN o ON k.src='turn' AND o.id=k.id LEFT JOIN e ON k.src='turn' AND e.span_id=k.id)
    SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY c DESC, src, id) AS INT) AS rank, src, id, round(c,6) AS similarity, tokens, CASE WHEN src='turn' THEN coalesce(r0,'') ELSE 'doc' END AS role, prev_id, next_id,
      CASE WHEN src='turn' THEN CASE WHEN r0='assistant' AND nr='user' AND regexp_matches(coalesce(nc,''), '{X.REPAIR.replace("'", "''")}') THEN 'repaired' ELSE 'unknown' END END AS uptake, coalesce(live,0) AS live_claims, coalesce(array_to_string(gone[1:2], ','),'') AS retracted,
      '<span id="'||src||':'||id||'" role="'||CASE WHEN src='turn' THEN coalesce(r0,'') ELSE 'doc' END||'" score="'||printf('%.3f', c)||'">'||replace(replace(replace(excerpt,'&','&amp;'),'<','&lt;'),'>','&gt;')||'</span>' AS line FROM x""",
    ("turn_vec", "turns", "evidence"),
)
def prefetch(spark, sf_dir):
    """Every fiftieth vector asks over all turns of its owner and all documents; vectors by id."""
    vec = A.turn_vec(spark, sf_dir).select(F.col("id").alias("k"), F.col("owner").alias("_o"), F.col("embedding").alias("v"))
    n = vec.count()
    held = vec.drop("_o")
    t = A.turns(spark, sf_dir).withColumn("k", F.col("id") % n).join(held, "k").drop("k")
    d = A.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("").alias("owner"), F.lit("").alias("session_id"), F.col("text").alias("content"), (F.col("doc_id") % n).alias("k")).join(held, "k").drop("k")
    queries = vec.where("k % 50 = 0").select(F.col("k").alias("id"), F.col("_o").alias("owner"), "v")
    return read_path(queries, t, d, A.evidence(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""WITH s AS (SELECT a.id AS query, b.id, b.session_id, round({COS}(a.embedding,b.embedding),9) AS c FROM turn_vec a JOIN turn_vec b ON a.id<>b.id AND a.owner=b.owner WHERE a.id%50=0),
    k AS (SELECT * FROM s WHERE c>=0.0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, id)<=12)
    SELECT query, id, session_id, round(c,6) AS similarity, sum(60) OVER (PARTITION BY query ORDER BY c DESC, id ROWS UNBOUNDED PRECEDING) <= 600 AS kept FROM k""",
    ("turn_vec",),
)
def prefetch_spans(spark, sf_dir):
    """The first steps of the read path alone: search, floor, a budget that ends at the first that doesn't fit."""
    v = A.turn_vec(spark, sf_dir).withColumnRenamed("embedding", "v")
    near = search.batch_search(_asked(v), v, C.VECTOR_K, group="owner").select(F.col("id").alias("query"), F.col("other").alias("id"), F.round("cosine", 9).alias("similarity")).where("similarity >= 0")
    packed = search.budget_break(near.withColumn("cost", F.lit(60)), "query", [F.desc("similarity"), F.col("id")], "cost", 600)
    return packed.join(v.select("id", "session_id"), "id").select("query", "id", "session_id", F.round("similarity", 6).alias("similarity"), "kept")


@query()
def index_search(spark, sf_dir):
    """Every fiftieth vector's nearest by an index whose probes reach a recall of 0.95."""
    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    index = vector_index.build(v)
    probes, recall, share = vector_index.choose_probes(vector_index.recall_curve(index, _asked(v), C.VECTOR_K), 0.95)
    found = vector_index.search(index, _asked(v), C.VECTOR_K, probes)
    return found.select(F.col("id").alias("query"), F.col("other").alias("id"), F.round("cosine", 6).alias("similarity"), "rank", F.lit(probes).alias("probes"), F.lit(recall).alias("recall"), F.lit(share).alias("share_read"))


@query(
    """WITH s AS (SELECT label, count(*) AS n, count(DISTINCT vec_id%2) AS d FROM embeddings GROUP BY 1)
    SELECT label AS source, n AS rows, CASE WHEN d=1 THEN 'm0' END AS stamp FROM s""",
)
def embed_stamp(spark, sf_dir):
    """The model of a source's vectors if they all agree, else null."""
    e = A.read(spark, sf_dir, "embeddings")
    agreed = F.count_distinct(F.col("vec_id") % 2) == 1
    return e.groupBy(F.col("label").alias("source")).agg(F.count("*").alias("rows"), F.when(agreed, F.lit("m0")).alias("stamp"))


@query(
    f"""WITH p AS (SELECT a.id AS turn, b.id AS concept, round({COS}(a.embedding,b.embedding),9) AS c FROM turn_vec a JOIN turn_vec b ON a.src='turn' AND b.src='memory')
    SELECT turn, concept, round(c,6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY c DESC, concept) AS n FROM p WHERE c>=0.3) WHERE n=1""",
    ("turn_vec",),
)
def about_links(spark, sf_dir):
    v = A.turn_vec(spark, sf_dir)
    t, m = (v.where(F.col("src") == s).select("id", F.col("embedding").alias("v")) for s in ("turn", "memory"))
    got = search.batch_search(t, m, 1, 0.3)
    return got.select(F.col("id").alias("turn"), F.col("other").alias("concept"), F.round(F.round("cosine", 9), 6).alias("cosine"))




@query()
def hybrid_retrieval(spark, sf_dir):
    """Queries are every fiftieth vector; claims are order lines, vectors theirs by id."""
    from tessera.operators.hybrid import retrieve

    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    # Claims are scanned for each step, so they are joined and written once.
    claims = keep(A.edges(spark, sf_dir).select("claim_id", "subject", "object", "distance").dropDuplicates(["claim_id"]), "claims")
    keys = claims.select(F.col("claim_id").alias("claim"), (F.col("claim_id") % v.count()).alias("k"))
    queries = v.where("id % 50 = 0").withColumn("id", -1 - F.col("id"))
    linked = queries.select(F.col("id").alias("query"), F.concat(F.lit("c"), -F.col("id")).alias("entity"))
    return retrieve(queries, keys, v.withColumnRenamed("id", "k"), claims, linked)
