"""Queries of the read path: what may be read, views, intakes, display fields, ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions.scratch import cut_lineage, sent_if_few
from tessera.operators import readpath as R
from tessera.operators import search
from tessera.plans.registry import query
from tessera.sources import adapters as A

#: Hits of all searches that are sent to all tasks at most.
BROADCAST_HITS = 500_000
#: Ids of a stretch, by which ranges of ids and turns meet.
STRETCH = 64
#: Conversations of several kinds and sessions, some of which no person wrote.
KINDS = """k AS (SELECT id, owner, ts, CASE conv%3 WHEN 0 THEN NULL WHEN 1 THEN 'interactive' ELSE 'cron' END AS kind,
    CASE conv%7 WHEN 0 THEN 'bench-' WHEN 1 THEN 'bench_' WHEN 2 THEN 'verify-c5' WHEN 3 THEN 'c8-' ELSE 'chat-' END||conv AS sid FROM (SELECT *, id//1000 AS conv FROM turns))"""
SYNTHETIC = "(starts_with(sid,'bench-') OR starts_with(sid,'bench_') OR starts_with(sid,'verify-c5') OR starts_with(sid,'c8-'))"


def _kinds(spark, sf_dir):
    conv = F.floor(F.col("id") / 1000).cast("long")
    k = conv % 7
    prefix = F.when(k == 0, "bench-").when(k == 1, "bench_").when(k == 2, "verify-c5").when(k == 3, "c8-").otherwise("chat-")
    kind = F.when(conv % 3 == 1, "interactive").when(conv % 3 == 2, "cron")
    return A.turns(spark, sf_dir).select("id", "owner", "ts", kind.alias("kind"), F.concat(prefix, conv).alias("sid"))


@query(f"WITH {KINDS} SELECT id, owner, sid FROM k WHERE coalesce(kind,'interactive')='interactive' AND NOT starts_with(sid,'verify-c5') AND NOT starts_with(sid,'bench-')", ("turns",))
def interactive_turns(spark, sf_dir):
    return _kinds(spark, sf_dir).where(R.interactive(F.col("kind"), F.col("sid"))).select("id", "owner", "sid")


@query(f"WITH {KINDS} SELECT id, sid FROM k WHERE NOT {SYNTHETIC} ORDER BY ts DESC, id DESC LIMIT 100", ("turns",))
def catalog_turns(spark, sf_dir):
    """The newest hundred turns; test sessions go before the limit, so they don't use it up."""
    t = _kinds(spark, sf_dir).where(~R.starts_with_any(F.col("sid"), R.SYNTHETIC_SESSIONS))
    return t.orderBy(F.desc("ts"), F.desc("id")).limit(100).select("id", "sid")


@query(f"WITH {KINDS}, x AS (SELECT id FROM k WHERE {SYNTHETIC}) SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM x) GROUP BY 1,2", ("turns",))
def synthetic_purge(spark, sf_dir):
    """Bridges that stay when the turns of test sessions, and the bridges to them, are deleted."""
    purged = _kinds(spark, sf_dir).where(R.starts_with_any(F.col("sid"), R.SYNTHETIC_SESSIONS)).select(F.col("id").alias("src"))
    bridges = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return bridges.join(purged, "src", "left_anti").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    """WITH h AS (SELECT id, role, ltrim(left(CASE id%5 WHEN 0 THEN '  [System: note] ' WHEN 1 THEN '[PRIOR CONTEXT] ' WHEN 2 THEN 'Cronjob Response: ' WHEN 3 THEN 'see [System: ' ELSE '' END||content, 200)) AS head FROM turns WHERE role='user')
    SELECT id FROM h WHERE list_bool_or(list_transform(['[System:','[CONTEXT','[PRIOR CONTEXT','[IMPORTANT:','[Your active task list','[Planning state preserved','[ASYNC DELEGATION','[OUT-OF-BAND','Cronjob Response:'], lambda p: starts_with(head, p)))""",
    ("turns",),
)
def synthetic_user_rows(spark, sf_dir):
    k = F.col("id") % 5
    put = F.when(k == 0, "  [System: note] ").when(k == 1, "[PRIOR CONTEXT] ").when(k == 2, "Cronjob Response: ").when(k == 3, "see [System: ").otherwise("")
    return A.turns(spark, sf_dir).where("role = 'user'").where(R.synthetic_row(F.concat(put, F.col("content")))).select("id")


@query(
    """WITH b AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY id)-1)//8 AS batch FROM turns), r AS (SELECT session_id, batch, min(id) AS lo, max(id) AS hi FROM b GROUP BY 1,2)
    SELECT r.session_id, batch, count(*) AS n, sum(length(content)) AS chars FROM r JOIN turns t ON t.session_id=r.session_id AND t.id BETWEEN lo AND hi GROUP BY 1,2""",
    ("turns",),
)
def batch_turns(spark, sf_dir):
    """The turns of each batch, read back by its range of ids within the session."""
    t = A.turns(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1
    ranges = t.withColumn("batch", F.floor(place / C.BATCH_SIZE)).groupBy("session_id", "batch").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    # A range meets the turns of the stretches of ids that it touches, not those of its whole session.
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    touched = ranges.withColumn("_s", F.explode(F.sequence(stretch("lo"), stretch("hi"))))
    back = touched.join(t.withColumn("_s", stretch("id")), ["session_id", "_s"]).where(F.col("id").between(F.col("lo"), F.col("hi")))
    return back.groupBy("session_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(
    """WITH p AS (SELECT a.id AS query, b.id AS id, round(list_cosine_similarity(a.embedding,b.embedding),9) AS c FROM turn_vec a JOIN turn_vec b ON a.id<>b.id WHERE a.id%50=0),
    s AS (SELECT query, 'conv_'||id AS chunk, c FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS n FROM p) WHERE n<=12)
    SELECT query, noun_id AS noun, turn, round(max(c),6) AS similarity FROM s JOIN mentions ON chunk='conv_'||turn GROUP BY 1,2,3""",
    ("turn_vec", "mentions"),
)
def walk_hypotheses(spark, sf_dir):
    h = seeds_of_queries(spark, sf_dir)
    return h.withColumn("similarity", F.round("similarity", 6))


def seeds_of_queries(spark, sf_dir):
    """(query, noun, turn, similarity): nouns of the turns that a search of every fiftieth vector finds."""
    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    hits = search.batch_search(v.where("id % 50 = 0"), v, C.VECTOR_K)
    seeds = hits.select(F.col("id").alias("query"), F.concat(F.lit("conv_"), "other").alias("chunk"), F.round("cosine", 9).alias("similarity"))
    passports = A.mentions(spark, sf_dir).select(F.col("noun_id").alias("noun"), "turn", F.concat(F.lit("conv_"), "turn").alias("chunk"))
    return R.hypotheses(passports, sent_if_few(cut_lineage(seeds), BROADCAST_HITS))


@query(
    """SELECT * FROM (SELECT 'turn' AS kind, id FROM turns ORDER BY ts DESC, id DESC LIMIT 70) UNION ALL SELECT * FROM (SELECT 'file' AS kind, doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30)""",
    ("turns",),
)
def conversation_first(spark, sf_dir):
    """A view of a hundred rows: seven tenths newest turns, the rest largest files."""
    n_turns, n_files = R.view_shares(100)
    t = A.turns(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(n_turns)
    d = A.docs(spark, sf_dir).orderBy(F.desc("n_chars"), "doc_id").limit(n_files)
    return t.select(F.lit("turn").alias("kind"), "id").union(d.select(F.lit("file"), "doc_id"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM turn_vec), e AS (SELECT l_suppkey AS src, l_partkey AS tgt, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1,2)
    SELECT e.src, e.tgt, round(list_cosine_similarity(a.embedding,b.embedding),6) AS cosine, round(exp(-greatest(0, epoch(TIMESTAMP '1999-01-01')-epoch(last_at))/2592000.0),6) AS decay FROM e, n, turn_vec a, turn_vec b WHERE a.id=e.src%n AND b.id=e.tgt%n""",
    ("turn_vec",),
)
def catalog_decay(spark, sf_dir):
    """Mention edges with the cosine of their poles and their decay; the poles are joined, not collected."""
    from tessera.functions.vectors import cosines_of_pairs

    n = A.read(spark, sf_dir, "embeddings").count()
    e = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt")).agg(F.max("l_shipdate").alias("at"))
    # Nouns share vectors, so each pair of vectors is compared once.
    e = e.select("src", "tgt", "at", (F.col("src") % n).alias("a"), (F.col("tgt") % n).alias("b"))
    named = A.read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % n).alias("a"), (F.col("l_partkey") % n).alias("b")).distinct()
    pairs = cosines_of_pairs(named, A.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))).withColumn("cosine", F.round("cosine", 6))
    age = F.greatest(F.lit(0), F.unix_timestamp(F.lit("1999-01-01").cast("timestamp")) - F.unix_timestamp("at"))
    return e.join(pairs, ["a", "b"]).select("src", "tgt", "cosine", F.round(F.exp(-age / 2592000.0), 6).alias("decay"))


@query(
    """WITH x AS (SELECT id, ts, trim(regexp_replace(coalesce(content,''),'\\s+',' ','g')) AS line, regexp_replace(coalesce(content,''),'^\\s+|\\s+$','','g') AS body FROM turns),
    y AS (SELECT *, trim(regexp_replace(split_part(body,chr(10),1),'[#*_`]+','','g')) AS head FROM x)
    SELECT id, CASE WHEN length(line)<=280 THEN line ELSE rtrim(left(line,279))||'…' END AS excerpt, CASE WHEN head='' THEN CAST(id AS VARCHAR) WHEN length(head)>80 THEN left(head,77)||'…' ELSE head END AS title,
    strftime(ts,'%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN id%3=0 THEN '—' WHEN epoch(ts)-epoch(TIMESTAMP '2024-01-02')<=0 THEN 'expired' ELSE printf('%02d:%02d left', CAST((epoch(ts)-epoch(TIMESTAMP '2024-01-02'))//60 AS BIGINT), CAST(CAST(epoch(ts)-epoch(TIMESTAMP '2024-01-02') AS BIGINT)%60 AS BIGINT)) END AS lease FROM y""",
    ("turns",),
)
def display_fields(spark, sf_dir):
    t = A.turns(spark, sf_dir)
    lease = R.lease_left(F.when(F.col("id") % 3 != 0, F.col("ts")), F.lit("2024-01-02").cast("timestamp"))
    return t.select("id", R.excerpt(F.col("content")).alias("excerpt"), R.title(F.col("content"), F.col("id").cast("string")).alias("title"), R.iso(F.col("ts")).alias("iso"), lease.alias("lease"))


@query("SELECT id, round(list_min(embedding),6) AS low, round(list_max(embedding),6) AS high, round(list_avg(embedding),6) AS mean, least(len(embedding),64) AS shown FROM turn_vec", ("turn_vec",))
def embedding_summary(spark, sf_dir):
    v = F.col("embedding")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return A.turn_vec(spark, sf_dir).select("id", F.round(F.array_min(v), 6).alias("low"), F.round(F.array_max(v), 6).alias("high"), F.round(mean, 6).alias("mean"), F.least(F.size(v), F.lit(64)).cast("long").alias("shown"))


@query(
    """SELECT id, owner, (n-1)//256 AS wave, (n-1)//256*30 AS delay_s FROM (SELECT event_id AS id, 'o'||(user_id%4) AS owner, row_number() OVER (PARTITION BY user_id%4, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events)""",
)
def intake_deferral(spark, sf_dir):
    """Turns of an owner's day against a queue of fixed size: what it defers is offered again in waves."""
    e = A.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("o"), F.col("user_id") % 4).alias("owner"), "ts", F.date_trunc("day", "ts").alias("day"))
    return R.admit(e, ["owner", "day"], ["ts", "id"]).select("id", "owner", "wave", "delay_s")


@query(
    """SELECT l_orderkey*10+l_linenumber AS id, round(coalesce(exp(-greatest(epoch(TIMESTAMP '1999-01-01')-epoch(coalesce(CASE WHEN l_linenumber%3=0 THEN l_shipdate END, CASE WHEN l_linenumber%2=0 THEN o_orderdate END)),0)/86400.0/30),0.5),6) AS decay FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
)
def edge_recency(spark, sf_dir):
    li, o = A.read(spark, sf_dir, "lineitem"), A.read(spark, sf_dir, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    edge, vertex = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_shipdate").cast("timestamp")), F.when(F.col("l_linenumber") % 2 == 0, F.col("o_orderdate").cast("timestamp"))
    decay = R.edge_recency(edge, vertex, F.lit("1999-01-01").cast("timestamp"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(decay, 6).alias("decay"))


@query("SELECT turn, noun_id, mention_index, row_number() OVER (PARTITION BY turn ORDER BY mention_index, noun_id) AS place FROM (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY turn ORDER BY conf DESC, mention_index, noun_id)<=5)", ("mentions",))
def noun_top5(spark, sf_dir):
    """A turn's five surest nouns, then in the order of mention."""
    sure = Window.partitionBy("turn").orderBy(F.desc("conf"), "mention_index", "noun_id")
    said = Window.partitionBy("turn").orderBy("mention_index", "noun_id")
    top = A.mentions(spark, sf_dir).withColumn("_r", F.row_number().over(sure)).where(F.col("_r") <= C.MAX_NOUNS)
    return top.select("turn", "noun_id", "mention_index", F.row_number().over(said).alias("place"))


@query("SELECT e.src, a.p_name AS src_name, e.tgt, b.p_name AS tgt_name, e.n FROM (SELECT noun_id AS src, tgt, count(*) AS n FROM (SELECT noun_id, lead(noun_id) OVER (PARTITION BY turn ORDER BY mention_index, noun_id, conf) AS tgt, conf FROM mentions) WHERE tgt IS NOT NULL AND noun_id<>tgt AND conf>0 GROUP BY 1,2) e JOIN part a ON a.p_partkey=e.src JOIN part b ON b.p_partkey=e.tgt", ("mentions",))
def edge_nouns(spark, sf_dir):
    """Mention edges with the names of both ends: one dimension joined twice."""
    from tessera.operators.graph import mention_pairs

    e = mention_pairs(A.mentions(spark, sf_dir)).groupBy("src", "tgt").agg(F.count("*").alias("n"))
    p = A.read(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("src_name")), p.select(F.col("p_partkey").alias("tgt"), F.col("p_name").alias("tgt_name"))
    return e.join(a, "src").join(b, "tgt").select("src", "src_name", "tgt", "tgt_name", "n")


@query("SELECT id, owner, session_id FROM jobs j WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.owner=j.owner AND 's'||e.subject_id=j.session_id AND e.act='retract')", ("jobs", "evidence"))
def sessions_with_retractions(spark, sf_dir):
    """Jobs of (owner, session) pairs that hold a retraction: a semi join."""
    said = A.evidence(spark, sf_dir).where("act = 'retract'").select("owner", F.concat(F.lit("s"), "subject_id").alias("session_id")).distinct()
    return A.jobs(spark, sf_dir).join(said, ["owner", "session_id"], "left_semi").select("id", "owner", "session_id")


@query("SELECT owner, id, status, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY event_time DESC, id DESC) AS n FROM jobs) WHERE n<=50", ("jobs",))
def latest_jobs(spark, sf_dir):
    """Each owner's newest fifty jobs; the limit is the feature."""
    newest = Window.partitionBy("owner").orderBy(F.desc("event_time"), F.desc("id"))
    return A.jobs(spark, sf_dir).withColumn("place", F.row_number().over(newest)).where("place <= 50").select("owner", "id", "status", "place")


@query("SELECT min(p_partkey) OVER (PARTITION BY lower(trim(p_name))) AS keeper, p_partkey AS loser FROM part WHERE p_name<>'' QUALIFY keeper<>loser")
def same_name_links(spark, sf_dir):
    """Concepts without a vector that bear one name, ignoring case: each is linked to the smallest id, never to all."""
    p = A.read(spark, sf_dir, "part").where("p_name <> ''").select(F.col("p_partkey").alias("loser"), F.lower(F.trim("p_name")).alias("name"))
    least = p.groupBy("name").agg(F.min("loser").alias("keeper"))
    return p.join(least, "name").where("keeper <> loser").select("keeper", "loser")
