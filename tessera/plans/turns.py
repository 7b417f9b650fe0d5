"""Queries on turns and on the tables around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import turns as T
from tessera.operators.batches import paired_batches as batches
from tessera.operators.batches import with_pairs
from tessera.plans.registry import query
from tessera.sources import adapters as A


@query("SELECT id, role, ts FROM turns WHERE id IN (1000,2001,3002,8000,999999) AND owner='o0'", ("turns",))
def turns_by_ids(spark, sf_dir):
    return T.by_ids(A.turns(spark, sf_dir), [1000, 2001, 3002, 8000, 8000, "x", 999999], "o0").select("id", "role", "ts")


@query("SELECT DISTINCT id FROM turns WHERE owner='o1' AND id IN (SELECT event_id*1000 FROM events)", ("turns",))
def owned_turns(spark, sf_dir):
    asked = A.read(spark, sf_dir, "events").select((F.col("event_id") * 1000).alias("id"))
    return A.turns(spark, sf_dir).where("owner = 'o1'").join(asked, "id", "left_semi").select("id").distinct()


@query(
    """SELECT id, session_id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role FROM turns WINDOW w AS (PARTITION BY owner, session_id ORDER BY ts, id)""",
    ("turns",),
)
def turn_neighbors(spark, sf_dir):
    return T.neighbors(A.turns(spark, sf_dir))


@query(
    """SELECT t.id, t.session_id, t.role, (SELECT max(p.id) FROM turns p WHERE p.session_id=t.session_id AND p.role='assistant' AND p.id<t.id) AS previous_id FROM turns t""",
    ("turns",),
)
def previous_assistant_turn(spark, sf_dir):
    return T.previous_of_role(A.turns(spark, sf_dir))


@query(
    """WITH s AS (SELECT CASE WHEN event_id%7=0 THEN 'verify-c5-'||event_id WHEN event_id%7=1 THEN 'bench_'||event_id WHEN event_id%7=2 THEN 'c8-'||event_id WHEN event_id%7=3 THEN 'bench-x' ELSE 'chat-'||user_id END AS sid, CASE WHEN event_id%11=0 THEN 'benchmark' END AS ex FROM events)
    SELECT kind, count(*) AS n FROM (SELECT coalesce(ex, CASE WHEN starts_with(sid,'verify-c5') OR starts_with(sid,'c8-') THEN 'system_test' WHEN starts_with(sid,'bench-') OR starts_with(sid,'bench_') THEN 'benchmark' ELSE 'interactive' END) AS kind FROM s) GROUP BY 1""",
)
def session_kind(spark, sf_dir):
    e = A.read(spark, sf_dir, "events")
    k = F.col("event_id") % 7
    sid = F.when(k == 0, F.concat(F.lit("verify-c5-"), "event_id")).when(k == 1, F.concat(F.lit("bench_"), "event_id")).when(k == 2, F.concat(F.lit("c8-"), "event_id")).when(k == 3, "bench-x").otherwise(F.concat(F.lit("chat-"), "user_id"))
    kind = T.session_kind(sid, F.when(F.col("event_id") % 11 == 0, "benchmark"))
    return e.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT t.id, t.session_id FROM turns t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id=t.id)", ("turns",))
def unpassported_turns(spark, sf_dir):
    passports = A.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return A.turns(spark, sf_dir).join(passports, "id", "left_anti").select("id", "session_id")


@query(
    """SELECT 'c'||c_custkey AS chunk FROM customer WHERE 'c'||c_custkey NOT IN (SELECT 'c'||o_custkey FROM orders) AND 'mem_c'||c_custkey NOT IN (SELECT 'mem_c'||o_custkey FROM orders WHERE o_custkey%2=0)""",
)
def orphan_chunks(spark, sf_dir):
    """Chunks that no bridge (order) names by their id or its mem_ alias; one canonical key, one anti join."""
    chunk = A.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("chunk"))
    o = A.read(spark, sf_dir, "orders")
    named = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("mem_c"), "o_custkey")).otherwise(F.concat(F.lit("c"), "o_custkey"))
    bridge = o.select(F.regexp_replace(named, "^mem_", "").alias("chunk"))
    return chunk.join(bridge, "chunk", "left_anti")


@query("SELECT p_partkey AS part FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_returnflag='R' AND l_quantity>=45)")
def orphan_bridges(spark, sf_dir):
    live = A.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("part"))
    return A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(live, "part", "left_anti")


@query(
    """WITH RECURSIVE t AS (SELECT event_id AS id, user_id%10 AS s, event_type AS c, ts FROM events WHERE length(event_type)*20>=80),
    d AS (SELECT s, c, ts, min(id) AS id FROM t GROUP BY 1,2,3),
    n AS MATERIALIZED (SELECT t.s, t.c, t.ts, t.id, (d.ts, d.id) AS next FROM t ASOF JOIN d ON d.s=t.s AND d.c=t.c AND t.ts + INTERVAL 10 MINUTE <= d.ts),
    k AS (SELECT s, c, min((ts, id)) AS kept FROM t GROUP BY 1,2 UNION ALL SELECT k.s, k.c, n.next FROM k JOIN n ON n.s=k.s AND n.c=k.c AND n.ts=k.kept[1] AND n.id=k.kept[2])
    SELECT t.id, k.kept[2] AS kept_id FROM t ASOF JOIN (SELECT s, c, kept, kept[1] AS since FROM k) k ON k.s=t.s AND k.c=t.c AND t.ts>=k.since""",
)
def turn_dedup_10m(spark, sf_dir):
    e = A.read(spark, sf_dir, "events")
    t = e.select(F.col("event_id").alias("id"), F.lit("o").alias("owner"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), F.lit("user").alias("role"), F.repeat("event_type", 20).alias("content"), "ts")
    return T.dedup_trailing(t)


@query("SELECT owner, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM turns GROUP BY 1,2", ("turns",))
def owner_turn_counts(spark, sf_dir):
    return A.turns(spark, sf_dir).groupBy("owner", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT CASE WHEN length(content)<100 THEN 'embed_null' WHEN id%10=0 THEN 'graph_degraded' ELSE 'complete' END AS drain_status, count(*) AS n FROM turns GROUP BY 1", ("turns",))
def drain_status_counts(spark, sf_dir):
    status = F.when(F.length("content") < 100, "embed_null").when(F.col("id") % 10 == 0, "graph_degraded").otherwise("complete")
    return A.turns(spark, sf_dir).groupBy(status.alias("drain_status")).agg(F.count("*").alias("n"))


@query(
    """SELECT 'IN_SESSION' AS label, CAST(id AS VARCHAR) AS src, session_id AS dst FROM turns UNION ALL SELECT * FROM (SELECT 'NEXT', CAST(id AS VARCHAR), CAST(lead(id) OVER (PARTITION BY owner, session_id ORDER BY ts, id) AS VARCHAR) AS d FROM turns) WHERE d IS NOT NULL""",
    ("turns",),
)
def turn_flower_edges(spark, sf_dir):
    return T.flower_edges(A.turns(spark, sf_dir))


@query(
    """SELECT id, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY p),'') AS context FROM (SELECT t.id, unnest(CASE WHEN len(c)=0 THEN [NULL] ELSE c END) AS p FROM (SELECT id, list(id) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS c0, coalesce(c0, []) AS c FROM turns) t) GROUP BY 1""",
    ("turns",),
)
def query_enrich(spark, sf_dir):
    return T.rolling_context(A.turns(spark, sf_dir))


@query(
    """WITH n AS (SELECT id, owner, session_id, ts, substr(content,1,3) AS note_key FROM turns),
    a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY owner, note_key ORDER BY ts DESC, id)=1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY owner, session_id ORDER BY ts DESC, id)<=2)
    SELECT owner, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, id) AS rank FROM b) WHERE rank<=8""",
    ("turns",),
)
def select_notes(spark, sf_dir):
    notes = A.turns(spark, sf_dir).withColumn("note_key", F.substring("content", 1, 3))
    return T.select_notes(notes).select("owner", "id", "rank")


@query("SELECT l_orderkey AS turn, p_partkey AS noun_id, p_name AS label FROM lineitem JOIN part ON l_partkey=p_partkey")
def passports_for_turns(spark, sf_dir):
    m = A.mentions(spark, sf_dir)
    return m.join(A.read(spark, sf_dir, "part"), F.col("noun_id") == F.col("p_partkey")).select("turn", F.col("p_partkey").alias("noun_id"), F.col("p_name").alias("label"))


@query("SELECT noun_id, turn, chunk_id FROM mentions QUALIFY row_number() OVER (PARTITION BY noun_id ORDER BY turn DESC, mention_index DESC, chunk_id DESC)=1", ("mentions",))
def latest_passport(spark, sf_dir):
    m = A.mentions(spark, sf_dir)
    last = F.max(F.struct("turn", "mention_index", "chunk_id")).alias("m")
    return m.groupBy("noun_id").agg(last).select("noun_id", "m.turn", "m.chunk_id")


@query(
    """WITH t AS (SELECT l_suppkey AS chunk_id, l_partkey AS noun_id, l_orderkey AS turn, l_discount AS conf, l_shipdate AS ts, l_linenumber AS n FROM lineitem)
    SELECT chunk_id, noun_id, turn, conf FROM t QUALIFY row_number() OVER (PARTITION BY chunk_id, noun_id ORDER BY ts DESC, turn DESC, n DESC)=1""",
)
def passport_upsert(spark, sf_dir):
    """Last-wins merge by key: one aggregation, no window."""
    li = A.read(spark, sf_dir, "lineitem")
    last = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_discount")).alias("m")
    return li.groupBy(F.col("l_suppkey").alias("chunk_id"), F.col("l_partkey").alias("noun_id")).agg(last).select("chunk_id", "noun_id", F.col("m.l_orderkey").alias("turn"), F.col("m.l_discount").alias("conf"))


@query(
    """SELECT CASE WHEN o_custkey%3=0 THEN 'mem_'||o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS raw, CAST(o_custkey AS VARCHAR) AS chunk, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2""",
)
def bridge_map(spark, sf_dir):
    """Bridges whose ids come as N or mem_N, joined to chunks by the canonical key."""
    o = A.read(spark, sf_dir, "orders")
    raw = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("mem_"), "o_custkey")).otherwise(F.col("o_custkey").cast("string"))
    bridge = o.select(raw.alias("raw")).withColumn("chunk", F.regexp_replace("raw", "^mem_", ""))
    chunk = A.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("chunk"))
    return bridge.groupBy("raw", "chunk").agg(F.count("*").alias("n")).join(chunk, "chunk").select("raw", "chunk", "n")


@query("SELECT doc_id, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text), lang ORDER BY doc_id)=1")
def dedup_md5(spark, sf_dir):
    d = A.docs(spark, sf_dir).select("doc_id", F.md5("text").alias("digest"), "lang")
    return d.groupBy("digest", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


@query(
    """WITH cur AS (SELECT doc_id AS rel, CASE WHEN doc_id%9=0 THEN md5(text||'x') ELSE md5(text) END AS h FROM documents WHERE doc_id%10<>3), prev AS (SELECT doc_id AS rel, md5(text) AS h FROM documents WHERE doc_id%10<>4)
    SELECT coalesce(c.rel,p.rel) AS rel, CASE WHEN c.rel IS NULL THEN 'deleted' WHEN p.rel IS NULL OR c.h<>p.h THEN 'changed' ELSE 'skipped' END AS state, c.rel IS NOT NULL AND p.rel IS NOT NULL AND c.h<>p.h AS drift FROM cur c FULL JOIN prev p ON c.rel=p.rel""",
)
def ingest_diff(spark, sf_dir):
    from tessera.sources.files import diff_state

    d = A.docs(spark, sf_dir)
    cur = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("rel"), F.md5(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))
    prev = d.where("doc_id % 10 <> 4").select(F.col("doc_id").alias("rel"), F.md5("text").alias("hash"))
    return diff_state(cur, prev)


@query(
    """SELECT source, count(*) AS rows, count(*) FILTER (WHERE n_chars%5=0) AS missing_hash, count(*) FILTER (WHERE lang<>'en') AS missing_type FROM documents GROUP BY 1""",
)
def librarian_health(spark, sf_dir):
    return A.docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("n_chars") % 5 == 0).alias("missing_hash"), F.count_if(F.col("lang") != "en").alias("missing_type"))


@query("SELECT count(*) AS rows, count(DISTINCT (md5(text), source)) AS distinct_rows, count(*)-count(DISTINCT (md5(text), source)) AS duplicates FROM documents")
def duplicate_rows(spark, sf_dir):
    d = A.docs(spark, sf_dir).groupBy(F.md5("text").alias("h"), "source").agg(F.count("*").alias("n"))
    return d.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query(
    """WITH RECURSIVE t AS (SELECT event_id AS id, user_id%20 AS s, ts, row_number() OVER (PARTITION BY user_id%20 ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT id, s, ts, k, ts AS first, 1 AS n FROM t WHERE k=1
          UNION ALL SELECT t.id, t.s, t.ts, t.k, CASE WHEN cut THEN t.ts ELSE f.first END, CASE WHEN cut THEN 1 ELSE f.n+1 END
          FROM f JOIN t ON t.s=f.s AND t.k=f.k+1, LATERAL (SELECT f.n>=8 OR t.ts-f.ts > INTERVAL 10 MINUTE OR t.ts-f.first > INTERVAL 30 MINUTE AS cut) c)
    SELECT id, first AS batch_start, CAST(n AS INT) AS position FROM f""",
)
def model_batches(spark, sf_dir):
    e = A.read(spark, sf_dir, "events")
    return T.model_batches(e.select(F.col("event_id").alias("id"), F.lit("o").alias("owner"), (F.col("user_id") % 20).alias("session_id"), "ts"))


@query(
    """WITH RECURSIVE e AS (SELECT 'o'||(user_id%4) AS owner, 's'||user_id AS session_id, event_id AS id, CASE WHEN event_id%3=0 THEN 'assistant' ELSE 'user' END AS role, 1704067200000000+(epoch_us(ts)-1704067200000000)//64 AS time, event_id%40=7 AS closes FROM events),
    p AS (SELECT *, lag(id) OVER w AS prev, lag(role) OVER w AS prev_role, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY owner, session_id ORDER BY time, id)),
    t AS (SELECT owner, session_id, id, role, time, closes, k, CASE WHEN role<>'user' AND prev_role='user' AND id%4<>3 THEN prev END AS pair FROM p),
    f AS (SELECT owner, session_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ids, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS last, CAST(NULL AS BIGINT) AS waits,
                 CAST([] AS STRUCT(started BIGINT, ready BIGINT, reason VARCHAR, ids BIGINT[])[]) AS gone FROM t GROUP BY 1, 2
          UNION ALL
          SELECT owner, session_id, k, CASE WHEN len(o4)>0 THEN [] ELSE ids3 END, first3, last3, CASE WHEN len(o4)>0 THEN NULL ELSE waits3 END, o1||o2||o3||o4 FROM (
            SELECT *, CASE WHEN len(ids3)>0 AND closes THEN [{'started': first3, 'ready': time, 'reason': 'flush', 'ids': ids3}] WHEN len(ids3)>=8 AND waits3 IS NULL THEN [{'started': first3, 'ready': time, 'reason': 'size', 'ids': ids3}] ELSE [] END AS o4 FROM (
            SELECT *, CASE WHEN joins THEN ids2||[id] ELSE ids2 END AS ids3, CASE WHEN joins AND len(ids2)=0 THEN time ELSE first END AS first3, CASE WHEN joins THEN time ELSE last END AS last3,
              CASE WHEN role='user' THEN id WHEN waits2=pair THEN NULL ELSE waits2 END AS waits3,
              CASE WHEN joins THEN [] WHEN pair IS NULL THEN [{'started': time, 'ready': time+600000000, 'reason': 'alone', 'ids': [id]}] ELSE [{'started': time, 'ready': time+600000000, 'reason': 'pair', 'ids': [pair, id]}] END AS o3 FROM (
            SELECT *, role='user' OR coalesce(list_contains(ids2, pair), false) AS joins FROM (
            SELECT *, CASE WHEN full_ THEN [{'started': first, 'ready': time, 'reason': 'size', 'ids': ids1}] ELSE [] END AS o2, CASE WHEN full_ THEN [] ELSE ids1 END AS ids2, CASE WHEN full_ THEN NULL ELSE waits1 END AS waits2 FROM (
            SELECT *, role='user' AND len(ids1)>=8 AS full_ FROM (
            SELECT *, CASE WHEN late THEN [{'started': first, 'ready': due, 'reason': CASE WHEN due=last+600000000 THEN 'idle' ELSE 'wait' END, 'ids': ids}] ELSE [] END AS o1, CASE WHEN late THEN [] ELSE ids END AS ids1, CASE WHEN late THEN NULL ELSE waits END AS waits1 FROM (
            SELECT *, len(ids)>0 AND due<time AS late FROM (
            SELECT t.*, f.ids, f.first, f.last, f.waits, least(f.last+600000000, f.first+1800000000) AS due FROM f JOIN t ON t.owner=f.owner AND t.session_id=f.session_id AND t.k=f.k+1)))))))) ),
    ended AS (SELECT owner, session_id, {'started': first, 'ready': least(last+600000000, first+1800000000), 'reason': CASE WHEN last+600000000<=first+1800000000 THEN 'idle' ELSE 'wait' END, 'ids': ids} AS b FROM f WHERE len(ids)>0 QUALIFY k=max(k) OVER (PARTITION BY owner, session_id)),
    every AS (SELECT owner, session_id, unnest(gone) AS b FROM f UNION ALL SELECT l.owner, l.session_id, l.b FROM ended l JOIN (SELECT owner, session_id, max(k) AS k FROM t GROUP BY 1,2) m ON m.owner=l.owner AND m.session_id=l.session_id JOIN f ON f.owner=m.owner AND f.session_id=m.session_id AND f.k=m.k AND len(f.ids)>0)
    SELECT owner, session_id, make_timestamp(b.started) AS started, make_timestamp(b.ready) AS ready, b.reason AS reason, array_to_string(b.ids, ',') AS ids FROM every""",
)
def paired_batches(spark, sf_dir):
    """Sessions of users on a clock 64 times as fast; every third turn an answer, some of them without a pair."""
    e = A.read(spark, sf_dir, "events")
    start = 1_704_067_200_000_000
    turns = e.select(
        F.concat(F.lit("o"), F.col("user_id") % 4).alias("owner"),
        F.concat(F.lit("s"), "user_id").alias("session_id"),
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 3 == 0, "assistant").otherwise("user").alias("role"),
        F.timestamp_micros(F.lit(start) + F.floor((F.unix_micros("ts") - start) / 64)).alias("ts"),
        (F.col("event_id") % 40 == 7).alias("closes"),
    )
    known = with_pairs(turns).withColumn("pair", F.when(F.col("id") % 4 != 3, F.col("pair")))
    got = batches(known)
    return got.select("owner", "session_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ready").alias("ready"), "reason", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(
    """WITH o AS (SELECT DISTINCT 'o'||(user_id%4) AS owner FROM events UNION SELECT DISTINCT owner FROM turns UNION SELECT DISTINCT 'o'||(vec_id%4) FROM embeddings) SELECT owner FROM o""",
    ("turns",),
)
def explorer_owners(spark, sf_dir):
    parts = [A.evidence(spark, sf_dir), A.turns(spark, sf_dir), A.turn_vec(spark, sf_dir)]
    return parts[0].select("owner").union(parts[1].select("owner")).union(parts[2].select("owner")).distinct()


@query(
    """SELECT doc_id, json_extract_string(j,'$.kind') AS kind FROM (SELECT doc_id, CASE WHEN lang='en' THEN '{"kind":"note","lang":"en"}' ELSE '{"kind":"ref","lang":"'||lang||'","tags":["a","b"]}' END AS j FROM documents) WHERE json_extract_string(j,'$.tags[0]')='a'""",
)
def taxonomy_backfill(spark, sf_dir):
    d = A.docs(spark, sf_dir)
    j = F.when(F.col("lang") == "en", F.lit('{"kind":"note","lang":"en"}')).otherwise(F.concat(F.lit('{"kind":"ref","lang":"'), "lang", F.lit('","tags":["a","b"]}')))
    tags = F.from_json(F.get_json_object("j", "$.tags"), "array<string>")
    return d.select("doc_id", j.alias("j")).where(F.array_contains(tags, "a")).select("doc_id", F.get_json_object("j", "$.kind").alias("kind"))


