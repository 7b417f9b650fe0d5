"""Queries on claims, evidence and entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.scratch import keep
from tessera.functions.vectors import block_pairs
from tessera.operators import cascade
from tessera.operators import entities as E
from tessera.operators import merge as M
from tessera.operators import timeline as TL
from tessera.plans.registry import query
from tessera.sources import adapters as A

LIVE = """ret AS (SELECT owner, subject_id, verb, object_key, polarity, max((event_time, span_id)) AS r FROM evidence WHERE act='retract' AND speaker='user' GROUP BY ALL),
live AS (SELECT e.* FROM evidence e LEFT JOIN ret USING (owner, subject_id, verb, object_key, polarity) WHERE e.act='assert' AND (r IS NULL OR (e.event_time, e.span_id) > r))"""
EV = ("evidence",)


@query(
    """WITH RECURSIVE e AS (SELECT *, verb IN ('signup','purchase') AS fun, CASE WHEN verb IN ('signup','purchase') THEN '' ELSE object_key END AS obj FROM evidence),
    ret AS (SELECT owner, subject_id, verb, object_key, polarity, max((event_time, span_id)) AS r FROM e WHERE act='retract' AND speaker='user' GROUP BY ALL),
    g AS (SELECT e.*, act='retract' OR coalesce((event_time, span_id)<=r, false) AS gone FROM e LEFT JOIN ret USING (owner, subject_id, verb, object_key, polarity)),
    u AS (SELECT *, row_number() OVER (PARTITION BY owner, subject_id, verb, obj ORDER BY event_time, span_id, evidence_id) AS k FROM g WHERE NOT gone AND speaker='user'),
    f AS (SELECT owner, subject_id, verb, obj, CAST(0 AS BIGINT) AS k, 0 AS run, CAST(NULL AS VARCHAR) AS cur, CAST(NULL AS BIGINT) AS id, false AS point, false AS closes FROM u GROUP BY 1, 2, 3, 4
          UNION ALL SELECT u.owner, u.subject_id, u.verb, u.obj, u.k, CASE WHEN neg OR same THEN f.run ELSE f.run+1 END, CASE WHEN neg AND same THEN NULL WHEN neg THEN f.cur ELSE val END, u.evidence_id, neg AND NOT same, neg AND same
          FROM f JOIN u ON u.owner=f.owner AND u.subject_id=f.subject_id AND u.verb=f.verb AND u.obj=f.obj AND u.k=f.k+1, LATERAL (SELECT u.fun AND u.polarity='negative' AS neg, CASE WHEN u.fun THEN u.object_key ELSE u.polarity END AS val) a, LATERAL (SELECT coalesce(f.cur=a.val, false) AS same) b),
    lab AS (SELECT u.*, f.run, f.point, f.closes FROM f JOIN u ON u.evidence_id=f.id),
    iv AS (SELECT owner, subject_id, verb, obj, run, arg_min(object_key, k) AS object_key, arg_min(polarity, k) AS polarity, min(event_time) AS valid_from, max(CASE WHEN closes THEN event_time END) AS closed FROM lab WHERE NOT point GROUP BY 1, 2, 3, 4, 5),
    iw AS (SELECT *, coalesce(closed, lead(valid_from) OVER (PARTITION BY owner, subject_id, verb, obj ORDER BY run)) AS valid_to FROM iv),
    o AS (SELECT * FROM g WHERE NOT gone AND speaker<>'user'),
    h AS (SELECT o.evidence_id, max(i.run) AS last_run, max(i.run) FILTER (WHERE i.valid_from<=o.event_time) AS at_run FROM o JOIN iw i ON o.owner=i.owner AND o.subject_id=i.subject_id AND o.verb=i.verb AND o.obj=i.obj AND o.object_key=i.object_key AND o.polarity=i.polarity GROUP BY 1),
    w AS (SELECT o.*, CASE WHEN i.run IS NOT NULL AND (i.valid_to IS NULL OR o.event_time<i.valid_to) THEN i.run ELSE h.last_run END AS home FROM o LEFT JOIN h ON h.evidence_id=o.evidence_id LEFT JOIN iw i ON o.owner=i.owner AND o.subject_id=i.subject_id AND o.verb=i.verb AND o.obj=i.obj AND i.run=h.at_run),
    m AS (SELECT owner, subject_id, verb, obj, 0 AS kind, CAST(run AS BIGINT) AS sub, '' AS a, '' AS b, evidence_id, span_id, event_time FROM lab WHERE NOT point UNION ALL SELECT owner, subject_id, verb, obj, 1, k, object_key, polarity, evidence_id, span_id, event_time FROM lab WHERE point
          UNION ALL SELECT owner, subject_id, verb, obj, 0, home, '', '', evidence_id, span_id, event_time FROM w WHERE home IS NOT NULL UNION ALL SELECT owner, subject_id, verb, obj, 2, 0, object_key, polarity, evidence_id, span_id, event_time FROM w WHERE home IS NULL
          UNION ALL SELECT owner, subject_id, verb, obj, 3, 0, object_key, polarity, evidence_id, span_id, event_time FROM g WHERE gone),
    r AS (SELECT owner, subject_id, verb, obj, kind, sub, a, b, count(*) AS n, string_agg(evidence_id, ',' ORDER BY evidence_id) AS ids, max(span_id) AS span, min(event_time) AS first, max(event_time) AS last FROM m GROUP BY ALL),
    t AS (SELECT r.*, coalesce(i.object_key, r.a) AS object_key, coalesce(i.polarity, r.b) AS polarity, (['grounded','grounded','unconfirmed','retracted'])[kind+1] AS status, coalesce(i.valid_from, r.first) AS valid_from, CASE kind WHEN 0 THEN i.valid_to WHEN 1 THEN r.first WHEN 3 THEN r.last END AS valid_to,
            row_number() OVER (PARTITION BY r.owner, r.subject_id, r.verb, r.obj ORDER BY kind, sub, a, b)-1 AS row_no FROM r LEFT JOIN iw i ON kind=0 AND r.owner=i.owner AND r.subject_id=i.subject_id AND r.verb=i.verb AND r.obj=i.obj AND i.run=r.sub),
    c AS (SELECT *, owner||'/'||subject_id||'/'||verb||'/'||obj||'/'||row_no AS claim_id FROM t),
    x AS (SELECT claim_id, lead(claim_id) OVER (PARTITION BY owner, subject_id, verb, obj ORDER BY row_no) AS superseded_by FROM c WHERE status='grounded' AND valid_from IS DISTINCT FROM valid_to)
    SELECT owner, subject_id, verb, CAST(row_no AS INT) AS row_no, object_key, polarity, status, valid_from, valid_to, CAST(n AS INT) AS n_evidence, ids AS evidence, span AS span_id, c.claim_id, superseded_by FROM c LEFT JOIN x ON x.claim_id=c.claim_id""",
    EV,
)
def claim_timeline(spark, sf_dir):
    return TL.claim_timeline(A.evidence(spark, sf_dir))


@query(f"WITH {LIVE} SELECT evidence_id, owner, subject_id, verb, object_key, polarity FROM live", EV)
def live_asserts(spark, sf_dir):
    return TL.live_asserts(A.evidence(spark, sf_dir)).select("evidence_id", "owner", "subject_id", "verb", "object_key", "polarity")


@query(
    f"""WITH {LIVE}, f AS (SELECT *, max(CAST(polarity='negative' AS INT)) OVER (PARTITION BY owner, subject_id, verb) AS neg FROM live WHERE speaker='user' AND verb IN ('signup','purchase')),
    n AS (SELECT *, CASE WHEN object_key IS NOT DISTINCT FROM lag(object_key) OVER w THEN 0 ELSE 1 END AS fresh FROM f WHERE neg=0 WINDOW w AS (PARTITION BY owner, subject_id, verb ORDER BY event_time, span_id, evidence_id)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY owner, subject_id, verb ORDER BY event_time, span_id, evidence_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
    g AS (SELECT owner, subject_id, verb, CAST(run AS INT) AS run, min(object_key) AS object_key, min(event_time) AS valid_from, count(*) AS n_evidence FROM r GROUP BY 1,2,3,4)
    SELECT owner, subject_id, verb, run, object_key, valid_from, lead(valid_from) OVER (PARTITION BY owner, subject_id, verb ORDER BY run) AS valid_to, n_evidence FROM g""",
    EV,
)
def functional_intervals(spark, sf_dir):
    return TL.functional_intervals(A.evidence(spark, sf_dir))


@query(
    f"""WITH {LIVE}, u AS (SELECT * FROM live WHERE speaker='user') SELECT owner, subject_id, verb, object_key, polarity FROM (SELECT *, row_number() OVER (PARTITION BY owner, subject_id, verb ORDER BY event_time DESC, span_id DESC, evidence_id DESC) AS n FROM u) WHERE n=1 AND polarity='positive'""",
    EV,
)
def claims_current(spark, sf_dir):
    """The value now held of each subject and verb: the latest live user assert, if positive."""
    last = F.max(F.struct("event_time", "span_id", "evidence_id", "object_key", "polarity")).alias("m")
    live = TL.live_asserts(A.evidence(spark, sf_dir)).where("speaker = 'user'")
    return live.groupBy("owner", "subject_id", "verb").agg(last).where("m.polarity = 'positive'").select("owner", "subject_id", "verb", "m.object_key", "m.polarity")


@query("SELECT owner, verb, act, count(*) AS n, count(*) FILTER (WHERE polarity='negative') AS negatives FROM evidence GROUP BY 1,2,3", EV)
def claims_counts(spark, sf_dir):
    return A.evidence(spark, sf_dir).groupBy("owner", "verb", "act").agg(F.count("*").alias("n"), F.count_if(F.col("polarity") == "negative").alias("negatives"))


CLAIM = "owner, subject_id, verb, object_key, polarity"


@query(f"SELECT {CLAIM}, count(*) AS n, min(event_time) AS first_seen, max(event_time) AS last_seen FROM evidence GROUP BY ALL", EV)
def claim_event_time(spark, sf_dir):
    return A.evidence(spark, sf_dir).groupBy(*CLAIM.split(", ")).agg(F.count("*").alias("n"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))


@query(
    f"""WITH c AS (SELECT {CLAIM}, min(evidence_id) AS claim_id FROM evidence GROUP BY ALL) SELECT c.claim_id, e.evidence_id, t.role FROM c JOIN evidence e USING ({CLAIM}) JOIN turns t ON t.id=e.span_id*1000 WHERE e.act='assert'""",
    ("evidence", "turns"),
)
def claims_with_evidence(spark, sf_dir):
    e = A.evidence(spark, sf_dir)
    c = e.groupBy(*CLAIM.split(", ")).agg(F.min("evidence_id").alias("claim_id"))
    t = A.turns(spark, sf_dir).select((F.col("id") / 1000).alias("at"), "role").where("at = floor(at)").select(F.col("at").cast("long").alias("span_id"), "role")
    return e.where("act = 'assert'").join(t, "span_id").join(c, CLAIM.split(", ")).select("claim_id", "evidence_id", "role")


@query(
    """WITH f AS (SELECT evidence_id, lead(evidence_id) OVER (PARTITION BY owner, subject_id, verb ORDER BY event_time, span_id) AS superseded_by FROM evidence WHERE act='assert' AND speaker='user' AND polarity='positive') SELECT * FROM f""",
    EV,
)
def claim_chain(spark, sf_dir):
    w = Window.partitionBy("owner", "subject_id", "verb").orderBy("event_time", "span_id")
    e = A.evidence(spark, sf_dir).where("act = 'assert' and speaker = 'user' and polarity = 'positive'")
    return e.select("evidence_id", F.lead("evidence_id").over(w).alias("superseded_by"))


@query(
    f"""SELECT evidence_id, n AS seen_count FROM (SELECT evidence_id, count(*) OVER (PARTITION BY {CLAIM}) AS n, min(evidence_id) OVER (PARTITION BY {CLAIM}) AS keep FROM evidence) WHERE evidence_id=keep""",
    EV,
)
def live_claim_dedup(spark, sf_dir):
    e = A.evidence(spark, sf_dir)
    return e.groupBy(*CLAIM.split(", ")).agg(F.min("evidence_id").alias("evidence_id"), F.count("*").alias("seen_count")).select("evidence_id", "seen_count")


@query(
    """WITH o AS (SELECT *, lag(object_key) OVER w AS p FROM evidence WHERE verb IN ('signup','purchase') AND act='assert' WINDOW w AS (PARTITION BY owner, subject_id, verb ORDER BY event_time, evidence_id))
    SELECT owner, subject_id, verb, evidence_id, object_key, lead(event_time) OVER (PARTITION BY owner, subject_id, verb ORDER BY event_time, evidence_id) AS until FROM o WHERE p IS DISTINCT FROM object_key""",
    EV,
)
def functional_runs(spark, sf_dir):
    w = Window.partitionBy("owner", "subject_id", "verb").orderBy("event_time", "evidence_id")
    o = A.evidence(spark, sf_dir).where("verb in ('signup', 'purchase') and act = 'assert'").withColumn("p", F.lag("object_key").over(w))
    fresh = o.where(~F.col("p").eqNullSafe(F.col("object_key")))
    return fresh.select("owner", "subject_id", "verb", "evidence_id", "object_key", F.lead("event_time").over(w).alias("until"))


@query(
    f"""WITH {LIVE}, p AS (SELECT owner, subject_id, verb, count(*) AS n FROM live GROUP BY 1,2,3), q AS (SELECT owner, subject_id, verb, count(*) AS n FROM evidence WHERE act='assert' GROUP BY 1,2,3)
    SELECT owner, subject_id, verb FROM q LEFT JOIN p USING (owner, subject_id, verb) WHERE p.n IS NULL OR p.n<>q.n UNION SELECT owner, subject_id, verb FROM evidence WHERE act='retract' AND speaker='assistant'""",
    EV,
)
def drift_keys(spark, sf_dir):
    """Keys whose projection may differ from their evidence: two arms, distinct."""
    e = A.evidence(spark, sf_dir)
    k = ["owner", "subject_id", "verb"]
    p = TL.live_asserts(e).groupBy(*k).agg(F.count("*").alias("p"))
    q = e.where("act = 'assert'").groupBy(*k).agg(F.count("*").alias("q"))
    one = q.join(p, k, "left").where("p is null or p <> q").select(*k)
    return one.union(e.where("act = 'retract' and speaker = 'assistant'").select(*k)).distinct()


@query(
    """SELECT a.evidence_id, max(b.evidence_id) AS superseded_by FROM evidence a JOIN evidence b ON a.owner=b.owner AND a.subject_id=b.subject_id AND a.verb=b.verb AND a.object_key=b.object_key AND a.polarity=b.polarity AND a.act=b.act WHERE a.speaker='user' AND b.speaker='assistant' AND b.evidence_id>a.evidence_id GROUP BY 1""",
    EV,
)
def evidence_supersede(spark, sf_dir):
    """Rule evidence that later model evidence of the same six keys replaces: a maximum, no self join."""
    k = ["owner", "subject_id", "verb", "object_key", "polarity", "act"]
    e = A.evidence(spark, sf_dir)
    last = e.where("speaker = 'assistant'").groupBy(*k).agg(F.max("evidence_id").alias("superseded_by"))
    return e.where("speaker = 'user'").join(last, k).where("superseded_by > evidence_id").select("evidence_id", "superseded_by")


@query(
    """WITH r AS (SELECT owner, subject_id, verb, object_key, evidence_id, CASE polarity WHEN 'negative' THEN 'positive' ELSE 'negative' END AS flipped FROM evidence WHERE evidence_id%97=0)
    SELECT r.evidence_id AS repair, count(*) AS retracted, min(e.evidence_id) AS first FROM r JOIN evidence e ON e.owner=r.owner AND e.subject_id=r.subject_id AND e.verb=r.verb AND e.object_key=r.object_key AND e.polarity=r.flipped AND e.evidence_id<r.evidence_id GROUP BY 1""",
    EV,
)
def repair_retractions(spark, sf_dir):
    e = A.evidence(spark, sf_dir)
    k = ["owner", "subject_id", "verb", "object_key", "polarity"]
    flipped = F.when(F.col("polarity") == "negative", "positive").otherwise("negative")
    r = e.where("evidence_id % 97 = 0").select(*k[:4], flipped.alias("polarity"), F.col("evidence_id").alias("repair"))
    return r.join(e, k).where("evidence_id < repair").groupBy("repair").agg(F.count("*").alias("retracted"), F.min("evidence_id").alias("first"))


@query(
    """WITH e AS (SELECT * FROM evidence WHERE span_id%10<>0), d AS (SELECT DISTINCT owner, subject_id, verb FROM evidence WHERE span_id%10=0)
    SELECT owner, subject_id, verb, count(*) AS left_evidence, max(event_time) AS last_seen FROM e JOIN d USING (owner, subject_id, verb) GROUP BY 1,2,3""",
    EV,
)
def delete_spans_rebuild(spark, sf_dir):
    """After spans go: what is left of the keys they touched, to be rebuilt."""
    e = A.evidence(spark, sf_dir)
    k = ["owner", "subject_id", "verb"]
    touched = e.where("span_id % 10 = 0").select(*k).distinct()
    return e.where("span_id % 10 <> 0").join(touched, k, "left_semi").groupBy(*k).agg(F.count("*").alias("left_evidence"), F.max("event_time").alias("last_seen"))


@query(
    """SELECT subject_id, count(DISTINCT object_key) FILTER (WHERE act='assert') AS live_claims, count(DISTINCT object_key) FILTER (WHERE act='retract') AS retracted, least(2, count(DISTINCT object_key) FILTER (WHERE act='retract')) AS shown FROM evidence GROUP BY 1""",
    EV,
)
def span_overlays(spark, sf_dir):
    live, gone = (F.count_distinct(F.when(F.col("act") == a, F.col("object_key"))) for a in ("assert", "retract"))
    return A.evidence(spark, sf_dir).groupBy("subject_id").agg(live.alias("live_claims"), gone.alias("retracted")).withColumn("shown", F.least(F.lit(2).cast("long"), "retracted"))


@query(
    """SELECT c_custkey AS loser, c_custkey//10*10 AS keeper FROM customer WHERE c_custkey%10<>0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='F')""",
)
def unjustified_merges(spark, sf_dir):
    c = A.read(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    reason = A.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(reason, "c_custkey", "left_anti").select(F.col("c_custkey").alias("loser"), (F.floor(F.col("c_custkey") / 10) * 10).cast("long").alias("keeper"))


@query(
    """WITH RECURSIVE m(id, z, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT id, z//3, depth+1 FROM m WHERE z%3=0 AND z>0 AND depth<16) SELECT id, z AS root, depth FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth DESC)=1""",
)
def merge_chain(spark, sf_dir):
    c = A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    merged = c.select("id", F.when((F.col("id") % 3 == 0) & (F.col("id") > 0), F.floor(F.col("id") / 3).cast("long")).alias("merged_into"))
    return E.merge_chain(merged)


@query(
    """WITH RECURSIVE p AS (SELECT a.id AS a, b.id AS b FROM turn_vec a JOIN turn_vec b ON a.id<>b.id WHERE round(list_cosine_similarity(a.embedding,b.embedding),9)>=0.4), r AS (SELECT DISTINCT a AS id, a AS z FROM p UNION SELECT r.id, p.b FROM r JOIN p ON p.a=r.z)
    SELECT id, min(z) AS keeper FROM r GROUP BY 1""",
    ("turn_vec",),
)
def compaction_keepers(spark, sf_dir):
    v = A.turn_vec(spark, sf_dir).select("id", F.col("embedding").alias("v"))
    pairs = block_pairs(v, v, 0.4, undirected=True)
    return E.components(pairs.select(F.col("id").alias("a"), F.col("other").alias("b")))


@query(
    """WITH RECURSIVE l AS (SELECT 'p'||p_partkey AS surface, 'p'||(CASE WHEN p_partkey%5=0 THEN p_partkey-4 ELSE p_partkey+1 END) AS canon, p_size AS born FROM part WHERE p_partkey%7<>3),
    p AS (SELECT surface, canon AS now, [surface] AS seen, false AS loop, 1 AS k FROM l
          UNION ALL SELECT surface, CASE WHEN stop THEN now ELSE next END, CASE WHEN stop THEN seen ELSE seen||[now] END, loop OR met, k+1 FROM (
            SELECT p.*, l.canon AS next, list_contains(seen, now) AS met, loop OR l.canon IS NULL OR list_contains(seen, now) AS stop FROM p LEFT JOIN l ON l.surface=p.now WHERE k<8)),
    f AS (SELECT surface, now, seen, loop OR list_contains(seen, now) AS loop FROM p WHERE k=8),
    c AS (SELECT f.surface, min((length(m)<4, l.born, m)) AS best FROM (SELECT surface, unnest(seen) AS m FROM f WHERE loop) f JOIN l ON l.surface=f.m GROUP BY 1)
    SELECT f.surface, coalesce(best[3], now) AS root FROM f LEFT JOIN c ON c.surface=f.surface""",
)
def alias_resolve(spark, sf_dir):
    p = A.read(spark, sf_dir, "part")
    links = p.select(F.concat(F.lit("p"), "p_partkey").alias("surface"), F.concat(F.lit("p"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") - 4).otherwise(F.col("p_partkey") + 1)).alias("canon"), F.col("p_size").alias("born")).where("p_partkey % 7 <> 3")
    return E.resolve_aliases(links)


@query(
    """SELECT owner, subject_id, bool_or(act='retract') AS any_retract, bool_and(speaker='user') AS all_user, bool_or(polarity='negative') AND NOT bool_and(act='assert') AS suspicious FROM evidence GROUP BY 1,2""",
    EV,
)
def legacy_check(spark, sf_dir):
    return A.evidence(spark, sf_dir).groupBy("owner", "subject_id").agg(F.bool_or(F.col("act") == "retract").alias("any_retract"), F.bool_and(F.col("speaker") == "user").alias("all_user"), (F.bool_or(F.col("polarity") == "negative") & ~F.bool_and(F.col("act") == "assert")).alias("suspicious"))


@query(
    """WITH e AS (SELECT verb, object_key, polarity, count(*) FILTER (WHERE evidence_id%2=0) AS expected, count(*) FILTER (WHERE evidence_id%2=1) AS actual FROM evidence GROUP BY 1,2,3)
    SELECT verb, sum(least(expected,actual)) AS hits, round(sum(least(expected,actual))/CAST(sum(actual) AS DOUBLE),6) AS precision, round(sum(least(expected,actual))/CAST(sum(expected) AS DOUBLE),6) AS recall FROM e GROUP BY 1""",
    EV,
)
def claim_prf(spark, sf_dir):
    e = A.evidence(spark, sf_dir).groupBy("verb", "object_key", "polarity").agg(F.count_if(F.col("evidence_id") % 2 == 0).alias("expected"), F.count_if(F.col("evidence_id") % 2 == 1).alias("actual"))
    hits = F.sum(F.least("expected", "actual"))
    return e.groupBy("verb").agg(hits.alias("hits"), F.round(hits / F.sum("actual"), 6).alias("precision"), F.round(hits / F.sum("expected"), 6).alias("recall"))


@query(
    """WITH p AS (SELECT a.owner, sign(epoch_us(b.event_time)-epoch_us(a.event_time)) AS s FROM evidence a JOIN evidence b ON a.subject_id=b.subject_id AND a.verb=b.verb AND a.evidence_id<b.evidence_id)
    SELECT owner, round(avg(CASE WHEN s>0 THEN 1.0 ELSE 0.0 END),6) AS concordance, count(*) AS pairs FROM p WHERE s<>0 GROUP BY 1""",
    EV,
)
def event_time_concordance(spark, sf_dir):
    """Share of a timeline's pairs that stand in the order of their ids, ties left out."""
    e = A.evidence(spark, sf_dir).select("owner", "subject_id", "verb", "evidence_id", F.unix_micros("event_time").alias("t"))
    b = e.select("subject_id", "verb", F.col("evidence_id").alias("eb"), F.col("t").alias("tb"))
    p = e.join(b, ["subject_id", "verb"]).where("evidence_id < eb and t <> tb")
    return p.groupBy("owner").agg(F.round(F.avg((F.col("tb") > F.col("t")).cast("double")), 6).alias("concordance"), F.count("*").alias("pairs"))


@query(
    f"""WITH a AS (SELECT DISTINCT {CLAIM} FROM evidence WHERE evidence_id%3=0), b AS (SELECT DISTINCT {CLAIM} FROM evidence WHERE evidence_id%3=1)
    SELECT 'lost' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'added', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    EV,
)
def claims_diff(spark, sf_dir):
    e, k = A.evidence(spark, sf_dir), CLAIM.split(", ")
    a, b = (e.where(f"evidence_id % 3 = {r}").select(*k).distinct() for r in (0, 1))
    return a.join(b, k, "left_anti").select(F.lit("lost").alias("side"), *k).union(b.join(a, k, "left_anti").select(F.lit("added"), *k))


@query(
    f"""SELECT {CLAIM}, CASE WHEN max(event_time) FILTER (WHERE act='retract' AND speaker='user') >= max(event_time) FILTER (WHERE act='assert') THEN 'retracted' WHEN count(*) FILTER (WHERE act='assert' AND speaker='user')>0 THEN 'grounded' WHEN count(*) FILTER (WHERE act='assert')>0 THEN 'unconfirmed' ELSE 'retracted' END AS status FROM evidence GROUP BY ALL""",
    EV,
)
def claim_status(spark, sf_dir):
    is_assert, is_user = F.col("act") == "assert", F.col("speaker") == "user"
    g = A.evidence(spark, sf_dir).groupBy(*CLAIM.split(", ")).agg(F.max(F.when(~is_assert & is_user, F.col("event_time"))).alias("r"), F.max(F.when(is_assert, F.col("event_time"))).alias("a"), F.count_if(is_assert & is_user).alias("u"), F.count_if(is_assert).alias("n"))
    status = F.when(F.col("r") >= F.col("a"), "retracted").when(F.col("u") > 0, "grounded").when(F.col("n") > 0, "unconfirmed").otherwise("retracted")
    return g.select(*CLAIM.split(", "), status.alias("status"))


@query(
    """SELECT evidence_id, 'user '||subject_id||' '||CASE WHEN polarity='negative' THEN 'does not '||verb ELSE verb||'s' END||' '||replace(object_key,'l:','item ') AS fact FROM evidence""",
    EV,
)
def fact_text(spark, sf_dir):
    phrase = F.when(F.col("polarity") == "negative", F.concat(F.lit("does not "), "verb")).otherwise(F.concat("verb", F.lit("s")))
    fact = F.concat_ws(" ", F.concat(F.lit("user "), "subject_id"), phrase, F.replace("object_key", F.lit("l:"), F.lit("item ")))
    return A.evidence(spark, sf_dir).select("evidence_id", fact.alias("fact"))


@query(
    f"""WITH c AS (SELECT {CLAIM}, min(evidence_id) AS claim_id, count(*) AS n, bool_or(speaker='assistant') AS by_model, max(event_time) AS last_seen FROM evidence GROUP BY ALL)
    SELECT claim_id, verb, n FROM c WHERE verb='purchase' AND by_model AND contains(object_key,'3') ORDER BY n DESC, claim_id LIMIT 100""",
    EV,
)
def explorer_claim_filter(spark, sf_dir):
    c = A.evidence(spark, sf_dir).where("verb = 'purchase' and contains(object_key, '3')").groupBy(*CLAIM.split(", ")).agg(F.min("evidence_id").alias("claim_id"), F.count("*").alias("n"), F.bool_or(F.col("speaker") == "assistant").alias("m"))
    return c.where("m").select("claim_id", "verb", "n").orderBy(F.desc("n"), "claim_id").limit(100)


@query(
    """SELECT 'evidence' AS what, count(*) AS n FROM evidence UNION ALL SELECT 'turns', count(*) FROM turns UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'owners', count(DISTINCT owner) FROM evidence UNION ALL SELECT 'retracts', count(*) FROM evidence WHERE act='retract'""",
    ("evidence", "turns"),
)
def explorer_counts(spark, sf_dir):
    """One row per count; evidence is read once for its three."""
    e = A.evidence(spark, sf_dir).agg(F.count("*").alias("evidence"), F.count_distinct("owner").alias("owners"), F.count_if(F.col("act") == "retract").alias("retracts"))
    out = e.select(F.explode(F.create_map(F.lit("evidence"), "evidence", F.lit("owners"), "owners", F.lit("retracts"), "retracts")).alias("what", "n"))
    for name, df in (("turns", A.turns(spark, sf_dir)), ("documents", A.docs(spark, sf_dir))):
        out = out.union(df.agg(F.count("*")).select(F.lit(name), "count(1)"))
    return out


@query("SELECT verb, polarity, speaker, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM evidence GROUP BY 1,2,3", EV)
def explorer_stats(spark, sf_dir):
    return A.evidence(spark, sf_dir).groupBy("verb", "polarity", "speaker").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"))


@query(
    f"""WITH c AS (SELECT {CLAIM}, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY evidence_id) AS evidence FROM evidence GROUP BY ALL)
    SELECT owner, subject_id, count(*) AS claims, string_agg(verb||'='||object_key||'['||evidence||']', ';' ORDER BY verb, object_key, polarity) AS claims_text FROM c GROUP BY 1,2""",
    EV,
)
def explorer_snapshot(spark, sf_dir):
    """Claims with their evidence nested under each entity."""
    e = A.evidence(spark, sf_dir)
    c = e.groupBy(*CLAIM.split(", ")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("evidence_id")), lambda x: x.cast("string")), ",").alias("evidence"))
    text = F.concat("verb", F.lit("="), "object_key", F.lit("["), "evidence", F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("verb", "object_key", "polarity", text.alias("t"))))
    return c.groupBy("owner", "subject_id").agg(F.count("*").alias("claims"), F.array_join(F.transform(rows, lambda r: r["t"]), ";").alias("claims_text"))


@query(
    """SELECT event_type AS verb, event_id AS evidence_id, user_id AS subject_id, md5('o'||(user_id%4)||'|'||user_id||'|'||event_type||'|'||k) AS event_key FROM ev0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY ts, event_id)=1""",
    ("ev0",),
)
def evidence_build(spark, sf_dir):
    """Idempotent insert: the first of each event key."""
    e = A.read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    first = e.groupBy("user_id", "event_type", "k").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    key = F.md5(F.concat(F.lit("o"), F.col("user_id") % 4, F.lit("|"), "user_id", F.lit("|"), "event_type", F.lit("|"), "k"))
    return first.select(F.col("event_type").alias("verb"), F.col("m.event_id").alias("evidence_id"), F.col("user_id").alias("subject_id"), key.alias("event_key"))


@query(
    """WITH m AS (SELECT c_custkey AS id, CASE WHEN c_custkey%6=0 THEN c_custkey//6 ELSE c_custkey END AS root FROM customer) SELECT e.evidence_id, coalesce(m.root, e.subject_id) AS subject_id FROM evidence e LEFT JOIN m ON m.id=e.subject_id""",
    EV,
)
def reresolve(spark, sf_dir):
    """Subjects of evidence moved to the roots of merged entities."""
    c = A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_custkey") % 6 == 0, F.floor(F.col("c_custkey") / 6)).otherwise(F.col("c_custkey")).cast("long").alias("root"))
    return A.evidence(spark, sf_dir).join(c, "subject_id", "left").select("evidence_id", F.coalesce("root", "subject_id").alias("subject_id"))


@query(
    """WITH RECURSIVE cust AS (SELECT c_custkey AS id FROM customer WHERE c_custkey%50=0 UNION SELECT c.c_custkey FROM customer c JOIN cust d ON c.c_custkey%3=0 AND c.c_custkey>0 AND c.c_custkey//3=d.id),
    ord AS (SELECT o_orderkey AS id FROM orders JOIN cust ON o_custkey=cust.id), li AS (SELECT l_orderkey*10+l_linenumber AS id, o_custkey||':'||l_partkey AS claim, l_partkey AS part, l_orderkey IN (SELECT id FROM ord) AS gone FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
    cl AS (SELECT claim, any_value(part) AS part, bool_and(gone) AS gone FROM li GROUP BY 1), pa AS (SELECT part, bool_and(gone) AS gone FROM cl GROUP BY 1),
    d AS (SELECT 'customer' AS relation, CAST(id AS VARCHAR) AS id FROM cust UNION ALL SELECT 'orders', CAST(id AS VARCHAR) FROM ord UNION ALL SELECT DISTINCT 'lineitem', CAST(id AS VARCHAR) FROM li WHERE gone UNION ALL SELECT 'claim', claim FROM cl WHERE gone UNION ALL SELECT 'part', CAST(part AS VARCHAR) FROM pa WHERE gone)
    SELECT relation, id, 'delete' AS deed, NULL::VARCHAR AS lost FROM d UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), 'unlink', 'customer:'||user_id FROM events WHERE user_id IN (SELECT id FROM cust)""",
)
def cascade_delete(spark, sf_dir):
    """Every fiftieth customer goes: with those merged into it, its orders and lines; claims and parts go with their last support, events lose their user."""
    c, o, li = (A.read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    claim = F.concat_ws(":", "o_custkey", "l_partkey").alias("claim")
    # Read twice, for the claims of lines and for the parts of claims.
    owned = keep(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(line, claim, "l_partkey"), "owned")

    def ref(rows, child, child_id, parent, parent_id, action):
        return cascade.Reference(child, parent, rows.select(child_id.alias("child_id"), parent_id.alias("parent_id")), action)

    every = [
        ref(c.where("c_custkey % 3 = 0 and c_custkey > 0"), "customer", F.col("c_custkey"), "customer", F.floor(F.col("c_custkey") / 3), cascade.CASCADE),
        ref(o, "orders", F.col("o_orderkey"), "customer", F.col("o_custkey"), cascade.CASCADE),
        ref(li, "lineitem", line, "orders", F.col("l_orderkey"), cascade.CASCADE),
        ref(owned, "claim", F.col("claim"), "lineitem", F.col("line"), cascade.SUPPORT),
        ref(owned, "part", F.col("l_partkey"), "claim", F.col("claim"), cascade.SUPPORT),
        ref(A.read(spark, sf_dir, "events"), "event", F.col("event_id"), "customer", F.col("user_id"), cascade.UNLINK),
    ]
    return cascade.deletion_closure(every, c.where("c_custkey % 50 = 0").select(F.lit("customer").alias("relation"), F.col("c_custkey").alias("id")))


@query(
    """WITH RECURSIVE m(id, z) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT id, z//3 FROM m WHERE z%3=0 AND z>0), k AS (SELECT id, min(z) AS keeper FROM m GROUP BY 1),
    n AS (SELECT keeper, sum(p_retailprice) AS weight, min(p_size) AS born FROM part JOIN k ON id=p_partkey GROUP BY 1),
    e AS (SELECT a.keeper AS src, b.keeper AS dst, max(weight) AS weight, max(cosine) AS cosine FROM (SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS weight, l_discount AS cosine FROM lineitem) x JOIN k a ON a.id=src JOIN k b ON b.id=dst WHERE a.keeper<>b.keeper GROUP BY 1,2),
    b AS (SELECT DISTINCT l_orderkey AS chunk, keeper FROM lineitem JOIN k ON id=l_partkey), s AS (SELECT p_size AS surface, arg_max(keeper, (p_retailprice, keeper)) AS keeper, max(p_retailprice) AS seen FROM part JOIN k ON id=p_partkey GROUP BY 1)
    SELECT 'node' AS relation, keeper AS a, NULL::BIGINT AS b, round(weight,4) AS x, CAST(born AS DOUBLE) AS y FROM n UNION ALL SELECT 'edge', src, dst, weight, cosine FROM e UNION ALL SELECT 'bridge', chunk, keeper, NULL, NULL FROM b UNION ALL SELECT 'alias', surface, keeper, seen, NULL FROM s""",
)
def merge_entities(spark, sf_dir):
    """Parts merged into a third of their number: weights are summed, edges keep their strongest, bridges move, aliases keep the last."""
    p, li = A.read(spark, sf_dir, "part"), A.read(spark, sf_dir, "lineitem")
    ids = p.select(F.col("p_partkey").alias("id"))
    keepers = E.merge_chain(ids.withColumn("merged_into", F.when((F.col("id") % 3 == 0) & (F.col("id") > 0), F.floor(F.col("id") / 3).cast("long")))).select("id", F.col("root").alias("keeper"))
    edges = li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"), F.col("l_discount").alias("cosine"))
    edges = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    got = M.merge_entities(
        keepers,
        {
            "node": M.Relation(p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("weight"), F.col("p_size").alias("born")), ("id",), ("id",), {"weight": F.sum("weight"), "born": F.min("born")}),
            "edge": M.Relation(edges, ("src", "dst"), ("src", "dst"), {"weight": F.max("weight"), "cosine": F.max("cosine")}, loops=False),
            "bridge": M.Relation(li.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("id")), ("id",), ("chunk", "id")),
            "alias": M.Relation(p.select(F.col("p_size").cast("long").alias("surface"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("seen")), ("id",), ("surface",), {"id": M.last_by("id", "seen"), "seen": F.max("seen")}),
        },
    )
    none = F.lit(None)
    row = lambda name, a, b, x, y: got[name].select(F.lit(name).alias("relation"), F.col(a).alias("a"), (F.col(b) if b else none.cast("long")).alias("b"), (x if x is not None else none.cast("double")).alias("x"), (F.col(y).cast("double") if y else none.cast("double")).alias("y"))
    return row("node", "id", None, F.round("weight", 4), "born").unionByName(row("edge", "src", "dst", F.col("weight"), "cosine")).unionByName(row("bridge", "chunk", "id", None, None)).unionByName(row("alias", "surface", "id", F.col("seen"), None))
