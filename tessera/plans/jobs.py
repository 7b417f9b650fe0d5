"""Queries on jobs and work memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import jobs as J
from tessera.plans.registry import query
from tessera.plans.text import VERDICT
from tessera.sources import adapters as A

LIVE = "status IN ('pending','retryable','leased') AND attempts<5"


@query("SELECT owner, kind, status, count(*) AS n, max(attempts) AS most_attempts FROM jobs GROUP BY 1,2,3", ("jobs",))
def job_counts(spark, sf_dir):
    return A.jobs(spark, sf_dir).groupBy("owner", "kind", "status").agg(F.count("*").alias("n"), F.max("attempts").alias("most_attempts"))


@query(
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY owner, kind, session_id ORDER BY event_time, id) AS n, max(CAST(priority=0 AS INT)) OVER (PARTITION BY owner, kind) AS u FROM jobs WHERE {LIVE})
    SELECT id, owner, kind, session_id, priority, row_number() OVER (PARTITION BY owner, kind ORDER BY priority, event_time NULLS LAST, id) AS rank FROM l WHERE n=1 AND (priority=0 OR u=0)""",
    ("jobs",),
)
def job_claim_order(spark, sf_dir):
    return J.claim_order(A.jobs(spark, sf_dir))


@query(
    f"""SELECT id, CASE WHEN NOT ({LIVE}) THEN CASE WHEN status IN ('pending','retryable','leased') THEN 'parked' ELSE status END WHEN id%3=0 THEN 'done' WHEN attempts+1>=5 THEN 'failed' ELSE 'retryable' END AS status, CASE WHEN {LIVE} THEN attempts+1 ELSE attempts END AS attempts,
    CASE WHEN {LIVE} AND id%3<>0 AND attempts+1<5 THEN ([5,30,120,600,600])[least(attempts,4)+1] END AS wait_s FROM jobs""",
    ("jobs",),
)
def job_transition(spark, sf_dir):
    j = A.jobs(spark, sf_dir)
    t = J.transition(F.col("status"), F.col("attempts"), F.when(F.col("id") % 3 == 0, "ok").otherwise("error"))
    return j.select("id", t.alias("t")).select("id", "t.status", "t.attempts", "t.wait_s")


@query("SELECT kind, count(*) FILTER (WHERE status='pending') AS pending, count(*) FILTER (WHERE status='parked') AS dead, count(DISTINCT session_id) AS sessions FROM jobs GROUP BY 1", ("jobs",))
def outbox_counts(spark, sf_dir):
    return A.jobs(spark, sf_dir).groupBy("kind").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "parked").alias("dead"), F.count_distinct("session_id").alias("sessions"))


@query("SELECT kind, sum(attempts) AS calls, sum(attempts) FILTER (WHERE status='done') AS good, round(sum(attempts) FILTER (WHERE status='done')/CAST(nullif(sum(attempts),0) AS DOUBLE),6) AS ratio FROM jobs GROUP BY 1", ("jobs",))
def model_usage(spark, sf_dir):
    good = F.sum(F.when(F.col("status") == "done", F.col("attempts")))
    return A.jobs(spark, sf_dir).groupBy("kind").agg(F.sum("attempts").alias("calls"), good.alias("good"), F.round(good / F.nullif(F.sum("attempts"), F.lit(0)), 6).alias("ratio"))


@query(
    """WITH m AS (SELECT event_id AS id, user_id%50 AS session_id, ts, CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'assistant' ELSE 'tool' END AS role, event_type||k AS call_id FROM ev0),
    l AS (SELECT *, last_value(CASE WHEN role<>'tool' THEN {'role':role,'id':id} END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, row_number() OVER (PARTITION BY session_id, call_id ORDER BY ts, id)-1 AS occurrence FROM m)
    SELECT id, session_id, call_id, occurrence, CASE WHEN p.role='assistant' THEN p.id END AS assistant_id FROM l WHERE role='tool'""",
    ("ev0",),
)
def work_events(spark, sf_dir):
    e = A.read(spark, sf_dir, "events")
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "assistant").otherwise("tool")
    call = F.concat("event_type", F.get_json_object("props", "$.k").cast("int"))
    return J.work_events(e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("session_id"), "ts", role.alias("role"), call.alias("call_id")))


@query(
    f"""WITH v AS (SELECT *, CASE WHEN role='user' THEN {VERDICT} END AS v FROM turns)
    SELECT owner, session_id, coalesce(arg_min(id, (ts, id)) FILTER (WHERE role='user'), arg_min(id, (ts, id))) AS ask_id, arg_max(id, (ts, id)) FILTER (WHERE role='assistant') AS outcome_id, coalesce(arg_max(v, (ts, id)) FILTER (WHERE v IS NOT NULL), 'unknown') AS status FROM v GROUP BY 1, 2""",
    ("turns",),
)
def work_items(spark, sf_dir):
    return J.work_items(A.turns(spark, sf_dir), X.verdict(F.col("content")))


@query(
    """WITH k AS (SELECT user_id AS topic, event_id AS item FROM events WHERE NOT (value<10)), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY item DESC) AS n, lead(item) OVER (PARTITION BY topic ORDER BY item DESC) AS restores FROM k) SELECT topic, item, restores FROM r WHERE n=1""",
)
def work_retract(spark, sf_dir):
    e = A.read(spark, sf_dir, "events")
    return J.current_items(e.select(F.col("user_id").alias("topic"), F.col("event_id").alias("item"), (F.col("value") < 10).alias("retracted")))
