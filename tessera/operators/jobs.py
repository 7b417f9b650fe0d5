"""The durable job queue as pure transitions, and packing of work memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C


def backoff_seconds(attempts: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in C.BACKOFF_S]), F.least(attempts, F.lit(4)))


def transition(status: Column, attempts: Column, outcome: Column) -> Column:
    """struct<status, attempts, wait_s> after a claim with an outcome of ok or error."""
    tried = attempts + 1
    live = status.isin("pending", "retryable", "leased") & (attempts < C.MAX_ATTEMPTS)
    after = F.when(~live, F.when(status.isin("pending", "retryable", "leased"), "parked").otherwise(status)).when(outcome == "ok", "done").when(tried >= C.MAX_ATTEMPTS, "failed").otherwise("retryable")
    return F.struct(after.alias("status"), F.when(live, tried).otherwise(attempts).alias("attempts"), F.when(live & (after == "retryable"), backoff_seconds(attempts)).alias("wait_s"))


def claim_order(jobs: DataFrame) -> DataFrame:
    """Jobs ready to be claimed, ranked: the first live one of each session and kind; work of
    a later priority waits while a kind has live work of priority 0."""
    live = jobs.where(F.col("status").isin("pending", "retryable", "leased") & (F.col("attempts") < C.MAX_ATTEMPTS))
    head = Window.partitionBy("owner", "kind", "session_id").orderBy("event_time", "id")
    urgent = Window.partitionBy("owner", "kind")
    first = live.withColumn("_n", F.row_number().over(head)).withColumn("_u", F.max((F.col("priority") == 0).cast("int")).over(urgent))
    ready = first.where("_n = 1 and (priority = 0 or _u = 0)")
    order = Window.partitionBy("owner", "kind").orderBy("priority", F.asc_nulls_last("event_time"), "id")
    return ready.withColumn("rank", F.row_number().over(order)).select("id", "owner", "kind", "session_id", "priority", "rank")


def work_events(messages: DataFrame) -> DataFrame:
    """Occurrences of each (session, call): index from 0, and the assistant turn they answer.

    The assistant turn is the last one before in the session with no user turn between.
    """
    w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role").isin("assistant", "user"), F.struct("role", "id")), ignorenulls=True).over(w)
    call = Window.partitionBy("session_id", "call_id").orderBy("ts", "id")
    seen = messages.withColumn("_l", last).withColumn("occurrence", F.row_number().over(call) - 1)
    return seen.where("role not in ('assistant', 'user')").select("id", "session_id", "call_id", "occurrence", F.when(F.col("_l.role") == "assistant", F.col("_l.id")).alias("assistant_id"))


def work_items(turns: DataFrame, verdict: Column) -> DataFrame:
    """One item of a session: what was asked, what came out, and the last verdict of the user."""
    at = F.struct("ts", "id")
    user, said = F.col("role") == "user", F.col("role") == "assistant"
    g = turns.withColumn("_v", F.when(user, verdict)).groupBy("owner", "session_id").agg(
        F.min(F.when(user, F.struct("ts", "id"))).alias("a"), F.min(at).alias("f"), F.max(F.when(said, at)).alias("o"), F.max(F.when(F.col("_v").isNotNull(), F.struct("ts", "id", "_v"))).alias("v"))
    return g.select("owner", "session_id", F.coalesce("a.id", "f.id").alias("ask_id"), F.col("o.id").alias("outcome_id"), F.coalesce("v._v", F.lit("unknown")).alias("status"))


def current_items(items: DataFrame) -> DataFrame:
    """Of (topic, item, retracted) the current item: the newest not retracted, with its predecessor."""
    w = Window.partitionBy("topic").orderBy(F.desc("item"))
    kept = items.where("not retracted").withColumn("_n", F.row_number().over(w)).withColumn("restores", F.lead("item").over(w))
    return kept.where("_n = 1").select("topic", "item", "restores")
