"""The driver's Parquet tables as the relations of the memory model.

Each relation is a DataFrame here and a DuckDB common table expression in ``SQL``.
Every relation is a projection, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scratch import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are read as those of the session's zone, UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    minutes = F.col("conv_id") * 60 + F.col("turn")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"),
        F.concat(F.lit("o"), F.col("conv_id") % 4).alias("owner"),
        "role",
        F.col("text").alias("content"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"))).alias("ts"),
    )


def turn_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("o"), F.col("vec_id") % 4).alias("owner"),
        F.concat(F.lit("s"), F.col("label")).alias("session_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.element_at(F.array(F.lit("memory"), F.lit("chunk"), F.lit("turn")), (F.col("vec_id") % 3 + 1).cast("int")).alias("src"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("evidence_id"),
        F.concat(F.lit("o"), F.col("user_id") % 4).alias("owner"),
        F.col("user_id").alias("subject_id"),
        F.col("event_type").alias("verb"),
        F.concat(F.lit("l:"), k % 5).alias("object_key"),
        F.when(k % 10 == 0, "negative").otherwise("positive").alias("polarity"),
        F.when(F.col("value") < 10, "retract").otherwise("assert").alias("act"),
        F.when(F.col("event_id") % 4 == 3, "assistant").otherwise("user").alias("speaker"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("span_id"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.array(*[F.lit(s) for s in ("pending", "leased", "retryable", "done", "parked")])
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("o"), F.col("user_id") % 4).alias("owner"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
        F.element_at(status, (F.col("event_id") % 5 + 1).cast("int")).alias("status"),
        (k % 6).alias("attempts"),
        (F.col("event_id") % 2).alias("priority"),
        F.col("ts").alias("event_time"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as edges: a customer ordered a part; the claim is the order line."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    rows = li.count()
    o, li = spread(o, rows, "o_orderkey"), spread(li, rows, "l_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("subject"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("object"),
        F.concat(F.lit("o"), F.col("o_custkey") % 4).alias("owner"),
        F.col("l_discount").alias("distance"),
        F.col("l_returnflag").alias("flag"),
        F.col("o_orderdate").alias("event_time"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns of a turn in order: the parts of an order by line."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("turn"), F.col("l_linenumber").alias("mention_index"), F.col("l_partkey").alias("noun_id"), (1 - F.col("l_discount")).alias("conf"), F.col("l_suppkey").alias("chunk_id"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


SQL = {
    "turns": "SELECT conv_id*1000+turn AS id, 's'||conv_id AS session_id, 'o'||(conv_id%4) AS owner, role, text AS content, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id*60+turn AS BIGINT)) AS ts FROM conversations",
    "turn_vec": "SELECT vec_id AS id, 'o'||(vec_id%4) AS owner, 's'||label AS session_id, CAST(embedding AS DOUBLE[]) AS embedding, (['memory','chunk','turn'])[CAST(vec_id%3+1 AS INT)] AS src FROM embeddings",
    "ev0": "SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events",
    "evidence": "SELECT event_id AS evidence_id, 'o'||(user_id%4) AS owner, user_id AS subject_id, event_type AS verb, 'l:'||(k%5) AS object_key, CASE WHEN k%10=0 THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN value<10 THEN 'retract' ELSE 'assert' END AS act, CASE WHEN event_id%4=3 THEN 'assistant' ELSE 'user' END AS speaker, ts AS event_time, event_id AS span_id FROM ev0",
    "jobs": "SELECT event_id AS id, 'o'||(user_id%4) AS owner, event_type AS kind, 's'||user_id AS session_id, (['pending','leased','retryable','done','parked'])[CAST(event_id%5+1 AS INT)] AS status, k%6 AS attempts, event_id%2 AS priority, ts AS event_time FROM ev0",
    "edges": "SELECT l_orderkey*10+l_linenumber AS claim_id, 'c'||o_custkey AS subject, 'p'||l_partkey AS object, 'o'||(o_custkey%4) AS owner, l_discount AS distance, l_returnflag AS flag, o_orderdate AS event_time FROM lineitem JOIN orders ON l_orderkey=o_orderkey",
    "mentions": "SELECT l_orderkey AS turn, l_linenumber AS mention_index, l_partkey AS noun_id, 1-l_discount AS conf, l_suppkey AS chunk_id FROM lineitem",
}
_NEEDS = {"evidence": ["ev0"], "jobs": ["ev0"]}


def with_relations(sql: str, *names: str) -> str:
    """``sql`` (which may begin with WITH) preceded by the named relations."""
    needed: list[str] = []
    for n in names:
        needed += [x for x in [*_NEEDS.get(n, []), n] if x not in needed]
    if not needed:
        return sql
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = sql.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes}, {body[len(head) :]}"
    return f"WITH {ctes} {body}"
