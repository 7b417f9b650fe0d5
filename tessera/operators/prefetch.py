"""The read path as one plan: search, floor, secrets, token budget, neighbours, overlays, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import text as X
from tessera.operators import search

#: Characters of a hit that the budget counts and the line shows, tokens beside them, and tokens of the frame.
EXCERPT, PER_HIT, FRAME = 400, 8, 40
#: Retracted objects that a hit names, of those looked at.
RETRACTED, LOOKED_AT = 2, 12


def neighbours(turns: DataFrame) -> DataFrame:
    """(id, prev_id, next_id, uptake) of each turn: neighbours that have a text and no secret, and how the next user turn took it."""
    order = Window.partitionBy("owner", "session_id").orderBy("ts", "id")

    def shown(row: Column) -> Column:
        clean = (F.trim(F.coalesce(row["content"], F.lit(""))) != "") & ~row["content"].rlike(X.SECRET)
        return F.when(clean, row["id"])

    about = F.struct("id", "content", "role")
    t = turns.select("id", "role", F.lag(about).over(order).alias("p"), F.lead(about).over(order).alias("n"))
    taken = F.when((F.col("role") == "assistant") & (F.col("n.role") == "user"), X.repair(F.col("n.content"))).otherwise("unknown")
    return t.select("id", "role", shown(F.col("p")).alias("prev_id"), shown(F.col("n")).alias("next_id"), taken.alias("uptake"))


def overlays(evidence: DataFrame) -> DataFrame:
    """(id, live_claims, retracted) by span: how many objects are asserted, and the first of the retracted ones."""
    gone = F.sort_array(F.collect_set(F.when(F.col("act") == "retract", F.col("object_key"))))
    live = F.count_distinct(F.when(F.col("act") == "assert", F.col("object_key")))
    return evidence.groupBy(F.col("span_id").alias("id")).agg(live.alias("live_claims"), F.slice(F.slice(gone, 1, LOOKED_AT), 1, RETRACTED).alias("retracted"))


def line(src: Column, id: Column, role: Column, similarity: Column, excerpt: Column) -> Column:
    """A hit as an element; its text is escaped."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        excerpt = F.replace(excerpt, F.lit(sign), F.lit(name))
    return F.concat(F.lit('<span id="'), src, F.lit(":"), id.cast("string"), F.lit('" role="'), role, F.lit('" score="'), F.format_number(similarity, 3), F.lit('">'), excerpt, F.lit("</span>"))


def prefetch(queries: DataFrame, turns: DataFrame, chunks: DataFrame, evidence: DataFrame, floor: float = C.MIN_SIMILARITY, k: int = C.VECTOR_K, tokens: int = C.MAX_TOKENS) -> DataFrame:
    """(query, rank, src, id, similarity, tokens, role, prev_id, next_id, uptake, live_claims, retracted, line) of the hits that are shown.

    ``queries``: id, owner, v. ``turns``: id, owner, session_id, ts, role, content, v. ``chunks``: id,
    owner, session_id, content, v, open to every owner. Hits below ``floor`` and those with a secret
    fall; from the best on, what no longer fits ``tokens`` is passed over. What follows the
    search is joined to the few hits of a query, whose rows are the small side of every join.
    Null texts are empty; queries without hits have no rows.
    """
    asked = queries.select((-1 - F.col("id")).alias("id"), "owner", "v")
    arms = {"chunk": (chunks.select("id", "owner", "session_id", "v"), False), "turn": (turns.select("id", "owner", "session_id", "v"), True)}
    hits = search.batch_arms(asked, arms, k).where(F.col("similarity") >= floor).select((-1 - F.col("query")).alias("query"), "src", "id", "similarity")
    texts = turns.select(F.lit("turn").alias("src"), "id", F.coalesce("content", F.lit("")).alias("content")).union(chunks.select(F.lit("chunk"), "id", F.coalesce("content", F.lit(""))))
    shown = hits.join(texts, ["src", "id"]).where(~F.col("content").rlike(X.SECRET)).withColumn("excerpt", F.substring(F.trim("content"), 1, EXCERPT))
    priced = shown.withColumn("tokens", X.token_estimate(F.col("excerpt")) + PER_HIT).withColumn("_less", -F.col("similarity"))
    packed = search.budget_skip(priced, "query", ["_less", "src", "id"], "tokens", tokens, start=FRAME).where("kept").drop("tokens", "kept", "_less")
    kept = priced.join(packed, ["query", "src", "id"])
    is_turn = F.col("src") == "turn"
    around = neighbours(turns).withColumn("src", F.lit("turn"))
    over = overlays(evidence).withColumn("src", F.lit("turn"))
    full = kept.join(around, ["src", "id"], "left").join(over, ["src", "id"], "left")
    role = F.when(is_turn, F.coalesce("role", F.lit(""))).otherwise("doc")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "src", "id")
    return full.select(
        "query", F.row_number().over(order).alias("rank"), "src", "id", "similarity", "tokens", role.alias("role"), "prev_id", "next_id",
        F.when(is_turn, F.col("uptake")).alias("uptake"), F.coalesce("live_claims", F.lit(0)).alias("live_claims"), F.coalesce(F.array_join("retracted", ","), F.lit("")).alias("retracted"),
        line(F.col("src"), F.col("id"), role, F.col("similarity"), F.col("excerpt")).alias("line"),
    )
