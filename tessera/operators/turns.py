"""Operators over the stream of turns: neighbours, predecessors, dedup, classification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scratch import cut_lineage

SESSION_KINDS = ("interactive", "benchmark", "system_test")


def by_ids(rows: DataFrame, ids: list, owner: str | None = None, id_col: str = "id") -> DataFrame:
    """Rows with one of the ids (what isn't an integer is passed over), of one owner if named."""
    wanted = sorted({int(i) for i in ids if isinstance(i, int) and not isinstance(i, bool)})
    out = rows.where(F.col(id_col).isin(wanted)) if wanted else rows.where("false")
    return out.where(F.col("owner") == owner) if owner is not None else out


def session_kind(session: Column, explicit: Column | None = None) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(session.cast("string"), F.lit("")), '^\\s*"+|"+\\s*$', ""))
    by_prefix = F.when(s.startswith("verify-c5") | s.startswith("c8-"), "system_test").when(s.startswith("bench-") | s.startswith("bench_"), "benchmark").otherwise("interactive")
    return F.when(explicit.isin(*SESSION_KINDS), explicit).otherwise(by_prefix) if explicit is not None else by_prefix


def neighbors(turns: DataFrame) -> DataFrame:
    """Each turn with the turns before and after it in its session; no join, one window."""
    w = Window.partitionBy("owner", "session_id").orderBy("ts", "id")
    return turns.select("id", "session_id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"), F.lag("role").over(w).alias("prev_role"), F.lead("role").over(w).alias("next_role"))


def previous_of_role(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """The latest earlier turn of ``role`` in the session, as of each turn."""
    w = Window.partitionBy("owner", "session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    return turns.select("id", "session_id", "role", F.last(F.when(F.col("role") == role, F.col("id")), ignorenulls=True).over(w).alias("previous_id"))


def dedup_trailing(turns: DataFrame, minutes: int = 10, min_chars: int = 80) -> DataFrame:
    """(id, kept_id) of turns: the kept turn whose window they fall in, or their own id.

    A kept turn of ``min_chars`` or more opens a window of ``minutes`` for turns of the same
    owner, session, role and content; only kept turns open windows. Each turn points to the
    first one beyond its own window, and what is kept are the turns that pointers lead to from
    the first turn after each pause; pointers double each round. Windows of rows go by (key,
    stretch of ``minutes``), so a key of any size is many tasks. Turns without a time are kept;
    a turn that is there twice is kept once; null keys and texts are values like any other.
    """
    width = minutes * 60_000_000
    at = F.unix_micros("ts")
    key = F.xxhash64("owner", "session_id", "role", *(F.col(c).isNull() for c in ("owner", "session_id", "role", "content")), "content")
    # Keys are two numbers: 64 bits of the one hash and 60 of another, as they travel with every row.
    digest = F.conv(F.substring(F.md5(F.concat_ws("\x01", "owner", "session_id", "role", "content")), 1, 15), 16, 10).cast("long")
    windowed = (F.length("content") >= min_chars) & F.col("ts").isNotNull()
    long_ = turns.where(windowed).select(F.struct(key.alias("h"), digest.alias("m")).alias("key"), at.alias("at"), "id").distinct()
    long_ = cut_lineage(long_.withColumn("part", F.floor(F.col("at") / width)))
    short = turns.where(~F.coalesce(windowed, F.lit(False))).select("id", F.col("id").alias("kept_id"))

    # The stretches of a key that hold turns, with the turns around them.
    ends = long_.groupBy("key", "part").agg(F.min(F.struct("at", "id")).alias("first"), F.max("at").alias("last"))
    over_parts = Window.partitionBy("key").orderBy("part")
    ends = ends.select("key", "part", F.lag("last").over(over_parts).alias("before"), F.lead(F.struct("part", "first")).over(over_parts).alias("after"))

    # A turn asks, in the stretch after its own, for the first turn at the end of its window or later.
    own = long_.select("key", "part", "at", F.lit(1).alias("kind"), "id")
    asked = long_.select("key", (F.col("part") + 1).alias("part"), (F.col("at") + width).alias("at"), F.lit(0).alias("kind"), "id")
    backwards = Window.partitionBy("key", "part").orderBy(F.desc("at"), F.desc("kind"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.last(F.when(F.col("kind") == 1, F.struct("at", "id")), ignorenulls=True).over(backwards)
    answers = own.unionByName(asked).select("key", (F.col("part") - 1).alias("part"), "kind", "id", (F.col("at") - width).alias("at"), nearest.alias("hit")).where("kind = 0")
    # Else it is the first turn of the next stretch that isn't its own neighbour.
    skip = ends.select("key", "part", F.when(F.col("after.part") > F.col("part") + 1, F.col("after.first")).alias("near"), F.col("after.part").alias("next"))
    far = ends.select("key", F.col("part").alias("next"), F.col("after.first").alias("following"))
    beyond = skip.join(far, ["key", "next"], "left").select("key", "part", F.coalesce("near", "following").alias("otherwise"))
    pointers = answers.join(beyond, ["key", "part"], "left").select("key", "id", "at", F.coalesce("hit", "otherwise").alias("to"))

    # The first turn after a pause is kept whatever was before.
    inside = F.lag("at").over(Window.partitionBy("key", "part").orderBy("at", "id"))
    roots = long_.select("key", "part", "at", "id", inside.alias("earlier")).join(ends.select("key", "part", "before"), ["key", "part"])
    earlier = F.coalesce("earlier", "before")
    kept = cut_lineage(roots.where(earlier.isNull() | (F.col("at") - earlier >= width)).select("key", F.struct("at", "id").alias("of")))
    jumps = cut_lineage(pointers.where("to is not null").select("key", F.struct("at", "id").alias("of"), "to").join(kept.select("key", F.col("of").alias("to")), ["key", "to"], "left_anti"))
    while True:
        reached = kept.join(jumps, ["key", "of"]).select("key", F.col("to").alias("of")).distinct()
        new = cut_lineage(reached.join(kept, ["key", "of"], "left_anti"))
        if not new.take(1):
            break
        kept = kept.unionByName(new)
        onward = jumps.select("key", F.col("of").alias("to"), F.col("to").alias("_next"))
        jumps = cut_lineage(jumps.join(onward, ["key", "to"]).select("key", "of", F.col("_next").alias("to")))

    # A turn's kept one is in its own stretch or the one before.
    marked = kept.select("key", "of.at", "of.id", F.floor(F.col("of.at") / width).alias("part"), F.lit(True).alias("is_kept"))
    rows = long_.select("key", "part", "at", "id").join(marked.drop("part"), ["key", "at", "id"], "left").select("key", "part", "at", "id", F.lit(1).alias("kind"), F.coalesce("is_kept", F.lit(False)).alias("is_kept"))
    rows = rows.unionByName(marked.select("key", (F.col("part") + 1).alias("part"), "at", "id", F.lit(0).alias("kind"), "is_kept"))
    forward = Window.partitionBy("key", "part").orderBy("at", "id", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("id", "kind", F.last(F.when(F.col("is_kept"), F.col("id")), ignorenulls=True).over(forward).alias("kept_id"))
    return found.where("kind = 1").select("id", "kept_id").unionByName(short)


def flower_edges(turns: DataFrame) -> DataFrame:
    """Graph edges of turns: IN_SESSION to the session, NEXT to the following turn."""
    w = Window.partitionBy("owner", "session_id").orderBy("ts", "id")
    inside = turns.select(F.lit("IN_SESSION").alias("label"), F.col("id").cast("string").alias("src"), F.col("session_id").alias("dst"))
    after = turns.select(F.lit("NEXT").alias("label"), F.col("id").cast("string").alias("src"), F.lead("id").over(w).cast("string").alias("dst")).where("dst is not null")
    return inside.unionByName(after)


def rolling_context(turns: DataFrame, size: int = 6) -> DataFrame:
    """The ids of up to ``size`` turns before each turn of a session, oldest first."""
    w = Window.partitionBy("owner", "session_id").orderBy("ts", "id").rowsBetween(-size, -1)
    return turns.select("id", F.array_join(F.transform(F.collect_list("id").over(w), lambda x: x.cast("string")), ",").alias("context"))


def select_notes(notes: DataFrame, per_session: int = 2, limit: int = 8) -> DataFrame:
    """Newest notes: one of each key, at most ``per_session`` of a session, ``limit`` in all of an owner."""
    one = Window.partitionBy("owner", "note_key").orderBy(F.desc("ts"), "id")
    few = Window.partitionBy("owner", "session_id").orderBy(F.desc("ts"), "id")
    best = Window.partitionBy("owner").orderBy(F.desc("ts"), "id")
    unique = notes.withColumn("_a", F.row_number().over(one)).where("_a = 1")
    capped = unique.withColumn("_b", F.row_number().over(few)).where(F.col("_b") <= per_session)
    return capped.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("_a", "_b")


def model_batches(turns: DataFrame, size: int = 8, idle_s: int = 600, max_s: int = 1800) -> DataFrame:
    """(id, batch_start, position): a session's turns in batches.

    A batch closes at ``size`` turns, when none comes for ``idle_s``, or ``max_s`` after its start.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by (owner, session, ts, id); the state is of the session last seen.
        key, start, last, n = None, None, None, 0
        for pdf in parts:
            out = []
            for owner, session, ts, i in zip(pdf["owner"], pdf["session_id"], pdf["at"], pdf["id"], strict=True):
                if (owner, session) != key or n >= size or ts - last > idle_s * 1_000_000 or ts - start > max_s * 1_000_000:
                    key, start, n = (owner, session), ts, 0
                last, n = ts, n + 1
                out.append((i, start, n))
            yield pd.DataFrame(out, columns=["id", "start", "position"])

    dealt = turns.select("owner", "session_id", F.unix_micros("ts").alias("at"), "id").repartition("owner", "session_id").sortWithinPartitions("owner", "session_id", "at", "id")
    return dealt.mapInPandas(cut, "id long, start long, position int").select("id", F.timestamp_micros("start").alias("batch_start"), "position")
