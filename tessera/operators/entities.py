"""Entity resolution: merge chains, components, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scratch import cut_lineage, spread


#: Nodes of the links (16 bytes each) that are broadcast at most.
HUBS = 100_000


def merge_chain(entities: DataFrame, max_depth: int = 16) -> DataFrame:
    """(id, root, depth) by following ``merged_into`` up to ``max_depth`` times.

    Pointer doubling: each join doubles the length of the known chains, so sixteen steps take
    four joins. A missing link target ends a chain; a cycle ends at the depth limit.
    """
    ids = entities.select("id", F.coalesce("merged_into", "id").alias("root"), F.col("merged_into").isNotNull().cast("int").alias("depth"))
    steps = 1
    while steps < max_depth:
        far = ids.select(F.col("id").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        ids = ids.join(far, "root", "left").select("id", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        steps *= 2
    return ids


def _to_least(star: DataFrame, rows: DataFrame, edges: int) -> DataFrame:
    """``star`` (u, v) with ``m``, the least of u and its v in ``rows``.

    Nodes with many rows are joined by broadcast, so no task gets a hub's rows; at most
    ``HUBS`` nodes can have so many. The others are joined by shuffle.
    """
    low = cut_lineage(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    hub = F.col("n") > max(256, 2 * edges // HUBS)
    hubs = F.broadcast(low.where(hub).select("u", "m"))
    return star.join(hubs.select("u"), "u", "left_anti").join(low.where(~hub).select("u", "m"), "u").union(star.join(hubs, "u"))


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, keeper): each linked id and the smallest id of its component, by star contraction."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        many = edges.count()
        large = _to_least(both.where("v > u"), both, many).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        small = _to_least(large, large, many).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut_lineage(small.where("u <> v").distinct())
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("keeper")).union(edges.select(F.col("v"), F.col("v"))).distinct()


def resolve_aliases(links: DataFrame, max_depth: int = 8) -> DataFrame:
    """(surface, root): follow surface -> canon up to ``max_depth``; a cycle elects one member.

    Of a cycle the oldest birth of the surfaces of four or more characters is chosen (of all,
    if none is so long), the first by name of equals. ``links``: surface, canon, born.
    """
    edges = cut_lineage(links.select("surface", "canon", "born"))
    n = edges.count()
    # Follow by joins: every path of up to max_depth steps, with what it has seen.
    path = edges.select("surface", F.col("canon").alias("at"), F.array("surface").alias("seen"), F.lit(False).alias("loop"))
    step = spread(edges.select(F.col("surface").alias("at"), F.col("canon").alias("next")), n, "at")
    for _ in range(max_depth - 1):
        moved = spread(path, n, "at").join(step, "at", "left")
        stop = F.col("loop") | F.col("next").isNull() | F.array_contains("seen", F.col("at"))
        path = moved.select("surface", F.when(stop, F.col("at")).otherwise(F.col("next")).alias("at"), F.when(stop, F.col("seen")).otherwise(F.array_append("seen", F.col("at"))).alias("seen"), (F.col("loop") | F.array_contains("seen", F.col("at"))).alias("loop"))
    path = path.withColumn("loop", F.col("loop") | F.array_contains("seen", F.col("at")))
    # A path has seen max_depth surfaces at most.
    member = spread(path.where("loop").select("surface", F.explode("seen").alias("member")), n * max_depth, "member")
    cycle = member.join(spread(edges.select(F.col("surface").alias("member"), "born"), n * max_depth, "member"), "member")
    choice = spread(cycle, n * max_depth, "surface").groupBy("surface").agg(F.min(F.struct((F.length("member") < 4).alias("short"), "born", "member")).alias("m"))
    return spread(path, n * max_depth, "surface").join(choice, "surface", "left").select("surface", F.coalesce("m.member", "at").alias("root"))


