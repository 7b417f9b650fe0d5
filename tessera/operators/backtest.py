"""Back-test of predicted links: how many came true, beside control pairs of like degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes of a degree class among which a control partner is drawn.
POOL = 64


def _digest(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def link_backtest(predicted: DataFrame, nodes: DataFrame, known: DataFrame, later: DataFrame) -> DataFrame:
    """One row: candidates, confirmed, precision, controls, chance, base_rate, lift.

    ``predicted``, ``known`` and ``later``: undirected pairs a < b: proposed, linked before the cutoff,
    linked after it. Candidates are proposals not known yet. Each has a control: its a with
    another node of b's degree class (powers of two of known links), the next of b by digest in
    its pool, so that no pairs but the controls are made; a control that is known, or no pair, falls.
    Pools are cut from a class by its size, so a class with most nodes is many groups.
    """
    pair = ["a", "b"]
    candidates = predicted.select(*pair).distinct().join(known, pair, "left_anti")
    ends = known.select("a", "b").union(known.select("b", "a")).toDF("id", "_").groupBy("id").agg(F.count("*").alias("degree"))
    classed = nodes.select("id").distinct().join(ends, "id", "left").select("id", F.floor(F.log2(F.coalesce("degree", F.lit(0)) + 1)).alias("class"))
    pools = classed.groupBy("class").agg(F.ceil(F.count("*") / POOL).cast("long").alias("pools"))
    placed = classed.join(pools, "class").select("id", "class", F.pmod(_digest(F.col("id")), F.col("pools")).alias("pool"))
    ring = Window.partitionBy("class", "pool").orderBy(F.md5(F.col("id").cast("string")), "id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    partner = placed.select(F.col("id").alias("b"), F.coalesce(F.lead("id").over(ring), F.first("id").over(whole)).alias("c"))
    drawn = candidates.join(partner, "b").where("a <> c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b"))
    controls = drawn.join(known, pair, "left_anti")
    hit = later.select(*pair).distinct().withColumn("_hit", F.lit(1))

    def counted(rows: DataFrame, n: str, hits: str) -> DataFrame:
        return rows.join(hit, pair, "left").agg(F.count("*").alias(n), F.count("_hit").alias(hits))

    both = counted(candidates, "candidates", "confirmed").join(counted(controls, "controls", "chance"))
    precision, base = F.col("confirmed") / F.nullif("candidates", F.lit(0)), F.col("chance") / F.nullif("controls", F.lit(0))
    return both.select("candidates", "confirmed", precision.alias("precision"), "controls", "chance", base.alias("base_rate"), (precision / F.nullif(base, F.lit(0.0))).alias("lift"))
