"""Exact order statistics of large groups without sorting a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scratch import cut_lineage

#: Ranges that a bracket is cut into in a round.
CELLS = 64
#: A bracket of so few values is sorted.
FEW = 250_000


def order_statistics(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """(group, n, share, found): the value at index round(share * (n - 1)) of each group, halves to even; exact.

    Each round cuts the bracket that holds a rank into ranges at approximate quantiles, counts
    the values in each (and at each cut), and goes on with the one that holds the rank; a
    bracket of one value is the answer, one of few values is sorted. Tasks count and sketch
    whatever rows they have; no task gets a group. Null values count for nothing, a group of
    nulls has no row; NaN is larger than any other value; null groups are groups.
    """
    slim = rows.select(*group, F.col(value).cast("double").alias("_v")).where("_v is not null")
    n = slim.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    asked = n.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    # The rank that is sought within the bracket [_lo, _hi] of _size values, and how many lie below.
    asked = cut_lineage(asked.select(*group, "n", "share", F.bround(F.col("share") * (F.col("n") - 1), 0).cast("long").alias("_rank"), "_lo", "_hi", F.col("n").alias("_size")))
    done = asked.where("_lo = _hi").select(*group, "n", "share", F.col("_lo").alias("found"))
    asked = asked.where("_lo < _hi")
    while asked.where(F.col("_size") > FEW).take(1):
        wide = asked.where(F.col("_size") > FEW)
        within = _inside(slim, wide, group)
        cuts = within.groupBy(*group, "share").agg(F.array_distinct(F.percentile_approx("_v", [k / CELLS for k in range(1, CELLS)], 100 * CELLS)).alias("_cuts"))
        dealt = _same(within, cuts, [*group, "share"])
        below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        cell = 2 * below + F.array_contains("_cuts", F.col("_v")).cast("int")
        counts = dealt.groupBy(*group, "share", cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        running = F.sum("_c").over(Window.partitionBy(*group, "share").orderBy("_cell"))
        counts = counts.select("*", (running - F.col("_c")).alias("_before"))
        chosen = _same(wide.drop("_lo", "_hi", "_size"), counts, [*group, "share"]).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        narrowed = chosen.select(*group, "n", "share", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_c").alias("_size"))
        narrowed = cut_lineage(narrowed.unionByName(asked.where(F.col("_size") <= FEW)))
        done = done.unionByName(narrowed.where("_lo = _hi").select(*group, "n", "share", F.col("_lo").alias("found")))
        asked = narrowed.where("_lo < _hi")
    sorted_few = _inside(slim, asked, group).groupBy(*group, "share").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    last = _same(asked, sorted_few, [*group, "share"]).select(*group, "n", "share", F.get("_vs", F.col("_rank").cast("int")).alias("found"))
    return done.unionByName(last)


def _inside(slim: DataFrame, asked: DataFrame, group: list[str]) -> DataFrame:
    """(group, share, _v) of the values in the brackets."""
    bracket = asked.select(*group, "share", "_lo", "_hi")
    return _same(slim, bracket, group).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).select(*group, "share", "_v")


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join on columns where null is a value."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    met = left.join(renamed, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on])
    return met.drop(*[f"_r_{c}" for c in on])
