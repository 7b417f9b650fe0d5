"""Operator 7, mixing sources by temperature.

Source shares of the tokens (operator 1 counts them) are raised to an exponent and normalised. The exponent is
found by repeated section: each round weighs a row of exponents over the table of
sources in one job and keeps the interval where the target is met. The weights become
budgets, and each budget is realised as passes over the source's documents in the order
of a keyed permutation: whole passes, then a part of one, cut at the block of the
permutation in which the budget ends. Blocks are ranges of the permutation's 64-bit
keys, so no source, however large, is sorted or gathered in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.token_counts import VOCABULARY, document_tokens

#: A power of two: sections per round of the search, and blocks per level of the cut.
SECTIONS, ROUNDS = 32, 6
BLOCK_BITS, LEVELS = 12, 5
#: Sources that may be broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    """What the exponent is to meet.

    ``entropy``: of the weights, as a share of the largest possible one (the logarithm of
    the number of sources). ``max_repeats``: no source is passed over more often. The
    largest exponent up to 1 that reaches the entropy is taken, and raised as far as the
    limit needs; exponent 1 leaves the natural shares. ``budget``: tokens of the mixture;
    None takes the smallest budget in which every document occurs.
    """

    entropy: float = 0.95
    max_repeats: float = 4.0
    budget: int | None = None
    seed: int = 17


def source_tokens(slim: DataFrame) -> DataFrame:
    """(source, tokens) of sources with tokens, from rows (source, n)."""
    return slim.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0")


def find_exponent(sources: DataFrame, target: Target) -> tuple[float, float]:
    """(exponent, sum of the powers) over (source, tokens).

    Each round is one aggregation of the table of sources, whatever their number; only
    SECTIONS + 1 rows reach the driver.
    """
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not total["n"]:
        return 1.0, 1.0

    def curve(exponents: list[float]) -> list[tuple[float, float, float]]:
        """(exponent, share of the largest entropy, sum of powers) for each."""
        grid = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("x")
        p = F.pow(F.col("tokens") / F.lit(float(total["t"])), F.col("x"))
        sums = sources.select("tokens", grid).select("x", p.alias("p")).groupBy("x").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("l")).collect()
        at_most = math.log(total["n"])
        return sorted((r.x, (math.log(r.z) - r.l / r.z) / at_most if at_most else 1.0, r.z) for r in sums)

    # Passes of a source grow as its tokens to the power (exponent - 1); with every document
    # taken at least once, the smallest source is repeated most.
    spread = math.log(total["most"] / total["least"])
    limit = 0.0
    if target.budget is None and spread > 0:
        limit = max(0.0, 1 - math.log(target.max_repeats) / spread)
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        xs = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        got = curve(xs)
        fits = [x for x, entropy, _ in got if entropy >= target.entropy - 1e-12]
        low = max(fits, default=low)
        high = min([x for x in xs if x > low], default=low)
        if high == low:
            break
    x = max(low, limit)
    if target.budget is not None and spread > 0:
        # With a fixed budget the repeats of the smallest source fall as the exponent grows: bisect.
        def repeats(x: float) -> float:
            return target.budget * (total["least"] / total["t"]) ** x / curve([x])[0][2] / total["least"]

        a, b = x, 1.0
        if repeats(a) > target.max_repeats:
            for _ in range(30):
                mid = (a + b) / 2
                a, b = (mid, b) if repeats(mid) > target.max_repeats else (a, mid)
            x = b
    return x, curve([x])[0][2]


def plan_sources(slim: DataFrame, target: Target) -> DataFrame:
    """(source, tokens, share, weight, budget, passes, cut): how often and how far each source is read.

    ``slim`` holds (source, h, n): h is a row's key in the permutation. A row occurs
    ``passes`` times, and once more if its key is ``cut`` or less (compared as unsigned,
    shifted to signed order); rows of one key stand or fall together, and the last key
    that still fits is taken, so a budget is undershot by less than one key's rows.
    """
    sources = materialize(source_tokens(slim), "sources")
    exponent, norm = find_exponent(sources, target)
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    weight = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent)) / F.lit(norm)
    weighed = sources.select("source", "tokens", (F.col("tokens") / F.lit(float(total or 1))).alias("share"), weight.alias("weight"))
    budget = target.budget if target.budget is not None else weighed.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0
    planned = weighed.withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    planned = planned.withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
    # The cut, found level by level: blocks before the budget's end are whole, the one in which it ends is parted.
    level = planned.select("source", F.lit(0).cast("long").alias("prefix"), (F.col("budget") - F.col("passes") * F.col("tokens")).alias("left"))
    level = materialize(level, "cut")
    for k in range(LEVELS):
        shift = 64 - BLOCK_BITS * (k + 1)
        block = F.shiftrightunsigned("h", max(0, shift))
        inside = slim.join(level, slim.source.eqNullSafe(level.source)).select(level.source, "prefix", "left", "n", block.alias("b"))
        if k:
            inside = inside.where(F.shiftrightunsigned("b", BLOCK_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "prefix", "left", "b").agg(F.sum("n").alias("n"))
        # At most 2 ** BLOCK_BITS blocks of a source meet here, whatever its size.
        blocks = F.array_sort(F.collect_list(F.struct("b", "n")))
        folded = F.aggregate(blocks, F.struct(F.lit(-1).cast("long").alias("b"), F.col("left").alias("left"), F.lit(False).alias("end")), _step)
        after = sums.groupBy("source", "prefix", "left").agg(folded.alias("f"))
        found = after.select("source", F.when(F.col("f.end"), F.col("f.b")).alias("prefix"), F.col("f.left").alias("left"))
        missing = level.join(found.select(F.col("source").alias("s"), F.col("prefix").alias("p"), F.col("left").alias("l")), level.source.eqNullSafe(F.col("s")), "left")
        level = materialize(missing.select("source", F.coalesce("p", F.shiftleft(F.col("prefix"), BLOCK_BITS) if k else F.lit(0).cast("long")).alias("prefix"), F.coalesce("l", "left").alias("left")), "cut")
    # Keys under the last block's prefix lie within the budget.
    first = level.select(F.col("source").alias("_s"), F.shiftleft(F.col("prefix"), 64 - BLOCK_BITS * LEVELS).alias("cut"))
    return planned.join(first, planned.source.eqNullSafe(F.col("_s"))).drop("_s")


def _step(acc: Column, block: Column) -> Column:
    """Take whole blocks while they fit; stop at the block in which the budget ends."""
    fits = (~acc["end"]) & (block["n"] <= acc["left"])
    return F.struct(
        F.when(acc["end"] | fits, acc["b"]).otherwise(block["b"]).alias("b"),
        F.when(fits, acc["left"] - block["n"]).otherwise(acc["left"]).alias("left"),
        (acc["end"] | ~fits).alias("end"),
    )


def _plan(docs: DataFrame, id_col: str, source_col: str, text_col: str, target: Target, vocabulary: str) -> tuple[DataFrame, DataFrame, Column]:
    """The rows (id, source, h, n) and the plan, both written, and the copies of a joined row."""
    slim = document_tokens(docs, {"id": docs[id_col], "source": docs[source_col], "h": F.xxhash64(F.lit(target.seed), docs[id_col])}, text_col, vocabulary)
    slim = materialize(slim.withColumnRenamed("n_tokens", "n"), "slim")
    planned = materialize(plan_sources(slim, target).select(F.col("source").alias("_source"), "weight", "passes", "cut"), "plan")
    planned = F.broadcast(planned) if planned.count() <= BROADCAST_SOURCES else planned
    below = F.shiftrightunsigned("_h", 64 - BLOCK_BITS * LEVELS) < F.shiftrightunsigned("cut", 64 - BLOCK_BITS * LEVELS)
    return slim, planned, F.coalesce(F.col("passes") + below.cast("long"), F.lit(1).cast("long"))


def _occurrences(rows: DataFrame) -> DataFrame:
    """Rows with ``_h`` and ``_copies``, each so often, with ``_pass``, ``_block`` and ``_order``."""
    passes = rows.where("_copies > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_pass"))
    order = F.when(F.col("_pass") == 0, F.col("_h")).otherwise(F.xxhash64("_pass", "_h"))
    return passes.withColumn("_order", order).withColumn("_block", F.shiftrightunsigned("_order", 64 - BLOCK_BITS))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: Target | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mixture itself: each document as often as its source's budget holds it.

    The columns are those of ``docs`` and mix_weight (of the source), mix_pass, mix_block and
    mix_key; read in the order of (mix_pass, mix_block, mix_key, id) the mixture interleaves
    the sources. Columns of ``docs`` with these four names give way; other names can't clash.
    Sources without tokens, and so texts without tokens in them, get weight 0 and occur once.
    Null and empty texts have no tokens. A null source is a source; a null id has a key like
    any. Rows that repeat an id, whatever their texts, stand or fall together.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (id_col, source_col, text_col)}
    target, plain = target or Target(), docs.toDF(*names)
    _, planned, copies = _plan(plain, at[id_col], at[source_col], at[text_col], target, vocabulary)
    joined = plain.join(planned, plain[at[source_col]].eqNullSafe(F.col("_source")), "left").withColumn("_h", F.xxhash64(F.lit(target.seed), at[id_col]))
    out = _occurrences(joined.withColumn("_copies", copies))
    added = {"mix_weight": F.coalesce("weight", F.lit(0.0)), "mix_pass": F.col("_pass"), "mix_block": F.col("_block"), "mix_key": F.col("_order")}
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in added]
    return out.select(*kept, *[v.alias(k) for k, v in added.items()])


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: Target | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, pass, block, order_key, n_tokens): the mixture without its texts.

    A row for each occurrence; read in the order of (pass, block, order_key, id) it
    interleaves the sources: blocks are ranges of the pass's permutation keys, the same for
    all sources. Null and odd rows as in ``mixture``; other columns aren't read.
    """
    slim, planned, copies = _plan(docs, id_col, source_col, text_col, target or Target(), vocabulary)
    joined = slim.withColumnRenamed("h", "_h").join(planned, slim["source"].eqNullSafe(F.col("_source")), "left")
    out = _occurrences(joined.withColumn("_copies", copies))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("_pass").alias("pass"), F.col("_block").alias("block"), F.col("_order").alias("order_key"), F.col("n").alias("n_tokens"))
