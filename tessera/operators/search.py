"""Similarity search, rank fusion and diversification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions.scratch import cut_lineage, sent_if_few
from tessera.functions.vectors import block_pairs, blocks_of, cosine, usable


def batch_search(queries: DataFrame, rows: DataFrame, k: int, floor: float = -1.0, blocks: int | None = None, left_blocks: int | None = None, group: str | None = None) -> DataFrame:
    """(id, other, cosine, rank): the k nearest rows of each query by block products; ties by id.

    Blocks follow from the counts of both sides unless they are given.
    """
    n_left = left_blocks or blocks_of(queries, least=1)
    pairs = block_pairs(queries, rows, floor, top=k, blocks=blocks or blocks_of(rows, least=8), left_blocks=n_left, group=group)
    order = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batch_arms(queries: DataFrame, arms: dict[str, tuple[DataFrame, bool]], k: int = C.VECTOR_K) -> DataFrame:
    """(query, id, src, session_id, similarity, rank): the k nearest of each arm, then of all arms, for each query.

    ``queries``: id, owner, v. An arm is (rows id, owner, session_id, v; whether only rows of the
    query's owner count). No query finds itself; ties go by arm, then id.
    """
    out = None
    for src, (rows, own) in arms.items():
        found = batch_search(queries, rows, k, group="owner" if own else None)
        part = found.select(F.col("id").alias("query"), F.col("other").alias("id"), F.round("cosine", 9).alias("similarity"))
        part = part.join(rows.select("id", "session_id"), "id").withColumn("src", F.lit(src))
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "src", "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(rankings: DataFrame, k: int = C.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query, list, item, rank from 1); ties by the item as a string."""
    fused = rankings.groupBy("query", "item").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("item").cast("string"))
    return fused.withColumn("place", F.row_number().over(order))


def mmr(items: DataFrame, limit: int, lam: float = C.MMR_LAMBDA) -> DataFrame:
    """Greedy diversification within each query of (query, item, position from 0, v).

    Relevance is 1 / (1 + position); redundancy is the largest cosine to what is chosen.
    The earliest of equals wins. A query's items are the few that fusion kept.
    """
    kind = items.schema["item"].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position").reset_index(drop=True)
        unit = []
        for v in pdf.v:
            a = np.asarray(v if v is not None else [], float)
            n = np.linalg.norm(a)
            unit.append(a / n if n else a)
        left, chosen = list(range(len(pdf))), []
        while left and len(chosen) < limit:
            gain = [lam / (1 + pdf.position[i]) - (1 - lam) * max((float(unit[i] @ unit[j]) if len(unit[i]) == len(unit[j]) and len(unit[i]) else 0.0 for j in chosen), default=0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(gain))))
        out = pdf.loc[chosen, ["query", "item"]].copy()
        out["place"] = np.arange(1, len(chosen) + 1, dtype="int32")
        return out

    return items.groupBy("query").applyInPandas(pick, f"query {items.schema['query'].dataType.simpleString()}, item {kind}, place int")


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of the words of a text: lower case, two blanks before and one after each."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


#: Rows of grams and of terms that are sent to every task at most; more are joined by shuffle.
BROADCAST_GRAMS, BROADCAST_TERMS = 200_000, 100_000
#: Grams of a text up to which pairs of them are posted; of longer ones single grams are.
MOST_PAIRED = 24


def _gram_index(terms: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, term, size, grams) and (nid, name, size, grams), written: distinct texts with their grams' numbers, rarest in ``names`` first; unknown grams count in ``size`` alone."""
    texts = [cut_lineage(rows.select(c).distinct().where(F.col(c).isNotNull()).withColumn(i, F.monotonically_increasing_id())) for rows, c, i in ((terms, "term", "tid"), (names, "name", "nid"))]
    frequency = texts[1].select(F.explode(trigrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    number = cut_lineage(frequency.orderBy("n", "gram").select("gram", F.monotonically_increasing_id().alias("g")))
    number = sent_if_few(number, BROADCAST_GRAMS)
    out = []
    for rows, c, i in zip(texts, ("term", "name"), ("tid", "nid"), strict=True):
        grams = rows.select(i, c, F.explode(trigrams(F.col(c))).alias("gram")).join(number, "gram", "left")
        out.append(cut_lineage(grams.groupBy(i, c).agg(F.count("*").cast("int").alias("size"), F.array_sort(F.collect_list("g")).alias("grams"))))
    return out[0], out[1]


def _met(terms: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """(tid, nid): distinct pairs that may be at ``floor``, of both sides' rows of ``_gram_index``.

    Texts of s and t grams at the floor share at least need = (s + t) * floor / (1 + floor) of them. So
    of either text's grams, rarest first, at most s - need miss, and the first two that are
    shared are among its first s - need + 2. Pairs of those meet (single grams where a text may share but one, or is long), as
    two grams are in far fewer texts than one; a term looks up each size of names with the
    need of that size.
    """
    low = floor - 5e-7  # similarities are rounded
    ceil = lambda x: F.ceil(x - 1e-9).cast("int")
    least = ceil(F.lit(low) * F.col("other"))
    sizes = names.select(F.col("size").alias("other")).distinct().withColumn("by", F.when((least < 2) | (F.col("other") - least + 2 > MOST_PAIRED), 1).otherwise(2))
    sizes = cut_lineage(sizes)

    def keys(head: Column) -> Column:
        pairs = F.flatten(F.transform(head, lambda x, i: F.transform(F.slice(head, i + 2, F.size(head)), lambda y: F.xxhash64(x, y))))
        return F.explode(F.when(F.col("by") == 2, pairs).otherwise(F.transform(head, lambda x: F.xxhash64(x))))

    need = ceil(F.lit(low / (1 + low)) * (F.col("size") + F.col("other")))
    like = F.least("size", "other") >= F.greatest("size", "other") * low - 1e-9
    # Grams that no name has miss first.
    asked = terms.join(F.broadcast(sizes), like)
    probe = asked.select("tid", "other", keys(F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.size("grams") - need + F.col("by")))).alias("key"))
    posted = names.withColumn("other", F.col("size")).join(F.broadcast(sizes), "other")
    posting = posted.select("nid", "other", keys(F.slice("grams", F.lit(1), F.col("size") - least + F.col("by"))).alias("key"))
    return probe.join(posting, ["other", "key"]).select("tid", "nid").distinct()


def _links_at(terms: DataFrame, names: DataFrame, floor: float) -> DataFrame:
    """(term, name, similarity) at ``floor`` or above: what ``_met``, verified."""
    both = _met(terms, names, floor).join(names.select("nid", "name", F.col("size").alias("tb"), F.col("grams").alias("gb")), "nid").join(sent_if_few(terms.select("tid", "term", F.col("size").alias("ta"), F.col("grams").alias("ga")), BROADCAST_TERMS), "tid")
    common = F.size(F.array_intersect("ga", "gb"))
    similarity = common / (F.col("ta") + F.col("tb") - common).cast("double")
    return both.select("term", "name", F.round(similarity, 6).alias("similarity")).where(F.col("similarity") >= floor)


def trigram_links(terms: DataFrame, names: DataFrame, floor: float = C.TRIGRAM_FLOOR) -> DataFrame:
    """(term, entity_id, name, similarity) by an inverted index of 3-grams, never by comparing all pairs; names are linked once, whatever number of entities has them."""
    found = _links_at(*_gram_index(terms, names), floor)
    return found.join(names.select("entity_id", "name").distinct(), "name").select("term", "entity_id", "name", "similarity")


def trigram_top(terms: DataFrame, names: DataFrame, k: int, floor: float = C.TRIGRAM_FLOOR, once: bool = False) -> DataFrame:
    """(term, entity_id, similarity): of ``trigram_links`` each term's ``k`` most similar, ties by id.

    ``once``: an entity of several names counts once, with the most similar.
    The floor is lowered step by step: terms that have ``k`` links at a step are settled, as
    all others are less alike. Names are linked once, whatever number of entities has them; of
    a term's names the first ``k`` by similarity and least id hold its first ``k`` entities (all
    are taken if entities have several), and of a name's entities the first ``k`` do.
    """
    place = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order))
    few = cut_lineage(names.select("name", "entity_id").distinct().withColumn("_r", place("name", "entity_id")).where(F.col("_r") <= k).drop("_r"))
    least = few.groupBy("name").agg(F.min("entity_id").alias("_first"))
    left, single = _gram_index(terms, few)
    out = None
    for step in sorted({max(s, floor) for s in ((0.7, floor) if once else (1.0, 0.8, 0.7, floor))}, reverse=True):
        met = _links_at(left, single, step)
        if not once:
            met = met.join(least, "name").withColumn("_r", place("term", F.desc("similarity"), "_first")).where(F.col("_r") <= k).select("term", "name", "similarity")
        found = met.join(few, "name")
        if once:
            found = found.groupBy("term", "entity_id").agg(F.max("similarity").alias("similarity"))
        found = found.withColumn("_r", place("term", F.desc("similarity"), "entity_id")).where(F.col("_r") <= k)
        found = cut_lineage(found.select("term", "entity_id", "similarity"))
        if step > floor:
            full = found.groupBy("term").count().where(F.col("count") >= k).select("term")
            left = cut_lineage(left.join(full, "term", "left_anti"))
            found = found.join(full, "term", "left_semi")
        out = found if out is None else out.unionByName(found)
        if step > floor and left.isEmpty():
            break
    return out


def _near_names(vectors: DataFrame, name_vectors: DataFrame) -> DataFrame:
    """(query, entity_id, name_similarity): the three nearest names of each query, at the floor.

    A vector that queries or entities share is searched once, under its least id; of the nearest
    three such vectors the first three entities hold the nearest three.
    """
    shared = Window.partitionBy("v").orderBy("id")
    few = cut_lineage(usable(name_vectors).select("id", "v", F.row_number().over(shared).alias("_r"), F.first("id").over(shared).alias("_first")).where(F.col("_r") <= C.NAME_TOP))
    # Ids of queries and entities may be equal, and a search leaves out equal ids.
    vectors = usable(vectors).select((-1 - F.col("query")).alias("id"), "v")
    asked = cut_lineage(vectors.groupBy("v").agg(F.min("id").alias("asked")))
    found = batch_search(asked.select(F.col("asked").alias("id"), "v"), few.where("_r = 1").select("id", "v"), C.NAME_TOP, C.NAME_FLOOR - 1e-9)
    found = found.withColumn("name_similarity", F.round("cosine", 9)).where(F.col("name_similarity") >= C.NAME_FLOOR)
    found = found.select(F.col("id").alias("asked"), F.col("other").alias("_first"), "name_similarity").join(few.select("_first", F.col("id").alias("entity_id")), "_first")
    order = Window.partitionBy("asked").orderBy(F.desc("name_similarity"), "entity_id")
    found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= C.NAME_TOP)
    who = vectors.join(asked, "v").select((-1 - F.col("id")).alias("query"), "asked")
    return cut_lineage(who.join(found, "asked").select("query", "entity_id", "name_similarity"))


def link_entities(phrases: DataFrame, vectors: DataFrame, entities: DataFrame, surfaces: DataFrame, name_vectors: DataFrame, limit: int = C.LINK_LIMIT) -> DataFrame:
    """(query, entity_id, exact, trigram, name_similarity, rank): entities that a query may mean.

    ``phrases``: query, term; ``vectors``: query, v, one of each query; ``entities``: entity_id, merged_into;
    ``surfaces``: entity_id, name, a row for each name and alias; ``name_vectors``: id, v of
    entities not merged, one of each. Equal names (2) come before similar ones (1, trigrams at the floor)
    and nearest name vectors (0, three of each query at the floor); then rank the vector,
    the trigrams and the id. A merged entity stands for the one it was merged into.

    Without the few nearest by vector, a query's first ``limit`` are among the first so many of
    its terms by name; those nearest are held against the terms apart.
    """
    k = limit + C.NAME_TOP
    live = entities.where("merged_into is null").select("entity_id")
    keeper = entities.select("entity_id", F.coalesce("merged_into", "entity_id").alias("kept"))
    held = surfaces.where("name is not null").join(keeper, "entity_id").select(F.col("kept").alias("entity_id"), "name").join(live, "entity_id", "left_semi")
    held = cut_lineage(held.distinct())
    terms = phrases.select("term").distinct()
    first = F.row_number().over(Window.partitionBy("term").orderBy("entity_id"))
    equal = terms.join(held, F.col("term") == F.col("name")).withColumn("_r", first).where(F.col("_r") <= k).select("term", "entity_id", F.lit(2).alias("exact"), F.lit(1.0).alias("trigram"))
    like = trigram_top(terms, held, k, once=True).select("term", "entity_id", F.lit(1).alias("exact"), F.col("similarity").alias("trigram"))
    named = phrases.join(equal.unionByName(like), "term").select("query", "entity_id", "exact", "trigram", F.lit(0.0).alias("name_similarity"))
    near = _near_names(vectors, name_vectors)
    # The names of those near, as similar as they are.
    pairs = near.select("query", "entity_id").join(held, "entity_id").join(phrases, "query").select("query", "entity_id", "term", "name", trigrams(F.col("term")).alias("ta"), trigrams(F.col("name")).alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    similarity = F.round(common / F.nullif(F.size("ta") + F.size("tb") - common, F.lit(0)).cast("double"), 6)
    same = F.col("term") == F.col("name")
    own = pairs.select("query", "entity_id", F.when(same, 2).otherwise(1).alias("exact"), F.when(same, 1.0).otherwise(similarity).alias("trigram"), F.lit(0.0).alias("name_similarity")).where(F.col("trigram") >= C.TRIGRAM_FLOOR)
    near = near.select("query", "entity_id", F.lit(0).alias("exact"), F.lit(0.0).alias("trigram"), "name_similarity")
    best = named.unionByName(own).unionByName(near).groupBy("query", "entity_id").agg(*[F.max(c).alias(c) for c in ("exact", "trigram", "name_similarity")])
    best = best.join(live, "entity_id", "left_semi")
    order = Window.partitionBy("query").orderBy(F.desc("exact"), F.desc("name_similarity"), F.desc("trigram"), "entity_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def budget_skip(rows: DataFrame, group: str, order: list[str], cost: str, budget: int, start: int = 0) -> DataFrame:
    """(group, order, cost, kept): a greedy knapsack that passes over what doesn't fit and goes on.

    Groups are dealt by key and sorted; a task holds one running total.
    """
    slim = rows.select(group, *order, F.col(cost).cast("long").alias(cost))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used = None, start
        for pdf in parts:
            kept = []
            for g, c in zip(pdf[group].astype(object).where(pdf[group].notna(), None), pdf[cost], strict=True):
                key, used = (key, used) if key == (g,) else ((g,), start)
                fits = used + c <= budget
                used += c if fits else 0
                kept.append(bool(fits))
            yield pdf.assign(kept=kept)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    return slim.repartition(group).sortWithinPartitions(group, *order).mapInPandas(pack, f"{schema}, kept boolean")


def budget_break(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Greedy knapsack that stops at the first that doesn't fit; adds ``kept``. A running sum."""
    run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("kept", F.sum(cost).over(run) <= budget)
