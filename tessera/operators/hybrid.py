"""Hybrid retrieval: vector seeds, linked entities, a bounded walk, fusion, diversification.

One lazy plan over a batch of queries: the arms are independent branches, and every arm
keeps a bounded number of rows of a query before they meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions.scratch import cut_lineage, sent_if_few
from tessera.operators import graph as G
from tessera.operators import search


#: Rows (entities, claims of queries) that are sent to every task at most; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def nearest_claims(queries: DataFrame, claim_keys: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, claim, rank): the ``k`` nearest claims (claim, k) of each query by their vectors (k, v); ties by claim.

    Claims of one key share a vector, so a key is searched once, under its least claim: of the keys
    in that order the first ``k`` hold the nearest ``k`` claims, and of a key its first ``k`` suffice.
    """
    least = claim_keys.groupBy("k").agg(F.min("claim").alias("id"))
    found = cut_lineage(search.batch_search(queries, least.join(vectors, "k").select("id", "v"), k).select(F.col("id").alias("query"), F.col("other").alias("first"), "cosine"))
    met = cut_lineage(found.select(F.col("first").alias("claim")).distinct().join(claim_keys, "claim").select(F.col("claim").alias("first"), "k"))
    few = claim_keys.join(sent_if_few(met, BROADCAST_ROWS), "k").withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("claim"))).where(F.col("_n") <= k)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "claim")
    return found.join(few, "first").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "claim", "rank")


def retrieve(queries: DataFrame, claim_keys: DataFrame, vectors: DataFrame, claims: DataFrame, linked: DataFrame, limit: int = C.CLAIM_LIMIT) -> DataFrame:
    """(query, claim, place): the claims to show for each query, best first.

    ``queries``: id, v. ``claim_keys``: claim, k of current claims; ``vectors``: k, v; many claims may share a
    vector. ``claims``: claim_id, subject, object, distance, read several times, so best a written table.
    ``linked``: query, entity. No id of a query is that of a claim. Rankings are the nearest claims, the claims
    of linked entities by id, and the walk's order; claims without a vector can't be diversified and drop out.
    Claims are scanned for what queries and walks meet, which is sent to the tasks if it is small.
    """
    near = cut_lineage(nearest_claims(queries, claim_keys, vectors, C.CLAIM_LIMIT))
    wanted = sent_if_few(near.select(F.col("claim").alias("claim_id")).distinct(), BROADCAST_ROWS)
    ends = claims.join(wanted, "claim_id").select(F.col("claim_id").alias("claim"), F.explode(F.array("subject", "object")).alias("entity"))
    start = cut_lineage(linked.select("query", "entity").union(near.join(ends, "claim").select("query", "entity")).distinct())
    walk = G.claim_walk(start.select(F.col("entity").alias("start")).distinct(), lambda nodes: G.claim_edges(claims, nodes=sent_if_few(nodes, BROADCAST_ROWS)))
    order = Window.partitionBy("query").orderBy("hop", "claim")
    walked = start.join(walk, F.col("entity") == F.col("start")).groupBy("query", F.col("claim_id").alias("claim")).agg(F.min("hop").alias("hop")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= C.WALK_HOPS * C.EDGES_PER_HOP)
    asked = sent_if_few(linked, BROADCAST_ROWS)
    sides = [claims.select(F.col("claim_id").alias("claim"), F.col(c).alias("entity")).join(asked, "entity").select("query", "claim") for c in ("subject", "object")]
    own = sides[0].union(sides[1]).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("claim"))).where(F.col("rank") <= limit)
    lists = [near.select("query", F.lit("near").alias("list"), F.col("claim").alias("item"), "rank"), own.select("query", F.lit("own"), "claim", "rank"), walked.select("query", F.lit("walk"), "claim", "rank")]
    fused = cut_lineage(search.rrf(lists[0].union(lists[1]).union(lists[2])).where(F.col("place") <= 4 * limit))
    keyed = claim_keys.withColumnRenamed("claim", "item").join(sent_if_few(fused.select("item").distinct(), BROADCAST_ROWS), "item", "left_semi")
    known = fused.join(keyed, "item").join(vectors, "k")
    items = known.select("query", "item", (F.row_number().over(Window.partitionBy("query").orderBy("place")) - 1).alias("position"), "v")
    return search.mmr(items, min(C.MAX_FACTS, limit)).withColumnRenamed("item", "claim")
