"""Operator 12, Merkle dataset manifest with parent-preimage paths.

Every row is a leaf. What is stored of a parent is its preimage, the concatenated hashes of
its children; a parent's hash is the SHA-256 of it. Leaves are ranked in each group by a range
shuffle, laid in blocks of consecutive leaves, and each block makes its own levels; the
blocks' hashes are the leaves of the next tier, until one hash of a group is left. Going
down, a block joins the preimages above it. A leaf's proof is read from its ancestors'
preimages by cutting out its own slot; folding a replaced leaf writes it into that slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Levels that a block makes: 2 ** 10 nodes meet in a row of some 150 KB.
BLOCK_LEVELS = 10
#: Hex digits of a hash, so the width of a slot.
SLOT = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*written), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (place in its group, from 0) and ``among`` (rows of the group).

    One shuffle by ranges of (group, order), so a group with most rows is spread like any
    other; the places are those in the ranges plus the sizes of the ranges before. Equal rows
    of one group lie in one range; whichever comes first, the hashes are the same.
    """
    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = materialize(sorted_rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "ranked")
    # A group lies in neighbouring ranges: as many rows here as ranges and groups together.
    parts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    own = Window.partitionBy(group).orderBy("_part")
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("_n").over(own) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("among"))
    met = dealt.join(parts, dealt[group].eqNullSafe(parts["_g"]) & (dealt["_part"] == parts["_p"]))
    return met.withColumn("at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_g", "_p", "_shift")


def _climb(nodes: Column, levels: Column) -> Column:
    """(preimages by level, nodes of the last level) over ``levels`` levels of pairs of ``nodes``."""

    def parents(below: Column) -> Column:
        last = ((F.size(below) + 1) / 2).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.concat(F.get(below, 2 * j), F.coalesce(F.get(below, 2 * j + 1), F.lit(""))))

    def step(acc: Column, _: Column) -> Column:
        # The filter binds the level's preimages to a name, so that they aren't made twice.
        made = F.transform(F.array(parents(acc["nodes"])), lambda p: F.struct(F.concat(acc["levels"], F.array(p)).alias("levels"), F.transform(p, lambda x: F.sha2(x, 256)).alias("nodes")))
        return F.get(made, F.lit(0))

    start = F.struct(F.array().cast("array<array<string>>").alias("levels"), nodes.alias("nodes"))
    return F.aggregate(F.filter(F.sequence(F.lit(0), levels), lambda k: k > 0), start, step)


def _blocks(rows: DataFrame, group: str) -> DataFrame:
    """(group, block, items, made) of rows (group, at, among, node, item): blocks of consecutive nodes with their levels."""
    need = F.ceil(F.log2(F.col("among").cast("double"))).cast("int")
    # log2 of large counts may be off by a rounding: corrected by the powers themselves.
    power = lambda k: F.pow(F.lit(2.0), k)
    need = F.when(power(need - 1) >= F.col("among"), need - 1).when(power(need) < F.col("among"), need + 1).otherwise(need)
    levels = F.least(need, F.lit(BLOCK_LEVELS))
    cells = rows.groupBy(group, F.shiftright("at", BLOCK_LEVELS).alias("block")).agg(F.max("among").alias("among"), F.sort_array(F.collect_list(F.struct("at", "node", "item"))).alias("cells"))
    made = _climb(F.transform("cells", lambda c: c["node"]), levels)
    return cells.select(group, "block", "among", F.transform("cells", lambda c: c["item"]).alias("items"), made.alias("made"))


def _path(levels: Column, place: Column) -> Column:
    """The ancestors' preimages of the node at ``place``, lowest first, each with the node's slot in it."""
    return F.transform(levels, lambda level, k: F.struct(F.get(level, _half(place, k + 1)).alias("preimage"), (_half(place, k) % 2).alias("slot")))


def _half(place: Column, times: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), times)).cast("int")


def _sibling(step: Column) -> Column:
    """A preimage without the node's own slot."""
    return F.concat(F.substring(step["preimage"], F.lit(1), step["slot"] * SLOT), F.substring(step["preimage"], step["slot"] * SLOT + SLOT + 1, F.lit(SLOT)))


def _fold(path: Column, node: Column) -> Column:
    """The root over ``node`` written into its slot, and the result into the next one, and so on."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["slot"] * SLOT + 1, F.lit(SLOT)), 256))


def trees(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The trees of rows (group, at, among, node, item), all at once.

    Returns (group, block, items, levels, above, root) by block of leaves, where ``above`` is the
    path from the block to the group's root, and (group, root) by group.
    """
    tiers = []
    tier = materialize(_blocks(rows, group), "tier")
    while True:
        tiers.append(tier)
        top = tier.select(group, F.col("block").alias("at"), F.ceil(F.col("among") / (1 << BLOCK_LEVELS)).alias("among"), F.get("made.nodes", F.lit(0)).alias("node"), F.col("block").alias("item"))
        if not tier.where(F.col("among") > 1 << BLOCK_LEVELS).take(1):
            break
        tier = materialize(_blocks(top, group), "tier")
    roots = tier.select(group, F.get("made.nodes", F.lit(0)).alias("root"))
    empty = F.array().cast("array<struct<preimage:string,slot:int>>")
    paths = tier.select(group, "block", "items", F.col("made.levels").alias("levels"), empty.alias("above"), F.get("made.nodes", F.lit(0)).alias("root"))
    for below in reversed(tiers[:-1]):
        # Each block's nodes are the blocks of the tier below.
        place = F.col("_place")
        path = F.concat(_path(F.col("levels"), place), "above")
        down = paths.select(F.col(group).alias("_g"), "levels", "above", "root", F.posexplode("items").alias("_place", "_block"))
        down = down.select("_g", "_block", path.alias("above"), "root")
        met = below.join(down, below[group].eqNullSafe(down["_g"]) & (below["block"] == down["_block"]))
        paths = met.select(group, "block", "items", F.col("made.levels").alias("levels"), "above", "root")
    return paths, roots


def manifest(docs: DataFrame, replaced: dict[str, Column] | None = None, where: Column | None = None, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, leaf, subroot, root, siblings, folded_root, verified) of every row.

    A leaf is the hash of ``fields``; leaves of a ``group`` ascend by ``key``, and by hash where
    keys repeat (a null key first); groups, the null one first, ascend bytewise. ``siblings`` are the
    proof from the leaf to the root. ``folded_root`` is made from the siblings and the leaf as it
    is with the columns ``replaced`` where ``where`` holds, from the original one elsewhere.
    Rows that repeat give a row each; an empty table gives none; columns but ``fields``,
    whatever their names, aren't read. Texts are hashed where they are read; what moves is a key
    and hashes of 32 bytes.
    """
    replaced = replaced or {}
    original = leaf_hash([docs[f] for f in fields])
    other = leaf_hash([replaced.get(f, docs[f]) for f in fields])
    packed = F.when(F.coalesce(where, F.lit(False)), F.unhex(other)) if where is not None else F.lit(None).cast("binary")
    leaves = docs.select(docs[group].cast("string").alias("_lang"), docs[key].alias("_key"), F.unhex(original).alias("_leaf"), packed.alias("_other"))
    placed = ranked(leaves, "_lang", ["_key", "_leaf"])
    text = lambda c: F.lower(F.hex(c))
    rows = placed.select("_lang", "at", "among", text("_leaf").alias("node"), F.struct("_key", "_other").alias("item"))
    blocks, subroots = trees(rows, "_lang")

    # The groups' roots are the leaves of one tree more.
    subroots = ranked(materialize(subroots.select(F.lit(0).alias("_all"), "_lang", F.col("root").alias("subroot")), "subroots"), "_all", ["_lang"])
    over, _ = trees(subroots.select("_all", "at", "among", F.col("subroot").alias("node"), F.struct(F.col("_lang").alias("name"), "subroot").alias("item")), "_all")
    of_group = over.select("levels", "above", "root", F.posexplode("items").alias("_place", "_item"))
    of_group = of_group.select(F.col("_item.name").alias("_g"), "root", F.col("_item.subroot").alias("subroot"), F.concat(_path(F.col("levels"), F.col("_place")), "above").alias("_top"))
    blocks = blocks.drop("root")
    met = blocks.join(of_group, blocks["_lang"].eqNullSafe(of_group["_g"]))

    def leaf(item: Column, place: Column) -> Column:
        path = F.concat(_path(F.col("levels"), place), "above", "_top")
        own = F.get(F.get("levels", F.lit(0)), _half(place, F.lit(1)))
        # A lone leaf of its group is the subroot.
        own = F.coalesce(F.substring(own, place % 2 * SLOT + 1, F.lit(SLOT)), F.col("subroot"))
        bound = F.transform(F.array(path), lambda p: F.struct(
            item["_key"].alias(key), own.alias("leaf"),
            F.filter(F.transform(p, _sibling), lambda s: s != "").alias("siblings"),
            _fold(p, F.coalesce(text(item["_other"]), own)).alias("folded_root"),
        ))
        return F.get(bound, F.lit(0))

    out = met.select("subroot", "root", F.explode(F.transform("items", leaf)).alias("_l"))
    return out.select("_l.*", "subroot", "root", (F.col("_l.folded_root") == F.col("root")).alias("verified"))
