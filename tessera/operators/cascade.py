"""What a deletion takes along: a fixpoint over the references between rows of all tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scratch import keep

#: What a row does when a row it refers to goes: it goes too, it loses the reference, or it goes with the last of its supports.
CASCADE, UNLINK, SUPPORT = "cascade", "unlink", "support"
#: Ids of deleted rows that are sent to every task at most; more are joined by shuffle.
BROADCAST_GONE = 250_000


@dataclass(frozen=True)
class Reference:
    """References of rows of ``child`` to rows of ``parent``; ``rows``: child_id, parent_id."""

    child: str
    parent: str
    rows: DataFrame
    action: str


def _by_kind(references: DataFrame) -> list[Reference]:
    """A table of references (child, child_id, parent, parent_id, action) by the relations that they join."""
    held = keep(references, "references")
    kinds = held.select("child", "parent", "action").distinct().collect()
    return [Reference(k.child, k.parent, held.where((F.col("child") == k.child) & (F.col("parent") == k.parent) & (F.col("action") == k.action)).select("child_id", "parent_id"), k.action) for k in kinds]


def _levels(relations: set[str], edges: set[tuple[str, str]]) -> list[set[str]]:
    """Relations (names alone) such that parents come before children; those that refer to each other in a circle are one level."""
    reach = {r: {r} for r in relations}
    for _ in relations:
        for parent, child in edges:
            reach[parent] = reach[parent] | reach[child]
    circles = {frozenset(b for b in reach[a] if a in reach[b]) for a in relations}
    return sorted((set(c) for c in circles), key=lambda c: (-len(reach[min(c)]), min(c)))


def deletion_closure(references: DataFrame | list[Reference], seeds: DataFrame) -> DataFrame:
    """(relation, id, deed, lost): rows that go with ``seeds`` (relation, id), and references that are lost.

    ``references``: a list by relations, whose ids keep their type, or one table of child,
    child_id, parent, parent_id, action, a row for each reference of a row.
    deed is ``delete`` (lost is null) or ``unlink`` (lost: the relation and id that is no longer
    referred to); what is deleted has no unlink. Relations are settled parents first, so
    references are read once, by the relations they join; only those of relations that refer to
    each other in a circle (or to themselves) are read in rounds, as many as the longest chain,
    and cycles end as every row goes once. A row with supports goes when none of them stands.
    Null ids refer to nothing. Deleting again what is gone finds nothing more.
    """
    refs = _by_kind(references) if isinstance(references, DataFrame) else references
    planted = keep(seeds.where("relation is not null and id is not null").select("relation", "id").distinct(), "seeds")
    names = {r.relation for r in planted.select("relation").distinct().collect()}
    # Whole numbers stay numbers where all ids of a relation are; any others meet as text.
    kinds: dict[str, set[str]] = {}
    for name, kind in [(n, planted.schema["id"].dataType.simpleString()) for n in names] + [(r, ref.rows.schema[c].dataType.simpleString()) for ref in refs for r, c in ((ref.child, "child_id"), (ref.parent, "parent_id"))]:
        kinds.setdefault(name, set()).add(kind)
    kind_of = {name: "bigint" if found <= {"bigint", "int"} else "string" for name, found in kinds.items()}
    refs = [Reference(r.child, r.parent, r.rows.where("child_id is not null and parent_id is not null").select(F.col("child_id").cast(kind_of[r.child]).alias("child_id"), F.col("parent_id").cast(kind_of[r.parent]).alias("parent_id")), r.action) for r in refs]
    takes = [r for r in refs if r.action in (CASCADE, SUPPORT)]
    gone: dict[str, DataFrame] = {}
    many: dict[str, int] = {}

    def sent(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows) if n <= BROADCAST_GONE else rows

    def fallen(front: dict[str, DataFrame], relation: str, among: list[Reference]) -> DataFrame | None:
        """Ids of ``relation`` that go by ``among``: with ``front``, or as no support is left outside ``gone``."""
        parts = [r.rows.join(front[r.parent].withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select(F.col("child_id").alias("id")) for r in among if r.action == CASCADE and r.child == relation and r.parent in front]
        if any(r.action == SUPPORT and r.child == relation and r.parent in front for r in among):
            flagged = []
            for r in takes:
                if r.action == SUPPORT and r.child == relation:
                    went = gone[r.parent].select(F.col("id").alias("parent_id"), F.lit(True).alias("went")) if r.parent in gone else None
                    flagged.append(r.rows.join(sent(went, many[r.parent]), "parent_id", "left").select("child_id", F.col("went").isNotNull().alias("went")) if went is not None else r.rows.select("child_id", F.lit(False).alias("went")))
            bare = reduce(DataFrame.unionByName, flagged).groupBy("child_id").agg(F.bool_and("went").alias("went"))
            parts.append(bare.where("went").select(F.col("child_id").alias("id")))
        return reduce(DataFrame.unionByName, parts).distinct() if parts else None

    for level in _levels({*kind_of}, {(r.parent, r.child) for r in takes}):
        before = [r for r in takes if r.child in level and r.parent not in level]
        within = [r for r in takes if r.child in level and r.parent in level]
        # All of the level's seeds and what its settled parents take; then rounds within.
        above = {p: sent(gone[p], many[p]) for p in {r.parent for r in before} if p in gone}
        front: dict[str, DataFrame] = {}
        for name in level:
            parts = [planted.where(F.col("relation") == name).select(F.col("id").cast(kind_of[name]).alias("id"))] if name in names else []
            parts += [x for x in [fallen(above, name, before)] if x is not None]
            if parts:
                front[name] = keep(reduce(DataFrame.unionByName, parts).distinct(), "gone")
        while sizes := {name: n for name, rows in front.items() if (n := rows.count())}:
            for name, n in sizes.items():
                gone[name] = gone[name].unionByName(front[name]) if name in gone else front[name]
                many[name] = many.get(name, 0) + n
            if not within:
                break
            marked = {name: sent(front[name], n) for name, n in sizes.items()}
            found = {name: fallen(marked, name, within) for name in level}
            front = {name: keep(rows.join(sent(gone[name], many[name]), "id", "left_anti") if name in gone else rows, "gone") for name, rows in found.items() if rows is not None}

    none = F.lit(None).cast("string")
    out = [rows.select(F.lit(name).alias("relation"), F.col("id").cast("string").alias("id"), F.lit("delete").alias("deed"), none.alias("lost")) for name, rows in gone.items()]
    for r in refs:
        if r.action == UNLINK and r.parent in gone:
            lost = r.rows.join(sent(gone[r.parent].withColumnRenamed("id", "parent_id"), many[r.parent]), "parent_id", "left_semi")
            if r.child in gone:
                lost = lost.join(sent(gone[r.child].withColumnRenamed("id", "child_id"), many[r.child]), "child_id", "left_anti")
            lost = lost.distinct()
            out.append(lost.select(F.lit(r.child).alias("relation"), F.col("child_id").cast("string").alias("id"), F.lit("unlink").alias("deed"), F.concat_ws(":", F.lit(r.parent), F.col("parent_id").cast("string")).alias("lost")))
    empty = planted.where("false").select("relation", F.col("id").cast("string").alias("id"), F.lit("delete").alias("deed"), none.alias("lost"))
    return reduce(DataFrame.unionByName, out, empty)
