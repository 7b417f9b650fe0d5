"""Merging entities: one map from ids to keepers, applied to every relation that names them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """A relation that names entities.

    ``refs``: columns with ids. ``keys``: the columns that tell its rows apart; rows that a merge
    makes equal become one. ``folds``: how each other column of such rows is put together.
    ``loops``: whether a row may name one entity twice.
    """

    rows: DataFrame
    refs: tuple[str, ...]
    keys: tuple[str, ...]
    folds: dict[str, Column] = field(default_factory=dict)
    loops: bool = True


def merge_entities(keepers: DataFrame, relations: dict[str, Relation]) -> dict[str, DataFrame]:
    """Each relation with the ids of ``keepers`` (id, keeper) replaced and its rows folded.

    Keepers must be final (no keeper with another keeper). Ids that aren't in the map, and null
    ones, stay. Folds are aggregates, so an entity that takes in most rows is partly folded
    before the exchange. Merging again changes nothing, as long as the folds of one row give the row.
    """
    out = {}
    for name, r in relations.items():
        rows = r.rows
        for c in r.refs:
            to = keepers.where("id is not null and keeper is not null and id <> keeper").select(F.col("id").alias("_from"), F.col("keeper").alias("_to"))
            rows = rows.join(to, rows[c] == to["_from"], "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
        if not r.loops:
            a, b = r.refs
            rows = rows.where(~F.col(a).eqNullSafe(F.col(b)))
        folded = [fold.alias(c) for c, fold in r.folds.items()]
        out[name] = rows.groupBy(*r.keys).agg(*folded) if folded else rows.select(*r.keys).distinct()
    return out


def last_by(value: str, *order: str) -> Column:
    """A fold: the value of the row that is last by ``order`` (ties: the larger value)."""
    return F.max(F.struct(*order, value))[value]
