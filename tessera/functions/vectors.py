"""Vector expressions (one query against many rows) and block products (many against many)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, on_invalid: float | None = None) -> Column:
    """Cosine of two arrays; ``on_invalid`` where one is empty, sizes differ or a norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    good = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(good, dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(F.lit(on_invalid).cast("double"))


def normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def parse_vector(text: Column) -> Column:
    """'[1,2]' as array<double>; null if it isn't one."""
    return F.from_json(text, "array<double>")


#: Vectors of a block where blocks follow from counts, and cosines that a task holds at once.
BLOCK_ROWS, CELLS = 16_000, 1 << 20
#: Fewest blocks of a side, so that small tables use several tasks.
LEAST_BLOCKS = 4


def blocks_of(rows: DataFrame, least: int = LEAST_BLOCKS) -> int:
    """So many blocks that none holds much more than BLOCK_ROWS vectors."""
    return max(least, -(-rows.count() // BLOCK_ROWS))


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector ``v`` can have a cosine: not null, not empty, without null elements."""
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))


def block_pairs(left: DataFrame, right: DataFrame, floor: float, top: int | None = None, blocks: int | None = None, left_blocks: int | None = None, group: str | None = None, undirected: bool = False) -> DataFrame:
    """(id, other, cosine) of ids of ``left`` and ``right`` (id long, v array<double>), at ``floor`` or above.

    The sides are cut into ``left_blocks`` and ``blocks`` blocks, by default as many as their
    counts ask for (``blocks`` of them on both sides if ``undirected``); each pair of blocks is
    one task with a matrix product made some rows at a time, so a task holds two blocks, never
    a side or the blocks' cosines, whatever the size of a ``group``. A side is copied as often as the other has blocks. ``group``: a column
    of both sides within which pairs are made. ``top``: keep a row's best within each pair of
    blocks before the exchange; ties by id. Null and empty vectors, those with null elements
    and those of zero norm have no cosine and pair with nothing, as do vectors of different sizes.
    """
    left, right = usable(left), usable(right)
    n_right = blocks or blocks_of(right)
    n_left = left_blocks or (n_right if undirected else blocks or blocks_of(left))
    rows, columns = F.lit(n_left), F.lit(n_right)
    # Vectors of one size meet.
    within = [F.struct(F.size("v").alias("size"), *([F.col(group).alias("group")] if group else [])).alias("g")]
    a = left.select("id", "v", *within, F.pmod(F.xxhash64("id"), rows).cast("int").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), columns - 1))).withColumn("side", F.lit(0))
    b = right.select("id", "v", *within, F.pmod(F.xxhash64("id"), columns).cast("int").alias("b")).withColumn("a", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("side", F.lit(1))
    if undirected:
        a, b = a.where("a <= b"), b.where("a <= b")

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "other": [], "cosine": []}).astype({"id": "int64", "other": "int64", "cosine": "float64"})
        x, y = x.sort_values("id"), y.sort_values("id")
        ids, others = x.id.to_numpy(), y.id.to_numpy()
        p, q = unit(x.v), unit(y.v).T
        step = max(1, CELLS // len(others))
        return pd.concat([part(ids[k : k + step], others, p[k : k + step] @ q, key) for k in range(0, len(ids), step)], ignore_index=True)

    def unit(v: pd.Series) -> np.ndarray:
        rows = np.stack(v.to_numpy()).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def part(ids: np.ndarray, others: np.ndarray, c: np.ndarray, key: tuple) -> pd.DataFrame:
        """What is kept of some rows' cosines."""
        c = np.where(np.isfinite(c), c, -np.inf)
        keep = (c >= floor) & (ids[:, None] != others[None, :])
        if undirected:
            keep &= (ids[:, None] < others[None, :]) | (key[1] != key[2])
        # Rows with no more than ``top`` at the floor keep them all.
        many = np.flatnonzero(keep.sum(axis=1) > top) if top is not None else []
        if len(many):
            # Stable order: the cosine downwards, then the id; others are sorted already.
            rank = np.argsort(-np.round(c[many], 9), axis=1, kind="stable")[:, : top + 1]
            best = np.zeros((len(many), c.shape[1]), bool)
            np.put_along_axis(best, rank, True, axis=1)
            keep[many] &= best
        i, j = np.nonzero(keep)
        return pd.DataFrame({"id": ids[i], "other": others[j], "cosine": c[i, j]})

    return a.unionByName(b).groupBy("g", "a", "b").applyInPandas(product, "id long, other long, cosine double")


#: Ids of a stretch of vectors that a task holds of each side.
STRETCH = 4_096


def cosines_of_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of distinct pairs of ids (a, b long) that both have a vector (id, v); null where there is no cosine.

    Pairs meet in cells of two stretches of ids. A vector goes once to each cell that has a pair
    of it, not along with every pair; so a task holds the vectors of two stretches, and their
    pairs as numbers. Vectors travel in the type they have.
    """
    cell = lambda c: F.floor(F.col(c) / STRETCH).cast("long")
    dealt = pairs.where("a is not null and b is not null").select("a", "b", cell("a").alias("_a"), cell("b").alias("_b"))
    held = None
    for side, end in enumerate(("a", "b")):
        asked = dealt.select(F.col("_a").alias("_p"), F.col("_b").alias("_q"), F.col(end).alias("id")).distinct()
        part = asked.join(vectors.select("id", "v"), "id").select("_p", "_q", F.lit(side).alias("side"), "id", "v")
        held = part if held is None else held.unionByName(part)

    def meet(_: tuple, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        at, rows = {}, {}
        for side in (0, 1):
            of = found[found.side == side]
            at[side] = {k: i for i, k in enumerate(of.id)}
            rows[side] = [np.asarray(v if v is not None else [], float) for v in of.v]
        places = [pdf[end].map(at[side]) for side, end in enumerate(("a", "b"))]
        good = places[0].notna() & places[1].notna()
        i, j = (p[good].to_numpy().astype(int) for p in places)
        out = pdf.loc[good, ["a", "b"]].copy()
        sizes = [np.array([len(r) for r in rows[side]], int) for side in (0, 1)]
        c = np.full(len(out), np.nan)
        for size in np.unique(sizes[0]):
            if not size:
                continue
            pick = [np.flatnonzero(s == size) for s in sizes]
            if not len(pick[1]):
                continue
            # Vectors of one size as a matrix, and each vector's row in it.
            tables, where = [], []
            for side in (0, 1):
                m = np.stack([rows[side][k] for k in pick[side]])
                with np.errstate(divide="ignore", invalid="ignore"):
                    tables.append(m / np.linalg.norm(m, axis=1, keepdims=True))
                w = np.full(len(sizes[side]), -1)
                w[pick[side]] = np.arange(len(pick[side]))
                where.append(w)
            x, y = where[0][i], where[1][j]
            both = np.flatnonzero((x >= 0) & (y >= 0))
            step = max(1, CELLS // int(size))
            for k in range(0, len(both), step):
                few = both[k : k + step]
                c[few] = np.einsum("ij,ij->i", tables[0][x[few]], tables[1][y[few]])
        out["cosine"] = pd.array(c, dtype="Float64")
        out["cosine"] = out["cosine"].mask(~np.isfinite(c))
        return out

    return dealt.groupBy("_a", "_b").cogroup(held.groupBy("_p", "_q")).applyInPandas(meet, "a long, b long, cosine double")


def hash_embedding(dim: int = 64):
    """A deterministic stand-in for an embedding endpoint: null for blank texts."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for t in texts:
                if t is None or not t.strip():
                    out.append(None)
                    continue
                v = np.zeros(dim)
                for w in t.lower().split():
                    h = pd.util.hash_array(np.array([w], object))[0]
                    v[int(h % np.uint64(dim))] += 1.0 if (h >> np.uint64(32)) & np.uint64(1) else -1.0
                norm = np.linalg.norm(v)
                out.append((v / norm).tolist() if norm else None)
            yield pd.Series(out)

    return embed
