"""An inverted-file index over vectors, with its recall measured against the exact scan.

Centroids are fitted on a bounded sample; every row is put in the cell of its nearest
centroid and written by cell. A query reads the cells nearest to it. How many is read off a
curve: for a bounded sample of queries the exact nearest rows are found, and in which of the
query's cells, by nearness, each of them lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scratch import shared_folder
from tessera.functions.vectors import BLOCK_ROWS, CELLS, usable
from tessera.operators.search import batch_search

#: Vectors that centroids are fitted on, and queries that recall is measured on: the first by a hash of the id.
SAMPLE, MEASURED = 20_000, 200
MOST_CELLS = 4_096
ROUNDS = 12
#: Rows with a vector that a task makes at once.
MADE_ROWS = 1 << 16


@dataclass(frozen=True)
class Index:
    """Rows (id, v, cell, part) under ``path``; a cell is cut into parts of bounded size."""

    path: str
    centroids: np.ndarray
    rows: DataFrame
    parts: DataFrame


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    got = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(most).collect()
    return np.array([r.v for r in got], float) if got else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit_centroids(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by spherical k-means on the first ``sample`` rows by a hash of the id; twice the root of all rows' number unless given."""
    x = _unit(_sample(rows, sample))
    k = min(len(x), MOST_CELLS, cells or max(1, int(2 * rows.count() ** 0.5)))
    if not k:
        return np.zeros((0, 1))
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        of = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, x)
        empty = np.bincount(of, minlength=k) == 0
        centre = np.where(empty[:, None], centre, _unit(total))
    return centre


def nearest_cells(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """``rows`` (id, v) with ``cell`` and ``nearness`` (from 0): a row for each of the ``n`` nearest cells."""
    names = rows.columns
    at = names.index("v")

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            # Some rows at a time: neither their scores nor their copies are held for a whole batch.
            step = max(1, min(CELLS // len(centroids), MADE_ROWS // n))
            for k in range(0, len(pdf), step):
                few = pdf.iloc[k : k + step]
                score = _unit(np.stack(few.iloc[:, at].to_numpy()).astype(float)) @ centroids.T
                order = np.argsort(-np.round(score, 12), axis=1, kind="stable")[:, :n]
                out = few.loc[few.index.repeat(order.shape[1])].copy()
                out["cell"] = order.reshape(-1)
                out["nearness"] = np.tile(np.arange(order.shape[1]), len(few))
                yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(each, f"{schema}, cell int, nearness int")


def build(rows: DataFrame, path: str | None = None, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Index every row of (id, v) under ``path`` (a new folder of the shared one unless given).

    Vectors that can't have a cosine and those of another size than the first are left out.
    A cell of any share of the rows is cut into parts of at most some BLOCK_ROWS of them.
    """
    path = path or shared_folder(rows.sparkSession, "index")
    good = usable(rows.select("id", "v"))
    first = good.select(F.size("v")).take(1)
    good = good.where(F.size("v") == (first[0][0] if first else 0))
    centroids = fit_centroids(good, cells, sample)
    if not len(centroids):
        placed = good.select("id", "v", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("part"))
    else:
        dealt = nearest_cells(good, centroids, 1).drop("nearness")
        counts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("n_parts"))
        placed = dealt.join(counts, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("n_parts")).alias("part"))
    placed.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(path)
    stored = rows.sparkSession.read.schema(placed.schema).parquet(path)
    return Index(path, centroids, stored, stored.groupBy("cell").agg((F.max("part") + 1).alias("n_parts"), F.count("*").alias("size")))


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(id, other, cosine, rank): the nearest ``k`` rows among the ``probes`` cells nearest to each query (id, v).

    A task holds one part of a cell and the queries that ask it, in blocks of their own; only the
    best of each come together. Ties by id; a row doesn't find itself.
    """
    asked = nearest_cells(usable(queries.select("id", "v")), index.centroids, probes).drop("nearness")
    asked = asked.join(index.parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.lit(queries.count()) / BLOCK_ROWS))).select("id", "v", "cell", "part", "block")
    blocks = asked.select(F.col("cell").alias("_c"), F.col("part").alias("_p"), F.col("block").alias("_b")).distinct()
    held = index.rows.join(blocks, (F.col("cell") == F.col("_c")) & (F.col("part") == F.col("_p"))).select("id", "v", "_c", "_p", "_b")

    def product(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": [], "cosine": []}).astype({"id": "int64", "other": "int64", "cosine": "float64"})
        right = right.sort_values("id")
        ids, others = left.id.to_numpy(), right.id.to_numpy()
        p, q = (_unit(np.stack(side.v.to_numpy()).astype(float)) for side in (left, right))
        step = max(1, CELLS // len(others))
        return pd.concat([best_of(ids[j : j + step], others, p[j : j + step] @ q.T) for j in range(0, len(ids), step)], ignore_index=True)

    def best_of(ids: np.ndarray, others: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        c = np.where(ids[:, None] == others[None, :], -np.inf, c)
        best = np.argsort(-np.round(c, 9), axis=1, kind="stable")[:, :k]
        found = pd.DataFrame({"id": np.repeat(ids, best.shape[1]), "other": others[best].reshape(-1), "cosine": np.take_along_axis(c, best, axis=1).reshape(-1)})
        return found[np.isfinite(found.cosine)]

    pairs = asked.groupBy("cell", "part", "block").cogroup(held.groupBy("_c", "_p", "_b")).applyInPandas(product, "id long, other long, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall_curve(index: Index, queries: DataFrame, k: int, measured: int = MEASURED) -> DataFrame:
    """(probes, recall, share_read) for every number of probes, over the first ``measured`` queries by a hash of the id.

    Recall is of the exact ``k`` nearest rows; the share is that of all rows which a query reads on average.
    """
    asked = usable(queries.select("id", "v")).orderBy(F.xxhash64("id"), "id").limit(measured)
    n_cells = len(index.centroids)
    order = nearest_cells(asked, index.centroids, n_cells).select("id", "cell", "nearness")
    truth = batch_search(asked, index.rows.select("id", "v"), k).select("id", "other")
    where = index.rows.select(F.col("id").alias("other"), "cell")
    hits = truth.join(where, "other").join(order, ["id", "cell"]).groupBy("nearness").agg(F.count("*").alias("hits"))
    reads = order.join(index.parts, "cell").groupBy("nearness").agg(F.sum("size").alias("read"))
    both = reads.join(hits, "nearness", "left").na.fill(0, ["hits"])
    # As many rows as there are cells.
    up = Window.orderBy("nearness")
    total = Window.partitionBy()
    return both.select((F.col("nearness") + 1).alias("probes"), (F.sum("hits").over(up) / F.sum("hits").over(total)).alias("recall"), (F.sum("read").over(up) / F.sum("read").over(total)).alias("share_read"))


def choose_probes(curve: DataFrame, recall: float) -> tuple[int, float, float]:
    """The fewest probes of a curve that reach ``recall``, with what they reach and read."""
    row = curve.where(F.col("recall") >= recall).orderBy("probes").first()
    return (row.probes, row.recall, row.share_read) if row else (1, 0.0, 0.0)
