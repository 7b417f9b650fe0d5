"""The read API: paths answered by registered queries, each a DataFrame."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.recall import words_of
from tessera.plans import registry
from tessera.sources import adapters as A

# The paths that can be read, the query that answers, and the column that a
# part of the path selects.
ROUTES = (
    ("/api/health", "health", None),
    ("/health", "health", None),
    ("/api/librarian/health", "librarian_health", None),
    ("/api/librarian/graph/stats", "graph_stats", None),
    ("/api/librarian/graph/3d", "catalog_edges", None),
    ("/api/librarian/graph", "catalog_edges", None),
    ("/api/librarian/graph/ghost", "undirected_knn", None),
    ("/api/librarian/chunks", "chunk_documents", None),
    ("/api/librarian/search", "vector_search", None),
    ("/api/librarian/verify", "orphan_bridges", None),
    ("/api/librarian/nouns/{id}/hop", "noun_hop", "noun"),
    ("/api/librarian/nodes/{id}", "vertex_audit", "id"),
    ("/api/librarian/nodes/{id}/audit", "vertex_audit", "id"),
    ("/api/librarian/explorer/owners", "explorer_owners", None),
    ("/api/librarian/explorer/snapshot", "explorer_snapshot", None),
)
SAFE_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def check_label(label: str | None) -> str:
    """``label`` if it is a safe name of a vertex or edge kind; else ValueError."""
    if not label or not re.fullmatch(SAFE_NAME, label):
        raise ValueError(f"invalid label: {label!r}")
    return label


#: Rows of an answer unless ``limit`` says less or more, and the most it can say.
DEFAULT_LIMIT, MOST = 2_000, 10_000


def route(path: str) -> tuple[str, str | None, int | None]:
    """(query, column, value) that answer a GET of ``path``; LookupError if none does."""
    asked = urlsplit(path).path.rstrip("/") or "/"
    for pattern, name, column in ROUTES:
        found = re.fullmatch(re.escape(pattern).replace(re.escape("{id}"), r"(\d+)"), asked)
        if found:
            return name, column, int(found[1]) if column else None
    raise LookupError(path)


def clamp_limit(text: str | None) -> int:
    """``text`` as a number of rows from 1 to MOST; DEFAULT_LIMIT if it is none."""
    return min(MOST, max(1, int(text))) if text and re.fullmatch(r"-?\d+", text) else DEFAULT_LIMIT


def text_search(turns: DataFrame, q: str, limit: int) -> DataFrame:
    """(id, owner, session_id, overlap) of the turns that hold most of the words of ``q``: the newest of equals first."""
    asked = F.array_distinct(words_of(X.normalize_surface(F.lit(q))))
    overlap = F.size(F.array_intersect(words_of(X.normalize_surface(F.col("content"))), asked)).alias("overlap")
    return turns.select("id", "owner", "session_id", "ts", overlap).where("overlap > 0").orderBy(F.desc("overlap"), F.desc("ts"), "id").limit(limit).drop("ts")


def respond(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The rows that answer a GET of ``path`` with its parameters.

    A part that names a node is a filter on the query's rows, and so are ``owner`` and ``label`` where
    the rows have such a column; the explorer's snapshot must have an owner. Search takes
    its words from ``q``; ``limit`` bounds the rows. ValueError where a parameter can't be.
    """
    name, column, value = route(path)
    given = {k: v[0].strip() for k, v in parse_qs(urlsplit(path).query).items()}
    limit, owner, label = clamp_limit(given.get("limit")), given.get("owner"), given.get("label")
    if name == "health":
        return spark.range(1).select(F.lit("ok").alias("status"))
    if name == "explorer_snapshot" and not owner:
        raise ValueError("the snapshot needs an owner")
    if name == "vector_search":
        if not given.get("q"):
            raise ValueError("search needs q")
        t = A.turns(spark, sf_dir)
        return text_search(t.where(F.col("owner") == owner) if owner else t, given["q"], limit)
    df = registry.QUERIES[name](spark, sf_dir)
    if column:
        df = df.where(F.col(column) == value)
    if owner and "owner" in df.columns:
        df = df.where(F.col("owner") == owner)
    if label and "label" in df.columns:
        df = df.where(F.col("label") == check_label(label))
    return df.limit(limit)
