"""Operator 8, SimHash near-duplicates by bit-sliced comparison.

Every text gets a 64-bit fingerprint of its 4-word shingles. Equal fingerprints
are folded first, so copies cost nothing further. Distinct fingerprints within the
radius share at least ``blocks - radius`` of ``blocks`` bit blocks, so each is put
in one bucket for every such choice of blocks; no link can escape all buckets.
Within a bucket, fingerprints are held as vertical bit planes, and the distances of
many pairs grow together in carry-save counters; a tile is left as soon as all its
pairs are beyond the radius. Each bucket yields a spanning set of verified links,
never all pairs, and star contraction turns the links into components. The number of blocks
follows from that of the fingerprints; a bucket too large for a task is parted into tiles,
each pair of which is a task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, materialize

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


#: Fingerprints that a task compares with each other at once; larger buckets are parted.
TILE = 8192
#: Hot buckets (some 20 bytes each) that may be broadcast; beyond it their join shuffles.
BROADCAST_BUCKETS = 500_000
#: Nodes of the links (16 bytes each) that are broadcast at most.
HUBS = 100_000


def shingle_hashes(text: str | None, size: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: 1 - size].tolist(), ends[size - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, len(first))


def fingerprint(text: str | None, size: int = 4) -> int:
    """Bit i is set if it is set in over half the shingle hashes; zero without words."""
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[k : k + 65536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[counts * 2 > len(hashes)].sum(dtype=np.uint64)) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed long; a map without shuffle."""
    arrow_limits(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(prints.view(np.int64), pa.int64())], names=[id_col, "fp"])

    return slim.mapInArrow(each, f"{id_col} {kind}, fp long")


def _bounds(blocks: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit j of plane b is bit b of value j."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pad = -len(values) % 64
    packed = np.packbits(np.pad(bits.T, ((0, 0), (0, pad))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` and ``right`` at ``radius`` or fewer differing bits (radius under 7)."""
    planes = _planes(right)
    ones, twos, fours, over = (np.zeros((len(left), planes.shape[1]), np.uint64) for _ in range(4))
    valid = ~np.zeros(planes.shape[1], np.uint64)
    if len(right) % 64:
        valid[-1] = np.uint64((1 << (len(right) % 64)) - 1)
    for b in range(64):
        mask = (np.uint64(0) - ((left >> np.uint64(b)) & np.uint64(1)))[:, None]
        bit = mask ^ planes[b]
        carry = ones & bit
        ones ^= bit
        bit = twos & carry
        twos ^= carry
        over |= fours & bit  # an eighth difference
        fours ^= bit
        if b % 8 == 7:
            beyond = over | _more(ones, twos, fours, radius)
            over = beyond
            if not ((~beyond) & valid).any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = ~(over | _more(ones, twos, fours, radius)) & valid
    found = np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1, bitorder="little")
    return np.nonzero(found)


def _more(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Where the three-bit counters exceed ``radius``."""
    out = np.zeros_like(ones)
    for k in range(radius + 1, 8):
        out |= (ones if k & 1 else ~ones) & (twos if k & 2 else ~twos) & (fours if k & 4 else ~fours)
    return out


def _spanning(values: np.ndarray, radius: int, other: np.ndarray | None = None, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among distinct fingerprints: (value, root of its tree).

    With ``other`` only links between the two arrays count, which have no value in common.
    """
    right, shift = (values, 0) if other is None else (other, len(values))
    nodes = values if other is None else np.concatenate([values, other])
    parent = np.arange(len(nodes))
    for a in range(0, len(values), tile):
        for b in range(a if other is None else 0, len(right), tile * 8):
            i, j = near_pairs(values[a : a + tile], right[b : b + tile * 8], radius)
            i, j = i + a, j + b + shift
            while len(i):
                x, y = parent[i], parent[j]
                apart = x != y
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while (parent != (up := parent[parent])).any():
                    parent = up
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def choose_blocks(n: int, radius: int) -> int:
    """Blocks whose bucket keys are long enough for ``n`` fingerprints: some 64 in a bucket if they are spread evenly."""
    blocks = radius + 2
    while 64 * (blocks - radius) // blocks + 6 < max(1, n).bit_length() and blocks < 2 * radius + 2:
        blocks += 1
    return blocks


def _tiled(buckets: DataFrame, tile: int) -> DataFrame:
    """(t, m, i, j, side, fp): buckets of more than ``tile`` fingerprints as pairs of tiles, the others whole.

    A tile meets each other tile of its bucket once, so a hot bucket is many small tasks,
    and every pair of its fingerprints is still compared.
    """
    counts = buckets.groupBy("t", "m").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    hot = materialize(counts.select("t", "m", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "hot")
    whole = [F.lit(0).alias(c) for c in ("i", "j", "side")]
    few = hot.count()
    if not few:
        return buckets.select("t", "m", *whole, "fp")
    hint = F.broadcast(hot) if few <= BROADCAST_BUCKETS else hot
    cold = buckets.join(hint.select("t", "m"), ["t", "m"], "left_anti").select("t", "m", *whole, "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    parts = buckets.join(hint, ["t", "m"]).select("t", "m", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("met"))
    return cold.union(parts.select("t", "m", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), (F.col("own") > F.col("met")).cast("int").alias("side"), "fp"))


def fingerprint_links(prints: DataFrame, radius: int = 4, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``, enough to span every component.

    ``blocks`` must exceed ``radius``; with more blocks the bucket keys grow longer and
    buckets smaller, at the price of more buckets for each fingerprint. None chooses them
    from the number of fingerprints. ``tile``: fingerprints that a task compares at once.
    """
    n = prints.count()
    blocks = blocks or choose_blocks(n, radius)
    if not 0 <= radius < min(7, blocks):
        raise ValueError("radius must be under 7 and under the number of blocks")
    bounds = _bounds(blocks)
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in (bounds[c] for c in chosen))
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("m")))
    buckets = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.t", "key.m")
    arrow_limits(prints.sparkSession, rows=65536)
    tiled = _tiled(buckets, tile) if n > tile else buckets.select("t", "m", *[F.lit(0).alias(c) for c in ("i", "j", "side")], "fp")
    dealt = tiled.repartition("t", "m", "i", "j").sortWithinPartitions("t", "m", "i", "j", "side", "fp")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``rows``: whole groups, (t, m, i, j, side, fp) each."""
            if not len(rows):
                return
            change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(rows)]])
            many = np.flatnonzero(ends - starts > 1)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                values = rows[s:e, 5].view(np.uint64)
                if rows[s, 2] != rows[s, 3]:
                    cut = int(np.searchsorted(rows[s:e, 4], 1))
                    found.append(_spanning(values[:cut], radius, values[cut:]))
                elif e - s == 2:
                    if int(values[0] ^ values[1]).bit_count() <= radius:
                        found.append((values[1:], values[:1]))
                else:
                    found.append(_spanning(values, radius))
            if found:
                a = np.concatenate([x[0] for x in found]).view(np.int64)
                b = np.concatenate([x[1] for x in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            same = (rows[:, :4] == rows[-1, :4]).all(axis=1)
            cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from out(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from out(np.concatenate(held))

    return dealt.mapInArrow(each, "a long, b long").distinct()


def _to_least(star: DataFrame, rows: DataFrame, edges: int) -> DataFrame:
    """``star`` (u, v) with ``m``, the least of u and its v in ``rows``.

    Nodes with many rows are joined by broadcast, the others by shuffle, so no task gets a
    hub's rows. At most ``HUBS`` nodes can have so many.
    """
    low = materialize(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low")
    hub = F.col("n") > max(256, 2 * edges // HUBS)
    hubs = F.broadcast(low.where(hub).select("u", "m"))
    return star.join(hubs.select("u"), "u", "left_anti").join(low.where(~hub).select("u", "m"), "u").union(star.join(hubs, "u"))


def min_labels(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Alternate large-star and small-star contraction; every round writes its links to the
    shared folder. Large stars are aggregated and joined, never gathered in a task.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both.where("v > u"), both, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        small = _to_least(large, large, before[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.where("u <> v").distinct(), "links")
        now = state(after)
        if now == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("label"))
        edges, before = after, now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of ``radius`` or fewer bits.
    Texts without words (null, empty, blank) have fingerprint zero and link like any
    other. A null id keeps its row and never names a component unless it has no other
    member. Repeated rows give a row each; other columns aren't read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    label = min_labels(fingerprint_links(nodes.select("fp"), radius, blocks))
    owned = nodes.join(label, nodes.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = owned.groupBy("label").agg(F.min("first").alias("component_id"))
    component = owned.join(smallest, "label").select(F.col("fp").alias("class_fp"), "component_id")
    return prints.join(component, prints.fp == component.class_fp).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Of each component the row with the smallest id; columns unchanged.

    An id names one document: of rows that repeat an id, one stays. Rows with a null id
    stay only if no row of their component has an id, as nothing tells them apart.
    """
    found = near_duplicates(docs, id_col, text_col, radius, blocks)
    first = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_stays")).distinct()
    rest = docs.join(first, docs[id_col].eqNullSafe(first["_stays"]), "left_semi")
    once = rest.withColumn("_row", F.row_number().over(Window.partitionBy(id_col).orderBy(id_col)))
    return once.where((F.col("_row") == 1) | F.col(id_col).isNull()).select(*docs.columns)
