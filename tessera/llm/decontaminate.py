"""Operator 9, benchmark decontamination by SimHash windows.

Every window of a document that has as many words as a benchmark item and can be similar
to any item gets a SimHash fingerprint of 128 bits. Item fingerprints are indexed by
eight blocks of 16 bits: two fingerprints within ``RADIUS`` bits differ by three bits at
most in one of them, so items enter each block with all values within two bits, windows
probe it with all values within one, and no fingerprint within the radius is missed.
Candidates within the radius are verified by exact weighted-shingle similarity.

Which windows can be similar to any item of their length: at a similarity s two windows of
m shingles share at least 2 s m / (1 + s) of them, so that many shingles of the window
occur in items of that length, wherever they lie in them. That bound leaves out windows
but names no item; the fingerprints alone find the items. All steps are built-in DataFrame expressions; the
shingle hashes of all positions run in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialize

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS = 8, 16
#: Bits by which an item's entries and a window's probes differ from its own block at most.
ITEM_BITS, WINDOW_BITS = 2, 1
#: Beyond it every block may differ by more bits than entries and probes bridge.
RADIUS = BLOCKS * (ITEM_BITS + WINDOW_BITS + 1) - 1
#: Rows that may be broadcast: shingle hashes and lengths (12 bytes), index entries (some 50), documents with item shingles (24).
BROADCAST_SHINGLES = 2_000_000
BROADCAST_ENTRIES = 500_000
BROADCAST_DOCS = 500_000
_DROPPED = ".,;:!?\"'()[]"
_LANES = (1 << 32) + 1


def normal_words(text: Column) -> Column:
    """Lower-case words without sentence punctuation; null has none."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), _DROPPED, "")
    return F.regexp_extract_all(plain, F.lit(f"({WORD})"), F.lit(1))


def _chain(words: str, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from ``at`` on."""
    return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(size)])


def _hashes(words: str, size: Column, sizes: list[int]) -> Column:
    """The hashes of all shingles of ``size`` words, one of ``sizes``; none if there are fewer words."""


    def whole(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - k)), lambda i: _chain(words, i, k))

    out = F.array().cast("array<long>")
    for k in sizes:
        out = F.when((size == k) & (F.size(words) >= k), whole(k)).otherwise(out)
    return out


def simhash(hashes: str) -> Column:
    """array<long> of two halves: a bit is set if over half of the hashes have it.

    Two counters share a long: lane sums of bits b and b + 32 are one addition. The second
    half counts the bits of the hashes' own hashes.
    """
    fields = [f"s{family}_{b}" for family in range(2) for b in range(32)]
    zero = "named_struct(" + ", ".join(f"'{f}', 0L" for f in fields) + ")"
    step = "named_struct(" + ", ".join(f"'s{family}_{b}', a.s{family}_{b} + (shiftrightunsigned({h}, {b}) & {_LANES}L)" for family, h in enumerate(("x.h", "x.g")) for b in range(32)) + ")"
    # A lane's count exceeds half of all if adding 2 ** 30 - 1 - half carries into bit 30.
    full = f"({(1 << 30) - 1}L - shiftright(size({hashes}), 1)) * {_LANES}L"
    halves = [" | ".join(f"shiftleft(shiftrightunsigned(a.s{family}_{b} + {full}, 30) & {_LANES}L, {b})" for b in range(32)) for family in range(2)]
    pairs = f"transform({hashes}, h -> named_struct('h', h, 'g', xxhash64(h, 1)))"
    return F.expr(f"aggregate({pairs}, {zero}, (a, x) -> {step}, a -> array({', '.join(halves)}))")


def _blocks(fp: str, bits: int) -> Column:
    """Every (block, value) whose value is within ``bits`` of the fingerprint's, as one long each."""
    masks = F.array(*[F.lit(x) for x in range(1 << BLOCK_BITS) if x.bit_count() <= bits])


    def part(k: int) -> Column:
        own = F.shiftrightunsigned(F.get(F.col(fp), F.lit(k // 4)), BLOCK_BITS * (k % 4)).bitwiseAND((1 << BLOCK_BITS) - 1)
        return F.transform(masks, lambda x: F.lit(k << BLOCK_BITS) + own.bitwiseXOR(x))

    return F.concat(*[part(k) for k in range(BLOCKS)])


def _numbered(hashes: str) -> Column:
    """Hashes made distinct by counting repeats, so that set sizes weigh each shingle by how often it occurs."""
    repeats = f"transform(array(array_sort({hashes})), s -> transform(s, (x, i) -> xxhash64(x, i + 1 - array_position(s, x))))[0]"
    return F.expr(f"if(size(array_distinct({hashes})) = size({hashes}), transform({hashes}, x -> xxhash64(x, 0L)), {repeats})")


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; else the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start, distance, similarity): each pair of a document and an item it holds.

    ``start`` is the word at which the most similar window begins (the first of equals),
    ``distance`` its fingerprint's from the item's. A window has as many words as its item;
    a document with fewer words is one window. Items under five words are one shingle. Null
    and empty texts hold nothing and are held by nothing. Repeated rows give one result;
    documents with a null id are left out, items with one are found as null. Other columns
    aren't read.
    """
    items = items.select(F.col(item_id).alias("_item"), normal_words(F.col(item_text)).alias("_iw")).where("size(_iw) > 0").dropDuplicates()
    items = items.withColumn("_n", F.size("_iw")).withColumn("_size", F.least("_n", F.lit(SHINGLE)))
    items = materialize(items.withColumn("_ih", _hashes("_iw", F.col("_size"), list(range(1, SHINGLE + 1)))).drop("_iw"), "items")
    sizes = [r["_size"] for r in items.select("_size").distinct().orderBy("_size").collect()] or [SHINGLE]  # at most five
    shingles = materialize(items.select("_n", F.explode("_ih").alias("_k")).distinct(), "shingles")
    hint = _small(shingles, shingles.count(), BROADCAST_SHINGLES)

    # Places of documents where a shingle of some item lies, for each item length.
    words = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_t"), normal_words(F.col(text_col)).alias("_w")).where("_doc is not null")
    at = words.where("size(_w) > 0").select("_doc", "_t", "_w", F.explode(F.expr("sequence(0, size(_w) - 1)")).alias("_at"))
    parts = [F.when(F.col("_at") + k <= F.size("_w"), _chain("_w", F.col("_at"), k)) for k in sizes]
    key = parts[0] if len(parts) == 1 else F.explode(F.array(*parts))  # sizes are hashed apart: a short item's shingle is met by none of five words
    placed = at.select("_doc", "_t", "_at", key.alias("_k")).where("_k is not null")
    live = placed.join(hint, "_k").groupBy("_doc", "_t", "_n").agg(F.sort_array(F.collect_set("_at")).alias("_live"))
    live = materialize(live, "live")

    # Windows of each item length in which enough of the shingles lie at such places.
    m = F.greatest(F.lit(1), F.col("_n") - (SHINGLE - 1))
    lengths = items.select("_n", "_size", m.alias("_m")).distinct()
    lengths = lengths.withColumn("_need", F.ceil(F.lit(2 * SIMILARITY / (1 + SIMILARITY)) * F.col("_m") - 1e-9).cast("int")).withColumn("_least", F.ceil(F.lit(SIMILARITY) * F.col("_m") - 1e-9).cast("int"))
    lengths = materialize(lengths, "lengths")
    held = live.join(_small(lengths, lengths.count(), BROADCAST_DOCS), "_n").where("size(_live) >= _least").select("_doc", "_t").distinct()
    texts = words.join(_small(held, held.count(), BROADCAST_DOCS), ["_doc", "_t"], "left_semi").dropDuplicates(["_doc", "_t"])
    fits = live.join(_small(lengths, lengths.count(), BROADCAST_DOCS), "_n").where("size(_live) >= _least").join(texts, ["_doc", "_t"])
    fits = fits.withColumn("_words", F.size("_w")).where("size(_live) >= if(_words >= _n, _need, _least)").withColumn("_h", _hashes("_w", F.col("_size"), sizes))
    dense = "_live[i + _need - 1] - _live[i] < _m"
    from_, to = "greatest(0, _live[i + _need - 1] - _m + 1)", "least(_live[i], _words - _n)"
    runs = f"array_distinct(flatten(transform(filter(sequence(0, size(_live) - _need), i -> {dense}), i -> sequence({from_}, {to}))))"
    starts = F.explode(F.expr(f"if(_words < _n, array(0), {runs})")).alias("_start")
    windows = fits.select("_doc", "_t", "_n", "_m", "_h", starts)
    windows = windows.select("_doc", "_t", "_n", "_start", F.expr("slice(_h, _start + 1, _m)").alias("_wh")).withColumn("_fp", simhash("_wh"))
    windows = materialize(windows, "windows")

    # The multi-index of item fingerprints, and the candidates it yields.
    prints = materialize(items.withColumn("_ifp", simhash("_ih")).select("_item", "_n", "_ifp", "_ih"), "prints")
    entries = materialize(prints.select("_item", "_n", "_ifp", F.explode(F.array_distinct(_blocks("_ifp", ITEM_BITS))).alias("_e")), "entries")
    probes = windows.select("_doc", "_t", "_n", "_start", "_fp", F.explode(F.array_distinct(_blocks("_fp", WINDOW_BITS))).alias("_e"))
    distance = F.expr("bit_count(_fp[0] ^ _ifp[0]) + bit_count(_fp[1] ^ _ifp[1])")
    met = probes.join(_small(entries, entries.count(), BROADCAST_ENTRIES), ["_n", "_e"]).withColumn("_d", distance).where(F.col("_d") <= RADIUS)
    met = materialize(met.groupBy("_doc", "_t", "_n", "_start", "_item", "_ifp").agg(F.min("_d").alias("_d")), "met")

    # Exact similarity; shingles count as often as they occur.
    spelled = windows.select("_doc", "_t", "_n", "_start", _numbered("_wh").alias("_ws")).join(met, ["_doc", "_t", "_n", "_start"])
    of_item = prints.select(F.col("_item").alias("_i"), F.col("_n").alias("_in"), F.col("_ifp").alias("_p"), _numbered("_ih").alias("_is"))
    same = F.col("_item").eqNullSafe(F.col("_i")) & (F.col("_n") == F.col("_in")) & (F.col("_ifp") == F.col("_p"))
    both = spelled.join(of_item, same).withColumn("_c", F.size(F.array_intersect("_ws", "_is")))
    scored = both.withColumn("_sim", F.col("_c") / (F.size("_ws") + F.size("_is") - F.col("_c"))).where(F.col("_sim") >= SIMILARITY)
    best = scored.groupBy("_doc", "_item").agg(F.max(F.struct("_sim", (-F.col("_start")).alias("s"), (-F.col("_d")).alias("d"))).alias("_b"))
    return best.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_id), (-F.col("_b.s")).cast("long").alias("start"), (-F.col("_b.d")).cast("int").alias("distance"), F.col("_b._sim").alias("similarity"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; columns unchanged, rows with a null id stay."""
    found = contaminated(docs, items, id_col, text_col).select(F.col(id_col).alias("_held")).distinct()
    return docs.join(found, docs[id_col] == found["_held"], "left_anti")
