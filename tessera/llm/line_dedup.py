"""Operator 4, line dedup: exact repeats, then a segment-partition edit join.

A line is cut into ``threshold + 1`` segments. Two lines within ``threshold`` edits
share one segment, at a place and for a length that are known up to a small shift, so
every line enters its segments in an index and probes the index of each length it can
match with the substrings that can match there. Pairs that meet are verified by a banded
bit-parallel automaton.

A key under which more than ``cap`` lines meet isn't paired: the shared segment is cut
out and the rest is partitioned again, until groups are small or the rest is no longer
than the threshold; lines that differ in so little are no more than the alphabet allows.
So a phrase common to many lines never makes all pairs of them, and no near pair is lost.
All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

THRESHOLD = 1
MIN_CHARS = 20
CAP = 24
#: Keys or line numbers (some tens of bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000


def _shifts(threshold: int, segment: int, longer: int) -> range:
    """Where segment ``segment`` of an indexed line can lie in a line ``longer`` characters longer."""
    low = max(-segment, longer - (threshold - segment))
    high = min(segment, longer + (threshold - segment))
    return range(low, high + 1)


def _signatures(threshold: int, text: str, parent: Column, roles: list[tuple[bool, int]]) -> Column:
    """Array of (role, key, cut_from, cut_to) of a text.

    Role -1 indexes the text itself and also probes for equals in length; role d probes
    for indexed texts that are d characters shorter.
    """
    out = []
    for indexed, longer in roles:
        length = F.length(text) - longer
        for i in range(threshold + 1):
            start = F.floor(length * i / (threshold + 1)).cast("int")
            end = F.floor(length * (i + 1) / (threshold + 1)).cast("int")
            for shift in [0] if indexed else _shifts(threshold, i, longer):
                if not indexed and longer == 0 and shift == 0:
                    continue  # the index rows cover it
                piece = F.substring(F.col(text), start + 1 + shift, end - start)
                key = F.xxhash64(parent, F.lit(i), length, piece)
                sane = (length >= 0) & (start + shift >= 0) & (end + shift <= F.length(text))
                out.append(F.when(sane, F.struct(F.lit(-1 if indexed else longer).alias("role"), key.alias("key"), (start + shift).alias("cut_from"), (end + shift).alias("cut_to"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _roles(threshold: int) -> list[tuple[bool, int]]:
    return [(True, 0), *[(False, d) for d in range(threshold + 1)]]


def within(left: str, right: str, threshold: int) -> Column:
    """Whether two strings are within ``threshold`` edits: a banded bit-parallel automaton.

    Bit b of row e says that after j characters of ``right`` the first j + b - threshold
    characters of ``left`` are matched with e edits; the band has 2 * threshold + 1 bits.
    """
    k, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    match = " | ".join(f"if(coalesce(get(_p, j + {b - k - 1}) = get(_t, j - 1), false), {1 << b}, 0)" for b in range(width))
    row = "(a.r0 & m)"
    rows = [row]
    for e in range(1, k + 1):
        row = f"(((a.r{e} & m) | a.r{e - 1} | shiftright(a.r{e - 1}, 1) | shiftleft({row}, 1)) & {full})"
        rows.append(row)
    step = f"transform(array({match}), m -> named_struct({', '.join(f"'r{e}', {r}" for e, r in enumerate(rows))}))[0]"
    start = f"named_struct({', '.join(f"'r{e}', {sum(1 << (k + i) for i in range(e + 1)) & full}" for e in range(k + 1))})"
    last = f"shiftright(a.r{k}, size(_p) - size(_t) + {k}) & 1 = 1"
    run = f"aggregate(if(size(_t) = 0, cast(array() as array<int>), sequence(1, size(_t))), {start}, (a, j) -> {step}, a -> {last})"
    chars = lambda c: f"if({c} = '', cast(array() as array<string>), split({c}, ''))"
    return F.expr(f"abs(length({left}) - length({right})) <= {k} and exists(transform(array({chars(left)}), _p -> exists(array({chars(right)}), _t -> {run})), x -> x)")


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    parts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "text"))
    return parts.where(F.length(F.trim("text")) >= min_chars)


def _key_columns(threshold: int) -> tuple[list, list]:
    """(name, role, key) of the index and of the probes of a whole line in ``text``."""
    index, probe = [], []
    for indexed, longer in _roles(threshold):
        length = F.length("text") - longer
        for i in range(threshold + 1):
            start = F.floor(length * i / (threshold + 1)).cast("int")
            end = F.floor(length * (i + 1) / (threshold + 1)).cast("int")
            for shift in [0] if indexed else _shifts(threshold, i, longer):
                if not indexed and longer == 0 and shift == 0:
                    continue
                key = F.xxhash64(F.lit(0), F.lit(i), length, F.substring(F.col("text"), start + 1 + shift, end - start))
                sane = (length >= 0) & (start + shift >= 0) & (end + shift <= F.length("text"))
                if indexed:
                    index.append((f"k{i}", -1, key))
                else:
                    probe.append((f"p{len(probe)}", longer, F.when(sane, key)))
    return index, probe


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its rows are few; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_lines(lines: DataFrame, threshold: int = THRESHOLD, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Of ``lines`` (doc, line, text): the first of each distinct text, and of these the
    ones within ``threshold`` edits of an earlier one; both as (doc, line)."""
    # Plain columns of keys, so that they are made in generated code; the index keys name the line.
    index, probe = _key_columns(threshold)
    keyed = lines.select("doc", "line", *[c.alias(n) for n, _, c in index + probe])
    names = [n for n, _, _ in index]
    firsts = keyed.groupBy(*names).agg(F.min(F.struct("doc", "line")).alias("ord"), *[F.min(n).alias(n) for n, _, _ in probe])
    firsts = materialize(firsts.select("ord", *names, *[n for n, _, _ in probe]), "lines")
    rows = F.explode(F.array(*[F.struct(F.lit(role).cast("byte").alias("role"), F.col(n).alias("key")) for n, role, _ in index + probe])).alias("s")
    flat = firsts.select("ord", rows).select("ord", "s.role", "s.key").where("key is not null")
    busy = flat.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("role") == -1, 1)).alias("indexed")).where("n > 1 and indexed > 0")
    busy = materialize(busy.select("key", "n"), "busy")
    meet = materialize(flat.join(_small(busy), "key"), "meet")
    # Each level's pairs are written at once: one plan of all levels would grow with their number.
    parts = [materialize(_pairs(meet.where(F.col("n") <= cap)), "pairs")]

    # Keys that too many lines share: partition again what the shared segment leaves.
    hot = meet.where(F.col("n") > cap)
    if not hot.isEmpty():
        names = hot.select(F.col("ord.doc").alias("doc"), F.col("ord.line").alias("line")).distinct()
        texts = materialize(lines.join(_small(materialize(names, "names")), ["doc", "line"], "left_semi").dropDuplicates(["doc", "line"]).select(F.struct("doc", "line").alias("ord"), "text"), "texts")
        whole = _signatures(threshold, "text", F.lit(0), _roles(threshold))
        whole_cut = texts.select("ord", "text", F.explode(whole).alias("s"))
        hot_keys = hot.select("key").distinct()
        level = whole_cut.join(hot_keys, whole_cut.s.key == hot_keys.key, "left_semi")
        level = level.select("ord", F.col("s.key").alias("parent"), F.col("s.role").cast("int").alias("role"), _rest("text", "s").alias("rest"))
        while True:  # each level cuts a segment of a character or more from every rest
            level = materialize(level, "level")
            left = F.length("rest") - F.greatest(F.col("role"), F.lit(0))  # of the indexed lines
            ended = level.where(left <= threshold).select(F.col("parent").alias("key"), "ord", "role")
            open_ = level.where(left > threshold)
            own = _signatures(threshold, "rest", F.col("parent"), [(True, 0), (False, 0)])
            roles = own
            for d in range(1, threshold + 1):
                roles = F.when(F.col("role") == d, _signatures(threshold, "rest", F.col("parent"), [(False, d)])).otherwise(roles)
            if threshold > 1:
                roles = F.when(F.col("role") == 0, _signatures(threshold, "rest", F.col("parent"), [(False, 0)])).otherwise(roles)
            cut = open_.select("ord", "rest", F.explode(roles).alias("s")).select("ord", F.col("s.role").cast("byte").alias("role"), F.col("s.key").alias("key"), _rest("rest", "s").alias("rest"))
            count = cut.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("role") == -1, 1)).alias("indexed")).where("n > 1 and indexed > 0")
            known = materialize(cut.join(count.select("key", "n"), "key"), "known")
            few = known.where(F.col("n") <= cap).select("key", "ord", F.col("role").cast("int").alias("role"))
            parts.append(materialize(_pairs(few.union(ended)), "pairs"))
            level = known.where(F.col("n") > cap).select("ord", F.col("key").alias("parent"), F.col("role").cast("int").alias("role"), "rest")
            if level.isEmpty():
                break

    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.union(part)
    pairs = materialize(pairs.distinct(), "pairs") if len(parts) > 1 else pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("o")).distinct().select("o.doc", "o.line")
    spelled = materialize(lines.join(_small(materialize(ends, "ends")), ["doc", "line"], "left_semi").dropDuplicates(["doc", "line"]).select(F.struct("doc", "line").alias("o"), "text"), "spelled")
    both = pairs.join(spelled.select(F.col("o").alias("a"), F.col("text").alias("ta")), "a").join(spelled.select(F.col("o").alias("b"), F.col("text").alias("tb")), "b")
    near = both.where(within("ta", "tb", threshold)).select("b.doc", "b.line").distinct()
    return firsts.select("ord.doc", "ord.line"), near


def _rest(text: str, s: str) -> Column:
    return F.concat(F.substring(F.col(text), F.lit(1), F.col(f"{s}.cut_from")), F.substring(F.col(text), F.col(f"{s}.cut_to") + 1, F.length(text)))


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a before b) of an indexed line and another under the same key; groups are small."""
    left = rows.where("role = -1").select("key", F.col("ord").alias("x"))
    right = rows.select("key", F.col("ord").alias("y"), F.col("role").alias("r"))
    met = left.join(right, "key").where("(r = -1 and x < y) or (r <> -1 and x <> y)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _marked(docs: DataFrame, id_col: str, text_col: str, threshold: int, min_chars: int, cap: int) -> tuple[DataFrame, list[str], str]:
    """The documents with their columns renamed (so that no name can clash) and ``_m``: per
    line its text and a mark, 0 equal to an earlier line, 1 stays, 2 near one, 3 not judged."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    docs = docs.toDF(*names)
    lines = _lines(docs, key, text, min_chars)
    firsts, near = near_lines(lines, threshold, cap)
    flagged = near.withColumn("near", F.lit(1))
    stays = firsts.join(flagged, ["doc", "line"], "left").groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("line", F.col("near").isNotNull().alias("near")))).alias("_stay"))
    joined = docs.join(stays, docs[key] == F.col("doc"), "left")
    split = joined.withColumn("_l", F.split(F.col(text), "\n"))
    # One mark for each line up to the last first one: 0 not a first, 1 stays, 2 near another.
    empty = "cast(array() as array<struct<line:int,near:boolean>>)"
    marks = f"flatten(zip_with(coalesce(_stay, {empty}), concat(array(-1), transform(coalesce(_stay, {empty}), x -> x.line)), (x, p) -> if(x is null, cast(array() as array<int>), concat(array_repeat(0, x.line - p - 1), array(if(x.near, 2, 1))))))"
    marked = split.withColumn("_m", F.expr(f"zip_with(_l, {marks}, (l, m) -> named_struct('l', l, 'm', if(length(trim(l)) < {min_chars} or {key} is null, 3, coalesce(m, 0))))"))
    return marked, names, text


def _count(mark: int) -> Column:
    return F.coalesce(F.expr(f"size(filter(_m, x -> x.m = {mark}))"), F.lit(0)).cast("long")


_KEPT = "array_join(transform(filter(_m, x -> x.m in (1, 3)), x -> x.l), '\n')"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, cap: int = CAP) -> DataFrame:
    """The documents with ``text_col`` freed of repeated lines, and n_lines, n_exact, n_near.

    Lines part at \\n. A line of ``min_chars`` characters or more, blanks at its ends not
    counted, goes if an equal line stands before it (n_exact), or one within ``threshold``
    edits (n_near); before means a smaller (id, line number). Shorter lines stay. The
    remaining lines are joined by \\n. A null text stays null, with no lines; rows with a
    null id stay whole. Rows that repeat an id count as one document. Other columns stay,
    but for those named like the three counts, which give way to them.
    """
    marked, names, text = _marked(docs, id_col, text_col, threshold, min_chars, cap)
    counts = {"n_lines": F.coalesce(F.size("_l"), F.lit(0)).cast("long"), "n_exact": _count(0), "n_near": _count(2)}
    kept = [(F.expr(_KEPT) if n == text else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in counts]
    return marked.select(*kept, *[v.alias(k) for k, v in counts.items()])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stage form: texts without repeated lines; documents of which nothing is left go.

    The columns are those of ``docs``, whatever their names; ``n_chars`` is counted anew.
    """
    marked, names, text = _marked(docs, id_col, text_col, THRESHOLD, MIN_CHARS, CAP)
    done = marked.withColumn("_kept", F.expr(_KEPT))
    gone = (_count(0) + _count(2) > 0) & (F.trim("_kept") == "")
    out = done.where(~F.coalesce(gone, F.lit(False)))

    def column(name: str, of: str) -> Column:
        if name == text:
            return F.col("_kept").alias(of)
        if of == "n_chars":
            return F.length("_kept").cast(docs.schema["n_chars"].dataType).alias(of)
        return F.col(name).alias(of)

    return out.select(*[column(n, c) for n, c in zip(names, docs.columns, strict=True)])
