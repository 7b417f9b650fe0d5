"""Typed relations between known names, found by joining the word n-grams of sentences to the names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases of each relation.
RELATIONS = {
    "uses": ("uses", "using", "relies on"),
    "depends_on": ("depends on", "requires", "needs"),
    "part_of": ("part of", "belongs to", "inside"),
    "replaces": ("replaces", "supersedes", "instead of"),
}
#: Names that are sent to every task at most; more are joined by shuffle.
BROADCAST_NAMES = 100_000


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def phrases(rows: DataFrame, sizes: list[int], said: list[str]) -> DataFrame:
    """(id, sentence, start, stop, phrase): all runs of so many words of the sentences of ``rows`` (id, text, part) that hold one of ``said``."""
    runs_of_words = "|".join("[^a-z0-9]+".join(p.split(" ")) for p in said)
    ends = F.split(F.coalesce("text", F.lit("")), r"[.!?\n]")
    sentences = rows.select("id", "part", F.posexplode(ends).alias("_i", "_s")).where(F.lower("_s").rlike(f"(?<![a-z0-9])(?:{runs_of_words})(?![a-z0-9])"))
    sentences = sentences.select("id", F.struct("part", "_i").alias("sentence"), words(F.col("_s")).alias("_w"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + n).alias("stop"), F.array_join(F.slice("_w", i + 1, n), " ").alias("phrase")))

    return sentences.select("id", "sentence", F.inline(F.concat(*[runs(n) for n in sizes])))


def typed_relations(rows: DataFrame, names: DataFrame, relations: dict[str, tuple[str, ...]] = RELATIONS) -> DataFrame:
    """(id, subject, relation, object) of ``rows`` (id, text): the known names nearest before and after a relation's phrase in a sentence.

    Names (a column ``name``) and texts are compared by their words of a-z and 0-9 in lower case, so
    every name is one entry however it is written. A name within a longer one that is found
    doesn't count. All names are looked for at once, whatever their number: the word runs of
    a text that are as long as some name are joined to them. Null texts and names without a word
    give nothing; a statement that a text repeats is given once. Texts may come in parts, with a
    column ``part``. Names are looked for only in sentences that hold a relation's phrase.
    """
    rows = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
    # What a phrase isn't made of can't be met.
    said_by = sorted({p for ps in relations.values() for p in ps if p and not p.replace(" ", "a").strip("abcdefghijklmnopqrstuvwxyz0123456789")})
    if not said_by:
        return rows.select("id", F.lit("").alias("subject"), F.lit("").alias("relation"), F.lit("").alias("object")).where("false")
    known = names.select(F.array_join(words(F.col("name")), " ").alias("phrase")).where("phrase <> ''").distinct()
    verbs = rows.sparkSession.createDataFrame([(p, r) for r, ps in relations.items() for p in ps], "phrase string, relation string")
    n_words = F.size(F.split("phrase", " "))
    # A handful of lengths: the distinct numbers of words of a name.
    sizes = sorted({r.n for r in known.union(verbs.select("phrase")).select(n_words.alias("n")).distinct().collect()})
    found = phrases(rows, sizes, said_by)
    few = known.count() <= BROADCAST_NAMES
    named = found.join(F.broadcast(known) if few else known, "phrase").select("id", "sentence", "start", "stop", F.col("phrase").alias("name"), F.lit(None).cast("string").alias("relation"))
    by_start = Window.partitionBy("id", "sentence").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("stop").over(by_start)
    named = named.withColumn("_r", reach).where(F.col("_r").isNull() | (F.col("_r") < F.col("stop"))).drop("_r")
    said = found.join(F.broadcast(verbs), "phrase").select("id", "sentence", "start", "stop", F.lit(None).cast("string").alias("name"), "relation")

    is_verb = F.col("relation").isNotNull()
    both = named.unionByName(said).withColumns({"_v": is_verb, "_l": F.when(is_verb, F.col("start")).otherwise(F.col("stop")), "_r": F.when(is_verb, F.col("stop")).otherwise(F.col("start"))})
    within = Window.partitionBy("id", "sentence")
    # Where a name ends as a phrase begins, the name comes first; so in the other direction.
    before = F.last("name", ignorenulls=True).over(within.orderBy("_l", "_v", "start").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("name", ignorenulls=True).over(within.orderBy(F.desc("_r"), "_v", F.desc("start")).rowsBetween(Window.unboundedPreceding, 0))
    met = both.select("id", "relation", before.alias("subject"), after.alias("object")).where("relation is not null and subject <> object")
    return met.select("id", "subject", "relation", "object").distinct()
