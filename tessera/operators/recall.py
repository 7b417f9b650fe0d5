"""Golden recall: which texts hold a golden item, by an index of rare words and a check of the whole item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def words_of(c: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def holders(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(item, id) where the normalised ``text`` of ``texts`` (id, text) holds that of ``items`` (item, text) at word bounds.

    Counted over all texts, an item's rarest word (ties: the smaller one) is its key; a text meets
    an item only where it has that word, and is then searched for the whole item. An item with a
    word that no text has is held by none. Keys that many texts share are spread by the text's
    id, items being copied to each part. Items without a word are held by nothing; null texts
    hold nothing; rows that repeat count once.
    """
    held = texts.where("text is not null").select("id", X.normalize_surface(F.col("text")).alias("norm")).distinct()
    asked = items.select("item", X.normalize_surface(F.col("text")).alias("needle")).where("needle <> ''").distinct()
    wanted = asked.select("item", "needle", F.explode(F.array_distinct(words_of(F.col("needle")))).alias("word"))
    # Only words of items are counted.
    found = held.select("id", F.explode(F.array_distinct(words_of(F.col("norm")))).alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")
    often = found.groupBy("word").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("item", "needle").orderBy(F.coalesce("n", F.lit(0)), "word")
    keys = wanted.join(often, "word", "left").withColumn("_r", F.row_number().over(rarest)).where("_r = 1 and n is not null").drop("_r")
    parts = F.ceil(F.col("n") / PART).cast("long")
    spread = keys.select("item", "needle", "word", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    counts = keys.select("word", parts.alias("parts")).distinct()
    met = found.join(counts, "word").select("id", "word", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    pairs = met.join(spread, ["word", "part"]).select("item", "needle", "id")
    whole = pairs.join(held, "id")
    bounded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return whole.where(F.contains(bounded(F.col("norm")), bounded(F.col("needle")))).select("item", "id").distinct()


#: Texts of one word that meet its items in one part.
PART = 20_000


def answer_quality(shown: DataFrame, wanted: DataFrame, foreign: DataFrame) -> DataFrame:
    """One row over questions: recall, noise and leaked answers of what was shown.

    ``shown``: question, name: the names in the answer. ``wanted``: question, name. ``foreign``: names
    of other owners. Recall is the share of wanted names shown; noise the mean number of names
    shown that nobody asked for; a question leaks if it shows a foreign name. Questions without
    an answer count as empty.
    """
    questions = wanted.select("question").distinct()
    right = shown.distinct().join(wanted.distinct().withColumn("_w", F.lit(1)), ["question", "name"], "full")
    right = right.join(shown.distinct().withColumn("_s", F.lit(1)), ["question", "name"], "left")
    leaks = shown.join(foreign.distinct(), "name", "left_semi").select("question").distinct().withColumn("_l", F.lit(1))
    hit, extra = F.count_if(F.col("_w").isNotNull() & F.col("_s").isNotNull()), F.count_if(F.col("_w").isNull() & F.col("_s").isNotNull())
    each = right.groupBy("question").agg(hit.alias("hits"), F.count("_w").alias("wanted"), extra.alias("noise"), F.count("_s").alias("shown"))
    each = questions.join(each, "question", "left").join(leaks, "question", "left").na.fill(0)
    return each.agg(F.count("*").alias("questions"), (F.sum("hits") / F.sum("wanted")).alias("recall"), F.avg("noise").alias("noise"), F.count("_l").alias("_"), F.count_if(F.col("_l") == 1).alias("leaked"), F.count_if(F.col("shown") == 0).alias("empty")).drop("_")
