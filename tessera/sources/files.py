"""File sources and sinks: trees, state, JSON lines, keyed tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a walk passes over, and languages by suffix.
IGNORED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", "site-packages")
LANGUAGES = {"py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "md": "Documentation", "sql": "SQL", "json": "JSON", "yaml": "YAML", "yml": "YAML", "sh": "Shell", "rs": "Rust", "go": "Go"}
MAX_FILE_BYTES = 2_000_000


def file_tree(spark: SparkSession, path: str) -> DataFrame:
    """(rel, lang, size, content, hash) of text files under ``path``; any store Spark reads.

    Hidden and ignored folders, files over the limit, unknown suffixes and binary files are
    passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= MAX_FILE_BYTES)
    top = path.rstrip("/") + "/"
    rel = files.withColumn("rel", F.expr("substring(path, locate(top, path) + length(top))".replace("top", f"'{top}'")))
    parts = F.split("rel", "/")
    seen = rel.where(~F.exists(parts, lambda p: p.startswith(".") | p.isin(*IGNORED_DIRS)))
    suffix = F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1))
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]
    text = seen.select("rel", lang.alias("lang"), F.col("length").alias("size"), F.try_validate_utf8(F.decode("content", "UTF-8")).alias("content"), F.sha2("content", 256).alias("hash"))
    return text.where("lang is not null and instr(content, '\\u0000') = 0")


def diff_state(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(rel, state, drift) from two tables (rel, hash): changed, skipped or deleted."""
    j = current.withColumnRenamed("hash", "c").join(previous.withColumnRenamed("hash", "p"), "rel", "full_outer")
    state = F.when(F.col("c").isNull(), "deleted").when(F.col("p").isNull() | (F.col("c") != F.col("p")), "changed").otherwise("skipped")
    return j.select("rel", state.alias("state"), F.coalesce(F.col("c") != F.col("p"), F.lit(False)).alias("drift"))


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """(rel, hash) of a saved state; nothing if it is missing or corrupt."""
    try:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
        return raw.select(F.explode("m").alias("rel", "hash"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "rel string, hash string")


def save_state(state: DataFrame, path: str) -> None:
    """Save (rel, hash) as JSON lines sorted by rel."""
    state.orderBy("rel").select(F.to_json(F.map_from_arrays(F.array("rel"), F.array("hash"))).alias("value")).write.mode("overwrite").text(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def last_lines(spark: SparkSession, path: str, schema: str, order: str, limit: int) -> DataFrame:
    """The last ``limit`` rows by ``order``; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(order)).limit(limit)


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case, kind) from a JSON file that is a list of cases or {cases, eval_kind}."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<string>")
    held = F.from_json("value", "struct<cases:array<string>,eval_kind:string>")
    return raw.select(F.coalesce(held["eval_kind"], F.lit("list")).alias("kind"), F.explode(F.coalesce(held["cases"], listed)).alias("case"))


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed insert-or-ignore: ``target`` with the rows whose key it lacks, one per key."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def replace_containing(rows: DataFrame, owner: str, target: str, old: str, new: str) -> DataFrame:
    """Entries of an owner and target whose content holds ``old`` (literally) get content ``new``."""
    hit = (F.col("owner") == owner) & (F.col("target") == target) & F.contains(F.col("content"), F.lit(old))
    return rows.withColumn("content", F.when(hit, F.lit(new)).otherwise(F.col("content")))


def remove_containing(rows: DataFrame, owner: str, target: str, old: str) -> DataFrame:
    hit = (F.col("owner") == owner) & (F.col("target") == target) & F.contains(F.col("content"), F.lit(old))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def synthetic_corpus(spark: SparkSession, size: int, seed: int = 0, dim: int = 8) -> DataFrame:
    """``size`` unique contents with unit vectors, the same for a seed on any cluster."""
    unit = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(2001)) - 1000) / 1000.0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = spark.range(size).withColumn("v", unit)
    return rows.select(F.concat(F.lit(f"k{seed}-"), "id").alias("key"), F.concat(F.lit("Entity "), "id", F.lit(" acts on entity "), F.col("id") * 7 + seed).alias("content"), F.transform("v", lambda x: x / F.nullif(norm, F.lit(0.0))).alias("embedding"))


def local_artifact(path: str, allowed: tuple[str, ...]) -> bool | None:
    """Whether a file is there: None (unchecked) outside the allowed folders, else true or false."""
    real = os.path.realpath(path)
    if not any(real == os.path.realpath(a) or real.startswith(os.path.realpath(a) + os.sep) for a in allowed):
        return None
    return os.path.isfile(real)


def as_json(value: object) -> str:
    return json.dumps(value, sort_keys=True)
