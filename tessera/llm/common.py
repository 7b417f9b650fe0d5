"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of a word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs on one machine."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(f"file://{path}")
        path = f"file://{path}"
    return path


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again.

    Columnar and compressed, so smaller than checkpoint(); it survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def powers(n: Column) -> Column:
    """1, 2, 4, ... up to the last below ``n`` or equal to it."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.lit(1), n))).cast("int")), lambda b: F.pow(F.lit(2), b).cast("int"))


def running_sums(values: Column) -> Column:
    """The running sums of an array of numbers: by doubling, so that no array is copied for each element."""

    def doubled(a: Column, d: Column) -> Column:
        return F.transform(a, lambda x, i: F.when(i >= d, x + F.get(a, i - d)).otherwise(x))

    return bind(values, lambda v: F.aggregate(powers(F.size(v)), v, doubled))
