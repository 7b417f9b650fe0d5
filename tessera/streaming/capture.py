"""Streams of turns and evidence: idempotent capture, trailing dedup, batches, timelines.

The engine's checkpoint takes the place of leases and fences: a micro-batch that fails is
run again, and each sink here gives the same table when a batch is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera import constants as C
from tessera.functions.scratch import cut_lineage
from tessera.operators.readpath import QUEUE_ROWS
from tessera.operators.timeline import claim_timeline


def capture(turns: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Turns with each op_id once; rows later than ``late`` no longer find the first."""
    return turns.withWatermark("ts", late).dropDuplicatesWithinWatermark(["op_id"])


def trailing_dedup(turns: DataFrame, minutes: int = 10, min_chars: int = 80, late: str = "30 minutes") -> DataFrame:
    """(id, kept_id): turns within ``minutes`` after a kept turn of the same owner, session, role and text.

    State is one kept time and id of each text, dropped when the watermark passes its window.
    Within a micro-batch rows are taken in event time; a row before the kept one opens no window.
    """
    span = minutes * 60_000_000

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        at, kept = state.get if state.exists else (None, None)
        out = []
        for ts, i, n in zip(rows["ts"], rows["id"], rows["n"], strict=True):
            us = ts.value // 1000
            if n < min_chars or at is None or not 0 <= us - at < span:
                at, kept = (us, int(i)) if n >= min_chars and (at is None or us >= at) else (at, kept)
                out.append((int(i), int(i)))
            else:
                out.append((int(i), kept))
        if at is not None:
            state.update((at, kept))
            state.setTimeoutTimestamp(max((at + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "kept_id"])

    keyed = turns.withWatermark("ts", late).select("owner", "session_id", "role", F.md5("content").alias("h"), "ts", "id", F.length("content").alias("n"))
    return keyed.groupBy("owner", "session_id", "role", "h").applyInPandasWithState(fold, "id long, kept_id long", "at long, kept long", "append", GroupStateTimeout.EventTimeTimeout)


def idle_batches(turns: DataFrame, gap: str = f"{C.BATCH_IDLE_S} seconds", late: str = "30 minutes") -> DataFrame:
    """A session's turns in batches that end when none comes for ``gap``."""
    window = F.session_window("ts", gap)
    return turns.withWatermark("ts", late).groupBy("owner", "session_id", window.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("started")).select("owner", "session_id", "started", F.col("w.end").alias("ready_at"), "n")


def refresh_timelines(evidence: DataFrame, log: str, table: str, checkpoint: str) -> DataStreamWriter:
    """Append evidence to ``log`` and rebuild the timelines of the owners it touches in ``table``.

    Late and out-of-order evidence needs no watermark: a key's timeline follows from all its
    evidence, whatever the order of arrival. A repeated batch finds its evidence in the log
    and changes nothing. Both tables are partitioned by owner, so a batch rewrites those alone.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["evidence_id"])
        if _exists(spark, log):
            fresh = fresh.join(spark.read.parquet(log).select("evidence_id"), "evidence_id", "left_anti")
        fresh.select(*batch.columns).write.mode("append").partitionBy("owner").parquet(log)
        owners = batch.select("owner").distinct()
        whole = spark.read.schema(batch.schema).parquet(log).join(owners, "owner", "left_semi")
        claim_timeline(whole).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner").parquet(table)

    return evidence.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def bounded_intake(turns: DataFrame, queue: str, outbox: str, checkpoint: str, capacity: int = QUEUE_ROWS) -> DataStreamWriter:
    """Write each micro-batch's first ``capacity`` turns, by (ts, id), to ``queue``; the rest waits in ``outbox``.

    What waits is offered again with the next batch, oldest first, so nothing is dropped. A
    batch writes its own folders of both tables and reads the outbox of the one before, so
    repeating it changes nothing. ``outbox/batch=N`` is what waits after batch N; earlier
    ones may be deleted. Bound what a batch reads with ``maxFilesPerTrigger`` or its like.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = f"{outbox}/batch={n - 1}"
        offered = batch.unionByName(spark.read.schema(batch.schema).parquet(before)) if n and _exists(spark, before) else batch
        offered = cut_lineage(offered)
        taken = cut_lineage(offered.orderBy("ts", "id").limit(capacity))
        taken.write.mode("overwrite").parquet(f"{queue}/batch={n}")
        offered.join(taken.select("id"), "id", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{outbox}/batch={n}")

    return turns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
