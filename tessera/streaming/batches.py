"""Model batches as a stream: turns wait in keyed state until they are final, timers close batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.batches import SCHEMA, Limits, Open, _frame

#: The state store that timers and list state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TURN = "at long, id long, role string, pair long, closes boolean"


class _Batches(StatefulProcessor):
    """State of a session: turns that aren't final, the open batch, batches of answers that wait for their time."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", _TURN)
        self.batch = handle.getValueState("batch", "ids array<long>, first long, last long, unanswered long")
        self.held = handle.getListState("held", "started long, ready long, reason string, ids array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(None if pd.isna(x) else x for x in r) for pdf in rows for r in pdf[["at", "id", "role", "pair", "closes"]].itertuples(index=False)]
        if fresh:
            self.early.appendList([(int(a), int(i), r, None if p is None else int(p), bool(c)) for a, i, r, p, c in fresh])
            self._wake(min(r[0] for r in fresh))
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        turns = sorted(tuple(r) for r in self.early.get()) if self.early.exists() else []
        batch = Open()
        if self.batch.exists():
            ids, first, last, unanswered = self.batch.get()
            batch = Open([int(i) for i in ids], int(first), int(last), None if pd.isna(unanswered) else int(unanswered))
        held = [(int(a), int(b), r, [int(i) for i in ids]) for a, b, r, ids in (tuple(r) for r in self.held.get())] if self.held.exists() else []

        out: list[tuple] = []
        final = [t for t in turns if t[0] <= now]
        for at, turn, role, pair, closes in final:
            out += batch.add(int(at), int(turn), role, None if pd.isna(pair) else int(pair), bool(closes), self.limits)
        out = held + out + batch.expire(now, self.limits, strict=False)
        later = [t for t in turns if t[0] > now]
        waiting = [b for b in out if b[1] > now]

        for state, rows in ((self.early, later), (self.held, waiting)):
            state.put(rows) if rows else state.clear()
        if batch.ids:
            self.batch.update((batch.ids, batch.first, batch.last, batch.unanswered))
            self._wake(batch.due(self.limits))
        else:
            self.batch.clear()
        for at in [t[0] for t in later[:1]] + [b[1] for b in waiting]:
            self._wake(at)
        yield _frame([(*key, *b) for b in out if b[1] <= now])

    def _wake(self, at: int) -> None:
        """A timer for the first millisecond that ends at ``at`` or after it."""
        self.handle.registerTimer(-(-int(at) // 1000))

    def close(self) -> None:
        pass


def model_batches(turns: DataFrame, limits: Limits = Limits(), late: str = "30 minutes") -> DataFrame:
    """(owner, session_id, started, ready, reason, ids) of turns (owner, session_id, id, role, ts, pair, closes).

    The batches of ``paired_batches``, each once, when the watermark passes its ``ready`` time:
    turns are taken in event time once no earlier one can come, so the order of arrival within
    ``late`` makes no difference; what comes later than that the engine drops and counts.
    Needs the state store STATE_STORE. After a restart timers and state are those of the checkpoint.
    """
    slim = turns.withWatermark("ts", late).where("ts is not null and id is not null")
    slim = slim.select("owner", "session_id", "ts", F.unix_micros("ts").alias("at"), "id", F.coalesce("role", F.lit("")).alias("role"), F.col("pair").cast("long").alias("pair"), F.coalesce("closes", F.lit(False)).alias("closes"))
    return slim.groupBy("owner", "session_id").transformWithStateInPandas(_Batches(limits), SCHEMA, "Append", "EventTime")
