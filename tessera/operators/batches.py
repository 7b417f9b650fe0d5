"""Model batches: a session's turns in batches that keep a user's turn and its answer together.

One fold over a session's turns in event time, used by the batch query and by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C

SCHEMA = "owner string, session_id string, started long, ready long, reason string, ids array<long>"


@dataclass(frozen=True)
class Limits:
    """A batch leaves at ``size`` turns, ``idle`` after its last turn or ``wait`` after its first (microseconds)."""

    size: int = C.BATCH_SIZE
    idle: int = C.BATCH_IDLE_S * 1_000_000
    wait: int = C.BATCH_MAX_S * 1_000_000


@dataclass
class Open:
    """A session's open batch: ids, time of the first and the last turn, and the user turn that waits for its answer."""

    ids: list[int] = field(default_factory=list)
    first: int = 0
    last: int = 0
    unanswered: int | None = None

    def due(self, limits: Limits) -> int:
        """When the batch leaves without another turn."""
        return min(self.last + limits.idle, self.first + limits.wait)

    def close(self, ready: int, reason: str) -> tuple[int, int, str, list[int]]:
        out = (self.first, ready, reason, self.ids)
        self.ids, self.unanswered = [], None
        return out

    def expire(self, now: int, limits: Limits, strict: bool = True) -> list[tuple]:
        """Close what was due before ``now`` (or at it, if not ``strict``)."""
        due = self.due(limits)
        if not self.ids or due > now or strict and due == now:
            return []
        return [self.close(due, "idle" if due == self.last + limits.idle else "wait")]

    def add(self, at: int, turn: int, role: str, pair: int | None, closes: bool, limits: Limits) -> list[tuple]:
        """The batches that leave when a turn comes, turns coming in the order of (at, turn).

        An answer (a turn of another role than user) joins the batch of its user turn
        ``pair``, however large; if that has left, both make a batch of their own, and an
        answer without a pair is a batch alone: these never take another turn. A batch of full
        size stays until its last user turn is answered, another comes, or it is due.
        ``closes``: the conversation ends with this turn.
        """
        out = self.expire(at, limits)
        if role == "user":
            if len(self.ids) >= limits.size:
                out.append(self.close(at, "size"))
            if turn not in self.ids:
                self._append(at, turn)
                self.unanswered = turn
        elif pair is None:
            out.append((at, at + limits.idle, "alone", [turn]))
        elif pair in self.ids:
            if turn not in self.ids:
                self._append(at, turn)
            self.unanswered = None if self.unanswered == pair else self.unanswered
        else:
            out.append((at, at + limits.idle, "pair", [pair, turn]))
        if self.ids and closes:
            out.append(self.close(at, "flush"))
        elif len(self.ids) >= limits.size and self.unanswered is None:
            out.append(self.close(at, "size"))
        return out

    def _append(self, at: int, turn: int) -> None:
        if not self.ids:
            self.first = at
        self.ids.append(turn)
        self.last = at


def with_pairs(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pair``: the user turn that an answer follows in its session, unless another answer did before."""
    order = Window.partitionBy("owner", "session_id").orderBy("ts", "id")
    before = F.lag(F.struct("id", "role")).over(order)
    return turns.withColumn("pair", F.when((F.col("role") != "user") & (before["role"] == "user"), before["id"]))


def paired_batches(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(owner, session_id, started, ready, reason, ids) of turns (owner, session_id, id, role, ts, pair, closes).

    ``started`` and ``ready`` are microseconds. Sessions are dealt by key and sorted; a task
    holds one open batch. Null owners and sessions are keys like any other; turns without a
    time or id are no turns; a repeated turn counts once in a batch; other columns aren't read.
    """

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch = None, Open()
        for pdf in parts:
            out: list[tuple] = []
            for owner, session, at, turn, role, pair, closes in zip(*(pdf[c] for c in ("owner", "session_id", "at", "id", "role", "pair", "closes")), strict=True):
                if (owner, session) != key:
                    out += [(*(key or ()), *b) for b in batch.expire(1 << 62, limits)]
                    key, batch = (owner, session), Open()
                out += [(owner, session, *b) for b in batch.add(at, turn, role, None if pd.isna(pair) else int(pair), bool(closes), limits)]
            yield _frame(out)
        yield _frame([(*(key or ()), *b) for b in batch.expire(1 << 62, limits)])

    slim = turns.where("ts is not null and id is not null").select("owner", "session_id", F.unix_micros("ts").alias("at"), "id", F.coalesce("role", F.lit("")).alias("role"), "pair", F.coalesce("closes", F.lit(False)).alias("closes"))
    dealt = slim.repartition("owner", "session_id").sortWithinPartitions("owner", "session_id", "at", "id")
    return dealt.mapInPandas(cut, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["owner", "session_id", "started", "ready", "reason", "ids"])
