"""Model batches: the fold's cases, and the stream against the batch query."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tessera.operators import batches as B
from tessera.streaming import batches as S

TURN = "owner string, session_id string, id long, role string, ts timestamp, pair long, closes boolean, started string"
START = dt.datetime(2026, 1, 1)


def turn(i, minute, role="user", pair=None, closes=False, session="s"):
    return ("o", session, i, role, START + dt.timedelta(minutes=minute), pair, closes, "clash")


def batches(spark, rows):
    got = B.paired_batches(spark.createDataFrame(rows, TURN)).collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    return sorted((r.session_id, (r.started // 1_000_000 - base) // 60, (r.ready // 1_000_000 - base) // 60, r.reason, r.ids) for r in got)


def test_batches_leave_by_size_idleness_waiting_and_flush(spark):
    full = [turn(i, i / 10) for i in range(9)]
    assert batches(spark, full) == [("s", 0, 0, "size", list(range(8))), ("s", 0, 10, "idle", [8])]
    assert batches(spark, [turn(1, 0), turn(2, 10), turn(3, 21)]) == [("s", 0, 20, "idle", [1, 2]), ("s", 21, 31, "idle", [3])]
    slow = [turn(i, 9 * i) for i in range(5)]
    assert batches(spark, slow) == [("s", 0, 30, "wait", [0, 1, 2, 3]), ("s", 36, 46, "idle", [4])]
    assert batches(spark, [turn(1, 0), turn(2, 1, closes=True), turn(3, 2)]) == [("s", 0, 1, "flush", [1, 2]), ("s", 2, 12, "idle", [3])]


def test_pairs_stay_together(spark):
    # The eighth turn waits for its answer, which comes as a ninth.
    rows = [turn(i, i / 10) for i in range(8)] + [turn(90, 1, "assistant", 7), turn(9, 2)]
    assert batches(spark, rows) == [("s", 0, 1, "size", [*range(8), 90]), ("s", 2, 12, "idle", [9])]
    # An answer after its batch has left takes its user turn along; one without a pair is alone.
    rows = [turn(1, 0), turn(2, 15, "assistant", 1), turn(3, 16, "assistant"), turn(4, 17)]
    assert batches(spark, rows) == [("s", 0, 10, "idle", [1]), ("s", 15, 25, "pair", [1, 2]), ("s", 16, 26, "alone", [3]), ("s", 17, 27, "idle", [4])]


def test_odd_turns(spark):
    rows = [(None, None, 1, None, START, None, None, "x"), (None, None, 2, "user", START, None, None, "x"), (None, None, 2, "user", START, None, None, "x"), ("o", "s", None, "user", START, None, None, "x"), ("o", "s", 5, "user", None, None, None, "x")]
    got = sorted((r.reason, r.ids) for r in B.paired_batches(spark.createDataFrame(rows, TURN)).collect())
    assert got == [("alone", [1]), ("idle", [2])]
    assert B.paired_batches(spark.createDataFrame([], TURN)).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_stream_equals_batches_on_shuffled_arrival_and_after_a_restart(spark, tmp_path, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(240):
        at += rng.choice([0.2, 1, 1, 2, 6, 14])
        session = rng.choice("ab")
        before = [r for r in rows if r[1] == session][-1:]
        answer = bool(before) and before[0][3] == "user" and rng.random() < 0.5
        orphan = not answer and rng.random() < 0.1
        rows.append(turn(i, at, "assistant" if answer or orphan else "user", before[0][2] if answer else None, rng.random() < 0.03, session))
    want = sorted(map(tuple, B.paired_batches(spark.createDataFrame(rows, TURN)).collect()))
    assert {r[4] for r in want} >= {"idle", "wait", "pair", "alone", "flush"}
    # A second query goes on from the first one's checkpoint. Arrival up to twenty minutes late, in files of thirty rows; the last file moves the watermark on.
    rows.sort(key=lambda r: r[4] + dt.timedelta(minutes=20 * rng.random()))
    frames = [rows[k : k + 30] for k in range(0, 240, 30)] + [[turn(9000, at + 500, session="end")], [turn(9001, at + 501, session="end")]]
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def run(parts):
        for k, f in parts:
            spark.createDataFrame(f, TURN).coalesce(1).write.parquet(str(source / f"f{k}"))
        s = spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        S.model_batches(s).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    parts = list(enumerate(frames))
    run(parts[:4])
    run(parts[4:])
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect() if r.session_id != "end")
    assert [r[:5] + (list(r[5]),) for r in got] == [r[:5] + (list(r[5]),) for r in want]


def test_turns_later_than_the_watermark_are_dropped_and_change_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    source = tmp_path / "in"
    source.mkdir()
    for k, f in enumerate([[turn(1, 0), turn(2, 1)], [turn(3, 120)], [turn(7, 121, session="end")], [turn(4, 2)], [turn(5, 400, session="end")], [turn(6, 401, session="end")]]):
        spark.createDataFrame(f, TURN).coalesce(1).write.parquet(str(source / f"f{k}"))
    s = spark.readStream.schema(TURN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    q = S.model_batches(s).writeStream.format("memory").queryName("late_batches").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(list(r.ids) for r in spark.table("late_batches").where("session_id = 's'").collect()) == [[1, 2], [3]]
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1
