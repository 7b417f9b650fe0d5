"""Bi-temporal timelines rebuilt from evidence, one key at a time.

A key is (owner, subject, verb), with the object too if the verb isn't functional. The
fold over a key's events is sequential by nature, so it runs over sorted partitions in
Arrow batches; keys are independent, and late events only need their keys rebuilt.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C

TIMELINE = "owner string, subject_id long, verb string, row_no int, object_key string, polarity string, status string, valid_from timestamp, valid_to timestamp, n_evidence int, evidence string, span_id long, claim_id string, superseded_by string"


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "timestamp": pa.timestamp("us", tz="UTC")}


def is_functional(verb: Column, functional: tuple[str, ...] = C.FUNCTIONAL_VERBS) -> Column:
    return verb.isin(*functional)


def _dated(e: tuple) -> tuple:
    """An event whose time and span can be compared: those it lacks come before all others."""
    return e if e[5] is not None and e[6] is not None else (*e[:5], 0 if e[5] is None else e[5], -1 if e[6] is None else e[6])


def rebuild(events: list[tuple], functional: bool) -> list[dict]:
    """Rows of one key from (evidence_id, object, polarity, act, speaker, time, span).

    The result doesn't depend on the order of ``events``; each event lies in exactly one row.
    """
    events = sorted((_dated(e) for e in events), key=lambda e: (e[5], e[6], e[0] is not None, e[0] or 0))
    retracted_at: dict[tuple, tuple] = {}
    for _, obj, pol, act, speaker, at, span in events:
        if act == "retract" and speaker == "user":
            retracted_at[obj, pol] = max(retracted_at.get((obj, pol), (at, span)), (at, span))
    gone, users, others = [], [], []
    for e in events:
        _, obj, pol, act, speaker, at, span = e
        if act == "retract" or ((obj, pol) in retracted_at and (at, span) <= retracted_at[obj, pol]):
            gone.append(e)
        else:
            (users if speaker == "user" else others).append(e)

    def row(e: tuple, status: str, end=None) -> dict:
        return {"object_key": e[1], "polarity": e[2], "status": status, "valid_from": e[5], "valid_to": end, "events": [e]}

    intervals, points, current = [], [], None
    for e in users:
        if functional and e[2] == "negative":
            if current is not None and current["object_key"] == e[1]:
                current["valid_to"] = e[5]
                current["events"].append(e)
                current = None
            else:
                points.append(row(e, "grounded", e[5]))
            continue
        same = current is not None and (current["object_key"] == e[1] if functional else current["polarity"] == e[2])
        if same:
            current["events"].append(e)
            continue
        if current is not None:
            current["valid_to"] = e[5]
        current = row(e, "grounded")
        intervals.append(current)
    loose: dict[tuple, dict] = {}
    by_value: dict[tuple, list[dict]] = {}
    for r in intervals:
        by_value.setdefault((r["object_key"], r["polarity"]), []).append(r)
    begins = {v: [r["valid_from"] for r in rows] for v, rows in by_value.items()}
    for e in others:
        # Intervals of one value begin in order and don't overlap: only the last to begin can hold the event.
        value = by_value.get((e[1], e[2]), [])
        at = bisect_right(begins.get((e[1], e[2]), []), e[5]) - 1
        held = at >= 0 and (value[at]["valid_to"] is None or e[5] < value[at]["valid_to"])
        home = value[at] if held else value[-1] if value else None
        if home is not None:
            home["events"].append(e)
        elif (e[1], e[2]) in loose:
            loose[e[1], e[2]]["events"].append(e)
        else:
            loose[e[1], e[2]] = row(e, "unconfirmed")
    dropped: dict[tuple, dict] = {}
    for e in gone:
        r = dropped.setdefault((e[1], e[2]), row(e, "retracted", e[5]) | {"events": []})
        r["events"].append(e)
        r["valid_to"] = e[5]
    return [*intervals, *points, *(loose[k] for k in sorted(loose, key=_nulls_first)), *(dropped[k] for k in sorted(dropped, key=_nulls_first))]


def _nulls_first(value: tuple) -> tuple:
    return tuple((x is not None, x or "") for x in value)


def vote_ids(rows: list[dict], known: dict[int, int]) -> list[int | None]:
    """Each row takes the existing claim id most of its events had and no row took before; the smallest of equals."""
    taken: set[int] = set()
    out: list[int | None] = []
    for r in rows:
        votes = Counter(known[e[0]] for e in r["events"] if known.get(e[0]) is not None and known[e[0]] not in taken)
        best = min(votes, key=lambda i: (-votes[i], i)) if votes else None
        out.append(best)
        if best is not None:
            taken.add(best)
    return out


def claim_timeline(evidence: DataFrame, functional: tuple[str, ...] = C.FUNCTIONAL_VERBS) -> DataFrame:
    """The timeline of every key; ids of new claims follow from key and place.

    Null keys are keys like any other, spelled ``null`` in ids; a key without its object
    column and one with an empty object don't meet. Null objects and polarities are values.
    Evidence without an id, a time or a span comes first in its order.
    """
    kinds = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in TIMELINE.split(", "))])
    key = ["owner", "subject_id", "verb", "_object"]
    keyed = evidence.withColumn("_object", F.when(is_functional(F.col("verb"), functional), F.lit("")).otherwise(F.col("object_key")))
    dealt = keyed.select(*key, "evidence_id", "object_key", "polarity", "act", "speaker", F.unix_micros("event_time").alias("_at"), "span_id").repartition(*key).sortWithinPartitions(*key)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(held: tuple, events: list[tuple]) -> list[tuple]:
            rows = rebuild(events, held[2] in functional)
            ids = [f"{'/'.join('null' if x is None else str(x) for x in held)}/{k}" for k in range(len(rows))]
            chain = [k for k, r in enumerate(rows) if r["status"] == "grounded" and r["valid_from"] != r["valid_to"]]
            after = {ids[a]: ids[b] for a, b in zip(chain, chain[1:], strict=False)}
            return [(*held[:3], k, r["object_key"], r["polarity"], r["status"], r["valid_from"], r["valid_to"], len(r["events"]), ",".join(str(x) for x in sorted(e[0] for e in r["events"] if e[0] is not None)), max(e[6] for e in r["events"]), ids[k], after.get(ids[k])) for k, r in enumerate(rows)]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        held, events = None, []
        for batch in parts:
            rows = []
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x[:4] != held:
                    if held is not None:
                        rows += rows_of(held, events)
                    held, events = x[:4], []
                events.append(x[4:])
            if rows:
                yield batch_of(rows)
        if held is not None:
            yield batch_of(rows_of(held, events))

    return dealt.mapInArrow(each, TIMELINE)


def live_asserts(evidence: DataFrame) -> DataFrame:
    """Asserts that no user's retract at or after them cancels; one aggregation and one join."""
    key = ["owner", "subject_id", "verb", "object_key", "polarity"]
    last = evidence.where("act = 'retract' and speaker = 'user'").groupBy(*key).agg(F.max(F.struct("event_time", "span_id")).alias("_r"))
    joined = evidence.where("act = 'assert'").join(last, key, "left")
    return joined.where(F.col("_r").isNull() | (F.struct("event_time", "span_id") > F.col("_r"))).drop("_r")


def functional_intervals(evidence: DataFrame, functional: tuple[str, ...] = C.FUNCTIONAL_VERBS) -> DataFrame:
    """Intervals of functional keys from users' live positive asserts, in windows alone.

    Runs of one object collapse; an interval ends where the next one starts. Keys with
    negative asserts need the fold; these are the islands of those without.
    """
    live = live_asserts(evidence).where((F.col("speaker") == "user") & is_functional(F.col("verb"), functional))
    key = Window.partitionBy("owner", "subject_id", "verb")
    order = key.orderBy("event_time", "span_id", "evidence_id")
    pure = live.withColumn("_neg", F.max((F.col("polarity") == "negative").cast("int")).over(key)).where("_neg = 0")
    starts = pure.withColumn("_new", F.coalesce(F.col("object_key") != F.lag("object_key").over(order), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    runs = starts.groupBy("owner", "subject_id", "verb", "_run").agg(F.min("object_key").alias("object_key"), F.min("event_time").alias("valid_from"), F.count("*").alias("n_evidence"))
    return runs.select("owner", "subject_id", "verb", F.col("_run").cast("int").alias("run"), "object_key", "valid_from", F.lead("valid_from").over(key.orderBy("_run")).alias("valid_to"), "n_evidence")
