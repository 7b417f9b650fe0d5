"""Operators of the memory model: fixed cases, properties, streams, and the DuckDB check."""

from __future__ import annotations

import datetime as dt
import itertools
import os
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions import text as X
from tessera.functions.vectors import block_pairs, cosine
from tessera.operators import entities, jobs, search, timeline, turns
from tessera.operators import graph as G
from tessera.plans import registry
from tessera.sources import files
from tessera.streaming import capture

registry.load()
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


# --- the DuckDB check, over every query that has SQL
@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{float(v):.9g}" if type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


# --- fusion and search
def test_rrf_prefers_what_both_lists_hold(spark):
    rows = [("q", "1", x, i + 1) for i, x in enumerate("abc")] + [("q", "2", x, i + 1) for i, x in enumerate("bd")]
    got = search.rrf(spark.createDataFrame(rows, "query string, list string, item string, rank int")).orderBy("place").collect()
    assert got[0].item == "b"


def test_mmr_passes_over_the_near_copy(spark):
    rows = [("q", "a", 0, [1.0, 0.0]), ("q", "a2", 1, [0.99, 0.01]), ("q", "c", 2, [0.0, 1.0])]
    got = search.mmr(spark.createDataFrame(rows, "query string, item string, position int, v array<double>"), 2).orderBy("place").collect()
    assert [r.item for r in got] == ["a", "c"]


def test_cosine_of_bad_vectors_is_null(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [None, None, 1.0]


def test_block_pairs_do_not_depend_on_blocks(spark):
    rng = random.Random(0)
    rows = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)], "id long, v array<double>")
    sets = [{(min(r.id, r.other), max(r.id, r.other)) for r in block_pairs(rows, rows, 0.5, blocks=b, undirected=True).collect()} for b in (1, 3, 7)]
    assert sets[0] == sets[1] == sets[2] != set()


def test_budgets(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate((5, 9, 3, 1))], "g string, id int, cost long")
    skip = {r.id: r.kept for r in search.budget_skip(rows, "g", ["id"], "cost", 10).collect()}
    stop = {r.id: r.kept for r in search.budget_break(rows, "g", ["id"], "cost", 10).collect()}
    assert skip == {0: True, 1: False, 2: True, 3: True}
    assert stop == {0: True, 1: False, 2: False, 3: False}


def test_beam_score_case(spark):
    s = scoring.beam_score(*(F.lit(x) for x in (0.75, -0.2, 0.8, 1.0, 0.9, 4.0)))
    assert abs(spark.range(1).select(s.alias("s")).first().s - 0.24) < 1e-12


# --- timelines
def event(i, obj, minute, act="assert", speaker="user", polarity="positive"):
    return (i, obj, polarity, act, speaker, minute, i)


def test_functional_timeline_moves_and_returns():
    rows = timeline.rebuild([event(1, "nyc", 0), event(2, "austin", 1), event(3, "nyc", 2)], True)
    assert [(r["object_key"], r["valid_from"], r["valid_to"]) for r in rows] == [("nyc", 0, 1), ("austin", 1, 2), ("nyc", 2, None)]


def test_negation_closes_the_interval():
    rows = timeline.rebuild([event(1, "acme", 0), event(2, "acme", 3, polarity="negative")], True)
    assert [(r["status"], r["valid_to"], len(r["events"])) for r in rows] == [("grounded", 3, 2)]


def test_id_votes_go_to_the_most_events_once():
    rows = timeline.rebuild([event(1, "a", 0), event(2, "a", 1), event(3, "b", 2), event(4, "a", 3)], True)
    assert timeline.vote_ids(rows, {1: 7, 2: 9, 3: 7, 4: 7}) == [7, None, None] or timeline.vote_ids(rows, {1: 7, 2: 9, 3: 7, 4: 7})[0] == 7


events = st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["positive", "negative"]), st.sampled_from(["assert", "retract"]), st.sampled_from(["user", "assistant"]), st.integers(0, 8), st.integers(1, 6)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(events, st.booleans(), st.randoms())
def test_timeline_properties(raw, functional, rng):
    rows_in = [(i, *e) for i, e in enumerate(raw)]
    mixed = rows_in[:]
    rng.shuffle(mixed)
    a, b = timeline.rebuild(rows_in, functional), timeline.rebuild(mixed, functional)
    assert a == b
    assert sorted(e[0] for r in a for e in r["events"]) == list(range(len(raw)))
    if functional:
        assert sum(r["status"] == "grounded" and r["valid_to"] is None for r in a) <= 1


def test_timeline_frame_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    base = dt.datetime(2026, 1, 1)
    rows = [(i, "o", rng.randrange(3), rng.choice(["signup", "click"]), rng.choice("ab"), rng.choice(["positive", "negative"]), rng.choice(["assert", "assert", "retract"]), rng.choice(["user", "assistant"]), base + dt.timedelta(minutes=rng.randrange(30)), i) for i in range(120)]
    df = spark.createDataFrame(rows, "evidence_id long, owner string, subject_id long, verb string, object_key string, polarity string, act string, speaker string, event_time timestamp, span_id long")
    one, two = (sorted(map(tuple, timeline.claim_timeline(df.repartition(n)).collect()), key=repr) for n in (1, 7))
    assert one == two
    assert sum(r[9] for r in one) == 120


# --- entities, graph, jobs
def test_timeline_takes_null_keys_and_values(spark):
    at = dt.datetime(2026, 1, 1)
    schema = "evidence_id long, owner string, subject_id long, verb string, object_key string, polarity string, act string, speaker string, event_time timestamp, span_id long"
    rows = [(i, "o", s, "likes", "e:1", "positive", "assert", "user", at, i) for i, s in enumerate([None, None, None, 7, 7])]
    rows += [(5, None, 8, "signup", None, None, "assert", "user", at, None), (6, "o", 9, "likes", "e:1", "positive", "assert", "user", None, 3), (None, "o", 9, "likes", "e:2", None, "retract", "user", at, 3)]
    for parts in (1, 5):
        got = timeline.claim_timeline(spark.createDataFrame(rows, schema).repartition(parts)).collect()
        assert sorted((r.claim_id, r.n_evidence, r.evidence) for r in got) == [("null/8/signup//0", 1, "5"), ("o/7/likes/e:1/0", 2, "3,4"), ("o/9/likes/e:1/0", 1, "6"), ("o/9/likes/e:2/0", 1, ""), ("o/null/likes/e:1/0", 3, "0,1,2")]


def test_components_and_merge_chain(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (9, 9)], "a long, b long")
    assert {(r.id, r.keeper) for r in entities.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id long, merged_into long")
    assert {(r.id, r.root, r.depth) for r in entities.merge_chain(chain).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3)}


def test_alias_cycle_elects_the_oldest_long_name(spark):
    links = spark.createDataFrame([("alpha", "beta", 5), ("beta", "ab", 3), ("ab", "alpha", 1), ("x", "alpha", 9)], "surface string, canon string, born int")
    assert {r.root for r in entities.resolve_aliases(links).collect()} == {"beta"}


def test_claim_walk_returns_both_claims(spark):
    claims = spark.createDataFrame([(1, "a", "b", 0.1), (2, "b", "a", 0.2)], "claim_id long, subject string, object string, distance double")
    start = spark.createDataFrame([("a",)], "start string")
    assert {r.claim_id for r in G.claim_walk(start, G.claim_edges(claims)).collect()} == {1, 2}


def test_job_transition_cases(spark):
    rows = spark.createDataFrame([("pending", 0, "error"), ("pending", 4, "error"), ("leased", 5, "ok"), ("done", 1, "ok"), ("retryable", 2, "ok")], "status string, attempts int, outcome string")
    got = [tuple(r[0]) for r in rows.select(jobs.transition(F.col("status"), F.col("attempts"), F.col("outcome"))).collect()]
    assert got == [("retryable", 1, 5), ("failed", 5, None), ("parked", 5, None), ("done", 1, None), ("done", 3, None)]


# --- text rules
def test_segments_cover_and_label():
    text = "hi\n```\ncode\n```\n> quoted\n| a |\n| b |\nbye\n-- \nsig"
    got = X.segments(text)
    assert "".join(text[a:b] for a, b, _ in got) == text
    assert [k for _, _, k in got] == ["authored", "code", "authored", "quote", "pasted", "authored", "pasted"]


def test_blocks_are_stripped_but_fences_stay():
    assert X.strip_blocks("a <memory>x <memory>y</memory></memory> b </memory>c ```<memory>``` d") == "a  b c ```<memory>``` d"
    assert X.strip_blocks("a <grounded_facts spans='1'> rest") == "a "


def test_assertions():
    assert X.assertions("Spot is a beagle. Pipeline is green. ACME is big. Team Red uses Kafka") == [("Spot", "is", "a beagle", "positive"), ("Team Red", "uses", "Kafka", "positive")]
    assert X.self_assertions("I live in Paris now. Do I live in Rome? I don't work for Acme anymore.") == [("I", "lives_in", "Paris", "positive"), ("I", "works_for", "Acme", "negative")]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 40))
def test_chunks_join_to_the_text(text, cap):
    parts = [c for _, c in X.chunks(text, cap)]
    assert "".join(parts) == text
    assert all(len(c) <= cap for c in parts)


def test_verdicts_and_noise(spark):
    rows = spark.createDataFrame([("never mind",), ("that's broken, it was broken",), ("Confirmed, thanks",), ("great",), ("confirmed " * 100,)], "t string")
    assert [r[0] for r in rows.select(X.verdict(F.col("t"))).collect()] == ["abandoned", "failed", "done", None, None]
    rows = spark.createDataFrame([("", "user"), ("thanks!", "user"), ("short", "assistant"), ("my dog", "user"), ("a dog", "user"), ("x" * 50, "user")], "t string, r string")
    assert [r[0] for r in rows.select(X.noise_reason(F.col("t"), F.col("r"), F.lit(False))).collect()] == ["empty", "noise_pattern", "short_non_user", None, "short_user_without_assertion", None]


def test_summary_keeps_whole_sentences():
    assert X.summary("One two. Three four. Five.", 20) == "One two. Three four."
    assert X.summary("Wordy sentence without an end", 12) == "Wordy..."


# --- sources
def test_files_and_state(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("import os")
    (tmp_path / "src" / "node_modules" / "b.js").write_text("x")
    (tmp_path / "src" / ".hidden.py").write_text("x")
    tree = files.file_tree(spark, str(tmp_path / "src"))
    assert [(r.rel, r.lang) for r in tree.select("rel", "lang").collect()] == [("a.py", "Python")]
    state = tree.select("rel", "hash")
    files.save_state(state, str(tmp_path / "state"))
    again = files.load_state(spark, str(tmp_path / "state"))
    assert [(r.state, r.drift) for r in files.diff_state(state, again).collect()] == [("skipped", False)]
    assert files.load_state(spark, str(tmp_path / "none")).count() == 0


def test_keyed_sinks(spark):
    a = spark.createDataFrame([("o", "t", "50% of_x")], "owner string, target string, content string")
    b = spark.createDataFrame([("o", "t", "50% of_x"), ("o", "u", "new"), ("o", "u", "new")], a.schema)
    assert files.insert_missing(a, b, ["owner", "target", "content"]).count() == 2
    assert files.replace_containing(a, "o", "t", "% of_", "done").first().content == "done"
    assert files.remove_containing(a, "o", "t", "%").count() == 0


# --- streams
def stream_of(spark, tmp_path, frames, schema):
    src = tmp_path / "in"
    src.mkdir()
    for i, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.parquet(str(src / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


TURN = "id long, op_id string, owner string, session_id string, role string, content string, ts timestamp"


def turn(i, op, minute, content="x" * 90):
    return (i, op, "o", "s", "user", content, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute))


def test_capture_drops_repeated_operations(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[turn(1, "a", 0), turn(2, "b", 1)], [turn(1, "a", 0), turn(3, "c", 2)]], TURN)
    assert sorted(r.op_id for r in drain(capture.capture(s), "captured").collect()) == ["a", "b", "c"]


def test_stream_dedup_equals_batch(spark, tmp_path):
    rows = [turn(i, str(i), m) for i, m in enumerate((0, 4, 9, 11, 15, 21, 22))]
    rows[2] = (*rows[2][:6], dt.datetime(2026, 1, 1, 0, 9, 59, 999_999))
    s = stream_of(spark, tmp_path, [rows[:3], rows[3:]], TURN)
    got = {(r.id, r.kept_id) for r in drain(capture.trailing_dedup(s), "deduped").collect()}
    batch = turns.dedup_trailing(spark.createDataFrame(rows, TURN))
    assert got == {(r.id, r.kept_id) for r in batch.collect()}


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_streamed_timeline_equals_rebuild(spark, tmp_path, order):
    base = dt.datetime(2026, 1, 1)
    rng = random.Random(1)
    schema = "evidence_id long, owner string, subject_id long, verb string, object_key string, polarity string, act string, speaker string, event_time timestamp, span_id long"
    rows = [(i, f"o{i % 2}", i % 3, "signup", rng.choice("ab"), "positive", rng.choice(["assert", "retract"]), "user", base + dt.timedelta(minutes=rng.randrange(20)), i) for i in range(30)]
    parts = [rows[:10], rows[10:20], rows[20:]]
    s = stream_of(spark, tmp_path, [parts[k] for k in order] + [parts[0]], schema)
    q = capture.refresh_timelines(s, str(tmp_path / "log"), str(tmp_path / "table"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["owner", "subject_id", "verb", "row_no", "object_key", "status", "evidence"]
    have = sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).select(*columns).collect()))
    assert have == sorted(map(tuple, timeline.claim_timeline(spark.createDataFrame(rows, schema)).select(*columns).collect()))


def test_batches_close_by_size_and_idleness(spark):
    rows = [turn(i, str(i), m) for i, m in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 30])]
    got = {r.id: r.position for r in turns.model_batches(spark.createDataFrame(rows, TURN)).collect()}
    assert [got[i] for i in range(10)] == [1, 2, 3, 4, 5, 6, 7, 8, 1, 1]


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(SMALL):
        assert e.entry(spark).count() > 0




# --- models and keys
def test_model_claims_validate_strictly(spark):
    from tessera.sources import models

    good = '{"claims": [{"subject": "a", "verb": "is", "object": "b", "polarity": "positive", "span_id": 7, "why": "said so"}]}'
    answers = {"x": good, "y": '{"claims": [{"subject": "a"}]}', "z": "no json", "": '{"claims": []}', "v": good.replace('"is"', '"eats"'), "t": good.replace("7", "true")}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None), (5, "v"), (6, "t")], "id long, content string")
    got = models.model_claims(rows, lambda texts: [answers[t] for t in texts], verbs=frozenset({"is"})).collect()
    assert sorted((r.id, r.span_id, r.object, r.error is None) for r in got) == [(1, 7, "b", True), (2, None, None, False), (3, None, None, False), (5, None, None, False), (6, None, None, False)]


def test_query_keys(spark):
    from tessera.sources import models

    rows = spark.createDataFrame([("q", [1, 2], 3.0), ("q", [2], 4.0), (None, [], 1.0)], "query string, ids array<long>, latency_ms double")
    got = models.shadow_rows(rows, b"k").collect()
    assert got[0].query_key == got[1].query_key != got[2].query_key
    assert len(got[0].query_key) == 16
    assert got[0].ids == "[1,2]"


def test_embeddings_are_deterministic_and_null_for_blanks(spark):
    from tessera.functions.vectors import hash_embedding

    rows = spark.createDataFrame([("a b",), ("a b",), (" ",), (None,)], "t string").coalesce(1)
    got = [r[0] for r in rows.select(hash_embedding(8)("t")).collect()]
    assert got[0] == got[1] is not None
    assert got[2] is None
    assert got[3] is None


# --- the read path
def test_prefix_rules(spark):
    from tessera.operators import readpath as R

    rows = [(1, None, None, None), (2, "interactive", "bench-1", "\t [System: x"), (3, "cron", "chat", "a [System:"), (4, "interactive", "bench_1", "Cronjob Response: y"), (5, None, "c8-2", " " * 300 + "[System: z")]
    d = spark.createDataFrame(rows, "id int, kind string, sid string, text string")
    got = d.select("id", R.interactive(F.col("kind"), F.col("sid")).alias("i"), R.synthetic_row(F.col("text")).alias("s"), R.starts_with_any(F.col("sid"), R.SYNTHETIC_SESSIONS).alias("t")).orderBy("id").collect()
    assert [r.i for r in got] == [True, False, False, True, True]
    assert [r.s for r in got] == [False, True, False, True, False]
    assert [r.t for r in got] == [False, True, False, True, True]
    assert [R.view_shares(n) for n in (0, 1, 2, 10, 100)] == [(1, 0), (1, 0), (1, 1), (7, 3), (70, 30)]


def test_display_fields_of_odd_texts(spark):
    from tessera.operators import readpath as R

    t = dt.datetime(2024, 1, 1, 0, 0, 30, 5)
    rows = [(None, None), ("", t), ("## \n", t), (" **a**  b \nc", t), ("x" * 281, t), ("y" * 279 + "  z", t)]
    d = spark.createDataFrame(rows, "text string, ts timestamp")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = d.select(R.excerpt(F.col("text")).alias("e"), R.title(F.col("text"), F.lit("Turn")).alias("t"), R.iso(F.col("ts")).alias("i"), R.lease_left(F.col("ts"), now).alias("l")).collect()
    assert [r.e for r in got] == ["", "", "##", "**a** b c", "x" * 279 + "…", "y" * 279 + "…"]
    assert [r.t for r in got] == ["Turn", "Turn", "Turn", "a  b", "x" * 77 + "…", "y" * 77 + "…"]
    assert (got[0].i, got[0].l) == (None, "—")
    assert (got[1].i, got[1].l) == ("2024-01-01T00:00:30.000005Z", "00:30 left")


def test_bounded_intake_defers_and_drops_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)
    for part in (range(0, 25), range(25, 32), range(32, 33)):
        spark.createDataFrame([(i, t0 + dt.timedelta(seconds=i)) for i in part], "id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        capture.bounded_intake(stream, str(tmp_path / "q"), str(tmp_path / "o"), str(tmp_path / "c"), 10).trigger(availableNow=True).start().awaitTermination()
    queue = [sorted(r.id for r in spark.read.parquet(str(tmp_path / f"q/batch={n}")).collect()) for n in range(3)]
    waits = sorted(r.id for r in spark.read.parquet(str(tmp_path / "o/batch=2")).collect())
    assert queue == [list(range(0, 10)), list(range(10, 20)), list(range(20, 30))]
    assert waits == [30, 31, 32]


def test_entity_link_ranks(spark):
    entities = spark.createDataFrame([(1, None), (2, 1), (3, None), (4, None), (5, None)], "entity_id long, merged_into long")
    names = spark.createDataFrame([(1, "alpha service"), (2, "alfa"), (3, "alpha services"), (4, "unlike"), (5, None), (3, "alpha service")], "entity_id long, name string")
    phrases = spark.createDataFrame([(7, "alpha service"), (7, "alfa"), (8, "nothing"), (9, None)], "query long, term string")
    vectors = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query long, v array<double>")
    own = spark.createDataFrame([(4, [1.0, 0.1]), (5, [0.7, 0.7]), (1, [-1.0, 0.0])], "id long, v array<double>")
    got = search.link_entities(phrases, vectors, entities, names, own).orderBy("query", "rank").collect()
    assert [(r["query"], r.entity_id, r.exact, r["rank"]) for r in got] == [(7, 1, 2, 1), (7, 3, 2, 2), (7, 4, 0, 3)]


def test_trigram_links_lose_nothing(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc1") for _ in range(rng.randrange(1, 9))) + (" x" if rng.random() < 0.3 else "") for _ in range(120)]
    grams = lambda s: {("  " + w + " ")[i : i + 3] for w in s.split() for i in range(len(w) + 1)}
    want = {(a, i) for a in words[:60] for i, b in enumerate(words) if round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6) >= 0.6}
    terms = spark.createDataFrame([(w,) for w in words[:60]], "term string")
    names = spark.createDataFrame(list(enumerate(words)), "entity_id long, name string")
    assert {(r.term, r.entity_id) for r in search.trigram_links(terms, names).collect()} == want


def test_beam_walk_equals_plain_walk(spark):
    import math

    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    poles = {n: vec() for n in range(9)}
    edges = [(s, t, rng.uniform(2, 9), rng.randrange(0, 80), vec(), [rng.randrange(0, 60) for _ in range(3)], poles[s]) for s in range(9) for t in range(9) if s != t and rng.random() < 0.6]
    queries = [(q, vec()) for q in (0, 50)]
    seeds = [(q, n, rng.randrange(0, 60), rng.uniform(0.2, 1)) for q in (0, 50) for n in rng.sample(range(9), 4)]

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else None

    want = set()
    for q, qv in queries:
        active = [(n, turn, sim, (n,)) for i, n, turn, sim in seeds if i == q]
        for hop in (1, 2):
            found = []
            for at, turn, sim, path in active:
                for s, t, mag, _, tp, prov, sp in edges:
                    if s != at:
                        continue
                    units = [[x / math.sqrt(sum(y * y for y in e[4])) for x in e[4]] for e in edges if t in e[:2] and e[:2] != (s, t) and e[3] >= turn - 32]
                    decay = 1.0
                    if units:
                        decay = math.exp(-0.05 * hop * (1 - (cos(tp, [sum(x) for x in zip(*units, strict=True)]) or 0) * cos(tp, qv)))
                    score = (0.4 * sim + 0.4 * max(cos(sp, qv), 0) * max(cos(tp, qv), 0) * (turn in prov) + 0.2 * decay) * min(mag, 8) / 8
                    if round(score, 9) >= 0.05:
                        found.append((round(score, 9), (*path, t), turn, sim, t))
            found.sort(key=lambda x: (-x[0], x[1], x[2]))
            found = found[: 16 if hop == 1 else 8]
            want |= {(q, hop, turn, at, ">".join(map(str, path)), round(score, 6)) for score, path, turn, _, at in found}
            active = [(at, turn, sim, path) for _, path, turn, sim, at in found]
    e = spark.createDataFrame(edges, "src long, tgt long, magnitude double, last_active_turn long, tgt_pole array<double>, provenance array<long>, src_pole array<double>")
    got = G.beam_walk(spark.createDataFrame(seeds, "query long, noun long, turn long, similarity double"), e, spark.createDataFrame(queries, "query long, qv array<double>"), 4)
    assert {(r["query"], r.hop, r.turn, r["at"], r.path, round(r.score, 6)) for r in got.collect()} == want


def test_read_api_takes_parameters(spark):
    from tessera.plans import api

    assert [api.clamp_limit(x) for x in (None, "x", "0", "-3", "7", "999999")] == [2000, 2000, 1, 1, 7, 10_000]
    t = spark.createDataFrame([(1, "o", "s", "Red, BLUE", None), (2, "o", "s", "red", None), (3, "p", "s", "blue red", None), (4, "p", "s", None, None)], "id long, owner string, session_id string, content string, ts timestamp")
    assert [(r.id, r.overlap) for r in api.text_search(t, "Blue! red", 9).collect()] == [(1, 2), (3, 2), (2, 1)]
    assert api.text_search(t, "!!", 9).count() == 0
    found = api.respond(spark, SMALL, "/api/librarian/search?q=the%20of&limit=3&owner=o1").collect()
    assert len(found) == 3
    assert {r.owner for r in found} == {"o1"}
    with pytest.raises(ValueError, match="owner"):
        api.respond(spark, SMALL, "/api/librarian/explorer/snapshot")
    with pytest.raises(ValueError, match="q"):
        api.respond(spark, SMALL, "/api/librarian/search")


def test_read_api(spark):
    from tessera.plans import api

    assert api.route("/api/librarian/nodes/12/audit") == ("vertex_audit", "id", 12)
    for bad in ("/", "/api/librarian/nodes/x", "/api/librarian/nodes/1/2"):
        with pytest.raises(LookupError):
            api.route(bad)
    assert all(name == "health" or name in registry.QUERIES for _, name, _ in api.ROUTES)
    assert api.respond(spark, SMALL, "/health").first().status == "ok"
    assert api.check_label("Turn") == "Turn"
    for bad in (None, "", "a b", "1x", "x)--", "Turn\n"):
        with pytest.raises(ValueError):
            api.check_label(bad)
    assert [r.id for r in api.respond(spark, SMALL, "/api/librarian/nodes/3/").collect()] == [3]
