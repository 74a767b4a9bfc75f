"""Refused requests, running aggregates, joins of spans, rates, the stored vault and streams with state that ends, by hand and against plain versions."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from maskwright.functions.registry import extended
from maskwright.operators import alerts, counters, intervals, runtime, tokens, vault
from maskwright.operators.running import running
from maskwright.operators.store import Conflict, VaultStore
from maskwright.sources import shared
from maskwright.streaming.expiry import expiring_process
from maskwright.streaming.expiry import token_slots as slots_of
from maskwright.streaming.process import process_stream
from maskwright.streaming.session import ROCKSDB, in_order, run, settings, stream_of
from maskwright.streaming.sliding import counted, dropped, sliding_ratios

KEY = bytes(range(32))
NOW = "TIMESTAMP '2024-01-05 00:00:00'"


def at(rows, column="at"):
    return rows.withColumn(column, F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {column})"))


# --- requests that can't be served


def test_issue_names_what_is_wrong_and_serves_the_rest(spark):
    rows = spark.createDataFrame([(1, "a", "PHONE", "x", 0.0), (2, "a", "PHONE", None, 1.0), (3, "a", "PHONE", "x", None), (4, "a", "PHONE", "x", 5.0), (5, None, "PHONE", "x", 0.0), (6, "", "PHONE", "x", 0.0), (7, "a", None, "x", 0.0), (8, "a", "BADGE", "x", 0.0), (9, "a", "NOPE", "x", 0.0), (10, "a", "PHONE", "", 2.0), (11, "a", "PHONE", "x", 50.0)], "id int, scope string, type string, value string, at double")
    issued, slots = tokens.issue(at(rows), KEY, 20, types=extended("BADGE"))
    got = {r.id: (r.error, r.token) for r in issued.collect()}
    assert {i: e for i, (e, _) in got.items()} == {1: None, 2: "empty_value", 3: "no_time", 4: None, 5: "empty_scope", 6: "empty_scope", 7: "unknown_type", 8: None, 9: "unknown_type", 10: "empty_value", 11: None}
    assert got[1][1] == got[4][1] != got[11][1] and all((t is None) == (e is not None) for e, t in got.values())
    assert slots.count() == 3


def test_save_survives_nulls(spark):
    rows = at(spark.createDataFrame([(1, "a", "t", "x", None), (2, "a", "t", "x", 1.0), (3, "a", "t", "y", 2.0), (4, None, "t", "x", 0.0), (5, "a", "", "x", 0.0), (6, "a", "t", None, 0.0), (7, "a", "t", "y", 99.0)], "id int, scope string, token string, original string, at double"))
    got = {r.id: (r.outcome, r.stored) for r in vault.save(rows, 20).collect()}
    assert got == {1: ("no_time", None), 2: ("stored", "x"), 3: ("conflict", "x"), 4: ("empty_scope", None), 5: ("empty_token", None), 6: ("empty_original", None), 7: ("replaced", "y")}


def test_runtime_keeps_rows_that_share_an_id_apart(spark):
    docs = spark.createDataFrame([(1, "s", "Ann"), (1, "s", "Bob"), (None, "s", "Cy"), (None, "s", "Cy"), (2, None, "Di")], "doc_id long, scope string, text string")
    protect = lambda d: d.withColumn("tokenized", F.concat(F.lit("<FULL_NAME_"), F.md5("text"), F.lit(">")))
    held = protect(docs).select("scope", F.col("tokenized").alias("token"), F.col("text").alias("original"))
    back = runtime.run(docs, protect, lambda d: d.withColumn("answer", F.concat(F.lit("Hi "), "tokenized")), lambda d: vault.detokenize(d, held, text="answer"))
    assert sorted((r.doc_id or 0, r.result, r.failed) for r in back.collect() if r.doc_id != 2) == [(0, "Hi Cy", None), (0, "Hi Cy", None), (1, "Hi Ann", None), (1, "Hi Bob", None)]
    assert back.count() == 5 and back.where("doc_id = 2").first().failed == "restore"


REPLACED = "doc_id long, scope string, tokenized string, error string, replacements array<struct<token: string, value: string>>"


def test_persist_does_not_lean_on_ids(spark):
    made = spark.createDataFrame([(None, "s", "<T1>", None, [("<T1>", "new")]), (None, "s", "<T2>", None, [("<T2>", "v2")]), (7, None, "<T3>", None, [("<T3>", "v3")]), (7, "s", "plain", None, []), (7, "s", None, None, None), (8, "s", "<T4>", None, [("<T4>", None)]), (9, "s", None, "invalid_span", None)], REPLACED)
    old = spark.createDataFrame([("s", "<T1>", "old")], "scope string, token string, original string")
    texts, new = tokens.persist(made, old)
    assert sorted(((r.doc_id, r.tokenized, r.error) for r in texts.collect()), key=str) == sorted([(None, None, "conflict"), (None, "<T2>", None), (7, None, "empty_scope"), (7, "plain", None), (7, None, None), (8, None, "empty_mapping"), (9, None, "invalid_span")], key=str)
    assert [tuple(r) for r in new.collect()] == [("s", "<T2>", "v2")]


def test_a_stray_year_does_not_stretch_the_grid(spark):
    rows = spark.sql("SELECT CAST(x AS TIMESTAMP) AS ts FROM VALUES ('2024-01-01 00:00:30'), ('2024-01-01 00:03:30'), ('9999-01-01'), ('1970-01-01 00:10:00'), (NULL) t(x)")
    first = 1704067200
    steps = alerts.grid(rows, {"n": F.lit(1)}, since=first, until=first + 86400)
    assert [(r.t - first, r.n) for r in steps.orderBy("t").collect()] == [(60, 1), (120, 0), (180, 0), (240, 1)]
    assert alerts.outside(rows, first, first + 86400).count() == 3
    wide = alerts.grid(rows.where("year(ts) < 3000"), {"n": F.lit(1)}, step=3600)
    assert wide.count() == (first - 0) // 3600 + 1 and wide.agg(F.sum("n")).first()[0] == 3


# --- running aggregates and spans


def test_running_aggregates_split_hot_keys(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), i, rnd.choice([None, *range(50)])) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v")), "l": ("last", F.col("v")), "b": ("before", F.col("v"))}
    with settings(spark, {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        found = running(frame, ["k"], [F.col("i")], values)
        dealt = frame.repartitionByRange("k", "i").withColumn("p", F.spark_partition_id())
        assert dealt.where("k = 'hot'").select("p").distinct().count() > 8  # tasks that share the hot key
    state, want = {}, {}
    for k, i, v in rows:
        s, m, n, last = state.get(k, (None, None, None, None))
        before = last
        if v is not None:
            s, m, n, last = (s or 0) + v, v if m is None else max(m, v), v if n is None else min(n, v), v
        state[k] = (s, m, n, last)
        want[i] = (k, s, m, n, last, before)
    assert {r.i: (r.k, r.s, r.m, r.n, r.l, r.b) for r in found.collect()} == want


def made_spans(rnd, n):
    out = [(rnd.choice(["x", "y", None]), a, a + rnd.choice([0, 1, 3, 10, 10, 400])) for a in (rnd.choice([rnd.randrange(500), 100]) for _ in range(n))]
    return [*out, ("x", None, 5), ("x", 5, None), ("x", 9, 2), ("x", 0, 5000)]


@pytest.mark.parametrize("seed", [3, 4])
def test_spans_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    left, right = made_spans(rnd, 120), made_spans(rnd, 100)
    frame = lambda rows: spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "k string, start long, end long, id int")
    a, b = frame(left), frame(right)
    good = lambda s: None not in s and s[1] < s[2]
    pairs = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if good(x) and good(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    got = [(r.l.id, r.r.id) for r in intervals.overlap_pairs(a, b, ["k"], 16, least=5).collect()]  # bins of more than five are split
    assert len(got) == len(set(got)) and set(got) == pairs
    tests = {"overlap": lambda x, y: x[1] < y[2] and y[1] < x[2], "inside": lambda x, y: y[1] <= x[1] and x[2] <= y[2], "covers": lambda x, y: x[1] <= y[1] and y[2] <= x[2], "equal": lambda x, y: x[1:] == y[1:]}
    for how, test in tests.items():
        want = {i: any(good(x) and good(y) and x[0] == y[0] and test(x, y) for y in right) for i, x in enumerate(left)}
        assert {r.id: r.matched for r in intervals.matches(a, b, ["k"], how).collect()} == want, how
        assert intervals.semi(a, b, ["k"], how).count() + intervals.anti(a, b, ["k"], how).count() == len(left)
    every = [(r.l.id if r.l else None, r.r.id if r.r else None) for r in intervals.full(a, b, ["k"], 16).collect()]
    assert set(every) == pairs | {(i, None) for i in range(len(left)) if i not in {p[0] for p in pairs}} | {(None, j) for j in range(len(right)) if j not in {p[1] for p in pairs}}
    assert intervals.overlap_pairs(a.limit(0), b, ["k"], 16).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_totals_of_overlaps_make_no_pairs(spark, seed):
    rnd = random.Random(seed)
    left, right = made_spans(rnd, 120), made_spans(rnd, 100)
    frame = lambda rows: spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "k string, start long, end long, id int")
    good = lambda s: None not in s and s[1] < s[2]
    want = {}
    for x in left:
        met = [(j, y) for j, y in enumerate(right) if good(x) and good(y) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
        new = (1, len(met), sum(min(x[2], y[2]) - max(x[1], y[1]) for _, y in met), sum(j for j, _ in met))
        want[x] = tuple(a + b for a, b in zip(want.get(x, (0, 0, 0, 0)), new, strict=True))
    got = intervals.overlap_totals(frame(left), frame(right), ["k"], ["id"])
    assert {(r.k, r.start, r.end): (r.spans, r.pairs, r.shared, r.id) for r in got.collect()} == want
    assert all(r.pairs == 0 for r in intervals.overlap_totals(frame(left), frame(right).limit(0), ["k"]).collect())


@pytest.mark.parametrize("name", ["interval_overlaps", "interval_full"])
def test_interval_queries_do_not_grow_with_pairs(spark, name, monkeypatch):
    from maskwright.plans import queries as engine

    monkeypatch.setattr(intervals, "overlap_pairs", lambda *_, **__: pytest.fail("pairs are made"))
    assert engine.CATALOG.queries[name](spark, "/root/testdata/sf0.001").count() > 0


# --- counters


def plain_rate(samples, t, seconds):
    inside = [x for x in samples if t - seconds < x[0] <= t]
    if len(inside) < 2:
        return None
    grown = inside[-1][1] - inside[0][1] + sum(a[1] for a, b in zip(inside, inside[1:]) if b[1] < a[1])
    sampled = inside[-1][0] - inside[0][0]
    mean = sampled / (len(inside) - 1)
    start, end = inside[0][0] - (t - seconds), t - inside[-1][0]
    start, end = (x if x < mean * 1.1 else mean / 2 for x in (start, end))
    if grown > 0 and inside[0][1] >= 0:
        start = min(start, sampled * inside[0][1] / grown)
    return grown * (sampled + start + end) / sampled / seconds


def test_rates_with_resets_and_gaps(spark):
    rnd = random.Random(9)
    rows, value = [], {"a": 0.0, "b": 0.0}
    for s in range(0, 7200, 15):
        for k in value:
            value[k] = 0.0 if rnd.random() < 0.03 else value[k] + rnd.randrange(4)
            if rnd.random() < 0.8 and not (k == "b" and 2000 < s < 4000):
                rows.append((k, (s + rnd.randrange(14)) * 1_000_000, value[k]))
    frame = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 5, None), rows[0]], "series string, t long, value double")
    got = {(r.series, r.t // 1_000_000, r.range): r.rate for r in counters.rates(frame, (0, 7200, 60), {"5m": 300, "1h": 3600}).collect()}
    want = {}
    for k in value:
        own = sorted((t / 1e6, v) for s, t, v in rows if s == k)
        for t in range(0, 7201, 60):
            for name, seconds in (("5m", 300), ("1h", 3600)):
                rate = plain_rate(own, t, seconds)
                if rate is not None:
                    want[k, t, name] = rate
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def test_rising_looks_at_a_grid_between_samples(spark):
    rows = [("up", s * 1_000_000, s * 2.0) for s in range(0, 20_000, 100)] + [("dip", s * 1_000_000, 500.0 - abs(s - 9000)) for s in range(0, 20_000, 100)]
    found = counters.steadily_rising(spark.createDataFrame(rows, "series string, t long, value double"), (7200, 19_800, 450))
    got = {(r.series, r.t // 1_000_000): (r.least, r.rising) for r in found.collect()}
    assert all(got["up", t] == (pytest.approx(2.0), True) for t in range(7200, 19_801, 450))
    assert got["dip", 9000][1] and not got["dip", 10_800][1] and got["dip", 19_800] == (pytest.approx(-1.0), False)


# --- the stored vault


@pytest.fixture
def store(spark):
    return VaultStore(spark, shared.folder(spark, "vault"), KEY, 86400, parts=4)


def saves(spark, *rows):
    return spark.createDataFrame(rows, "scope string, token string, original string, at string").withColumn("at", F.col("at").cast("timestamp"))


def read(store, version=None, when="2024-01-01 12:00:00"):
    asks = store.spark.createDataFrame([(s, t) for s in "ab" for t in "tuv"], "scope string, token string").withColumn("at", F.lit(when).cast("timestamp"))
    return {(r.scope, r.token): r.original for r in store.resolve(asks, version).collect() if r.error is None}


def test_store_saves_revokes_and_sweeps(spark, store):
    one = saves(spark, ("a", "t", "x", "2024-01-01 00:00:00"), ("a", "t", "y", "2024-01-01 01:00:00"), ("b", "t", "z", "2024-01-01 02:00:00"), ("a", None, "z", "2024-01-01 02:00:00"), ("", "t", "z", "2024-01-01 02:00:00"))
    assert sorted(r.outcome for r in store.save(one).collect()) == ["conflict", "empty_scope", "empty_token", "stored", "stored"]
    assert read(store) == {("a", "t"): "x", ("b", "t"): "z"} and store.versions() == [1]
    two = saves(spark, ("a", "t", "x", "2024-01-01 03:00:00"), ("a", "t", "y", "2024-01-02 00:00:00"), ("a", "u", "w", "2024-01-01 03:00:00"))
    assert sorted(r.outcome for r in store.save(two).collect()) == ["replaced", "same", "stored"]
    assert read(store, 1) == {("a", "t"): "x", ("b", "t"): "z"}  # an old version stays as it was
    assert read(store, when="2024-01-02 12:00:00") == {("a", "t"): "y"}
    store.sweep(F.expr("TIMESTAMP '2024-01-02 02:30:00'"))
    assert store.records().count() == 2
    before = store.revoke(spark.createDataFrame([("a",)], "scope string"))
    assert store.records().count() == 0 and store.revoke(spark.createDataFrame([("a",), (None,)], "scope string")) == before
    store.vacuum()
    assert store.versions() == [before] and store.records().count() == 0


def test_only_parts_with_changes_are_rewritten(spark, store):
    store.save(saves(spark, *[("a", f"t{i}", "x", "2024-01-01 00:00:00") for i in range(40)]))
    old = store._manifest(1)
    store.save(saves(spark, ("a", "t0", "x", "2024-01-01 01:00:00")))
    assert sum(old[k] != v for k, v in store._manifest(2).items()) == 1 and store.records().count() == 40


def test_a_writer_that_fails_half_way_leaves_the_old_version(spark, store):
    store.save(saves(spark, ("a", "t", "x", "2024-01-01 00:00:00")))
    broken = saves(spark, ("a", "u", "y", "2024-01-01 00:00:00")).withColumn("original", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.save(broken)
    made = spark.createDataFrame([(1, "a", "<T>", None, [("t", "x2")]), (2, "a", "<U>", None, [("v", "y")])], REPLACED)
    with pytest.raises(Exception, match="lost"):
        store.persist(made.withColumn("tokenized", F.raise_error(F.lit("lost")).cast("string")), F.expr(NOW))
    assert store.versions() == [1] and read(store) == {("a", "t"): "x"}


def test_of_two_writers_one_wins(spark, store, monkeypatch):
    other = VaultStore(spark, store.path, KEY, 86400, parts=4)
    write = store._write

    def late(base, *rest):
        other.save(saves(spark, ("b", "t", "z", "2024-01-01 00:00:00")))
        return write(base, *rest)

    monkeypatch.setattr(store, "_write", late)
    with pytest.raises(Conflict):
        store.save(saves(spark, ("a", "t", "x", "2024-01-01 00:00:00")))
    assert read(other) == {("b", "t"): "z"}
    monkeypatch.undo()
    store.save(saves(spark, ("a", "t", "x", "2024-01-01 00:00:00")))
    assert read(store) == {("a", "t"): "x", ("b", "t"): "z"}


def test_persist_gives_out_what_is_stored(spark, store):
    store.save(saves(spark, ("a", "t", "x", "2024-01-04 12:00:00"), ("a", "v", "old", "2024-01-01 00:00:00")))
    made = spark.createDataFrame([(1, "a", "1", None, [("t", "other"), ("u", "y")]), (2, "a", "2", None, [("v", "new")]), (3, "a", "3", None, [("w", "k")])], REPLACED)
    texts = store.persist(made, F.expr(NOW))
    assert sorted((r.doc_id, r.tokenized, r.error) for r in texts.collect()) == [(1, None, "conflict"), (2, "2", None), (3, "3", None)]
    assert read(store, when="2024-01-05 00:00:01") == {("a", "t"): "x", ("a", "v"): "new"}  # asked for t, u and v


def test_records_are_bound_to_their_life(spark, store):
    store.save(saves(spark, ("a", "t", "x", "2024-01-01 00:00:00")))
    longer = store.records().withColumn("expires_at", F.col("expires_at") + F.expr("INTERVAL 9 DAYS"))
    store._write(1, longer, store._touched(longer))
    asks = saves(spark, ("a", "t", "", "2024-01-01 00:00:00")).drop("original")
    assert store.resolve(asks).first().error == "corrupted"


# --- streams


def events(spark, rows):
    return at(spark.createDataFrame(rows, "part int, payload_id long, seq long, payload string, at double"))


def test_records_expire_between_batches(spark):
    rows = [(0, 1, 1, "x", 0), (0, 1, 2, "<X>", 10), (1, 1, 3, "y", 50), (1, 2, 4, "q", 50), (2, 1, 5, "y", 105), (2, 2, 6, "q", 120), (3, 9, 7, "z", 9000), (4, 9, 8, "z", 90_000)]
    stream = in_order(events(spark, [(*r[:4], float(r[4])) for r in rows]), F.col("part"), 5, files=1)
    found, query = run(expiring_process(stream, lambda x: f"<{x.upper()}>", 100, late="1 minute"), "records", ROCKSDB)
    assert {r.seq: (r.outcome, r.reply) for r in found.collect()} == {1: ("masked", "<X>"), 2: ("restored", "x"), 3: ("conflict", None), 4: ("masked", "<Q>"), 5: ("masked", "<Y>"), 6: ("stored", "<Q>"), 7: ("masked", "<Z>"), 8: ("masked", "<Z>")}
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 4  # one record and its timer are left


def test_slots_expire_one_by_one(spark):
    rows = at(spark.createDataFrame([(0, 1, "a", "T", "x", 0.0), (0, 2, "a", "T", "y", 30.0), (1, 3, "a", "T", "x", 99.0), (1, 4, "a", "T", "x", 100.0), (1, 5, "a", "T", "y", 129.0), (2, 6, "a", "T", "y", 131.0), (3, 7, "b", "T", "z", 99_999.0), (4, 8, "b", "T", "z", 199_999.0)], "part int, request_id long, scope string, type string, value string, at double"))
    found, query = run(slots_of(in_order(rows, F.col("part"), 5, files=1), 100, late="1 minute"), "slots", ROCKSDB)
    start = 1704067200
    assert {r.request_id: r.s - start for r in found.select("request_id", F.unix_seconds("slot_at").alias("s")).collect()} == {1: 0, 2: 30, 3: 0, 4: 100, 5: 30, 6: 131, 7: 99_999, 8: 199_999}
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 6


def test_a_scope_has_few_values_in_the_store(spark):
    """Each slot a value of its own is asked for one by one, which takes most of the time."""
    rows = at(spark.range(3000).selectExpr("CAST(id % 3 AS INT) AS part", "id AS request_id", "'s' AS scope", "'T' AS type", "CAST(id % 1000 AS STRING) AS value", "CAST(id % 3 AS DOUBLE) AS at"))
    found, query = run(slots_of(in_order(rows, F.col("part"), 3, files=1), 100), "slots", ROCKSDB)
    start = F.min("at").over(Window.partitionBy("value"))
    assert found.select("request_id", "slot_at").exceptAll(rows.select("request_id", start)).isEmpty() and found.count() == 3000
    assert query.lastProgress.stateOperators[0].numRowsTotal < 400


def test_a_part_of_ids_is_one_state(spark):
    rows = spark.range(6000).selectExpr("CAST(id DIV 3000 AS INT) AS part", "CASE WHEN id % 3000 > 0 THEN id % 3000 END AS payload_id", "id AS seq", "CASE WHEN id < 3000 THEN 'x' ELSE '<X>' END AS payload")
    found, query = run(process_stream(in_order(rows, F.col("part"), 2, files=1), lambda x: f"<{x.upper()}>", parts=50), "states")
    assert {(r.outcome, r.reply, r.n) for r in found.groupBy("outcome", "reply").agg(F.count("*").alias("n")).collect()} == {("masked", "<X>", 3000), ("restored", "x", 3000)}
    assert found.where("payload_id is null").count() == 2 and found.select("payload_id", "seq").exceptAll(rows.select("payload_id", "seq")).isEmpty()
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 50


def test_the_store_forgets_by_the_clock(spark):
    out = shared.folder(spark, "clock")
    source = f"{out}/in"
    schema = "payload_id long, seq long, payload string, at timestamp"

    def once(seq):
        spark.createDataFrame([(1, seq, "x")], "payload_id long, seq long, payload string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(source)
        rows = expiring_process(spark.readStream.schema(schema).parquet(source), lambda x: f"<{x}>", 6, clock="processing")
        with settings(spark, ROCKSDB):
            query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(processingTime="1 second").start()
        ends = time.time() + 40
        while time.time() < ends and not any(p.numInputRows for p in query.recentProgress):  # by the clock, a stream is never through
            time.sleep(0.2)
        query.stop()
        return {r.seq: r.outcome for r in spark.read.parquet(f"{out}/rows").collect()}[seq]

    assert once(1) == "masked"
    time.sleep(8)
    assert once(2) == "masked"  # the record was gone


def test_sliding_ratios_count_late_and_repeated_rows_once(spark):
    rows = spark.range(2000).select(F.col("id").alias("event_id"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 100)").alias("ts"), (F.col("id") % 4 == 0).cast("int").alias("bad"), F.floor(F.col("id") / 700).cast("int").alias("part"))
    planted = rows.unionByName(rows.where("event_id % 7 = 0")).unionByName(rows.where("event_id < 5").withColumns({"part": F.lit(2), "event_id": -1 - F.col("event_id")}))
    steps, first = run(counted(in_order(planted, F.col("part"), 3), {"requests": F.lit(1), "errors": F.col("bad")}, "1 hour"), "steps")
    assert dropped(first) == 5
    assert steps.agg(F.sum("requests"), F.max("requests")).first()[1] == 3
    found, query = run(sliding_ratios(stream_of(steps)), "ratios")
    day = found.where("range = '1d'").orderBy("t").collect()
    assert day[-1].requests == 864 and day[-1].ratio == 0.25
    assert found.groupBy("range", "t").count().where("count > 1").isEmpty()
    assert query.lastProgress.stateOperators[0].numRowsTotal < steps.count()


def test_settings_are_set_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ValueError), settings(spark, {"spark.sql.shuffle.partitions": "3", "spark.maskwright.none": "x"}):
        raise ValueError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.maskwright.none", None) is None


def test_kept_tables_are_deleted(spark):
    path = shared.kept(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    import os

    assert os.path.exists(path)
    shared.discard(spark)
    assert not os.path.exists(path)


def test_liveness_by_hand(spark):
    m = 60_000_000
    # a: up, then 0 from minute 2 to 6, then never again; b: seen once; strays and nulls count for nothing
    rows = [("a", 0, 1.0), *[("a", i * m, 0.0) for i in range(2, 7)], ("a", 2 * m, 0.0), ("b", 3 * m + 1, 1.0), ("b", 3 * m + 1, 0.0), (None, 4 * m, 0.0), ("c", None, 1.0), ("c", 5 * m, None), ("d", 10**15, 1.0), ("d", -(10**12), 1.0)]
    got = {r.t // 60: (r.n_up, r.n_down, r.alert_down, r.alert_absent) for r in alerts.liveness(spark.createDataFrame(rows, "series string, t long, up double"), (0, 1200, 60)).collect()}
    assert len(got) == 21 and [got[i][0] for i in range(10)] == [1, 1, 0, 0, 1, 1, 1, 1, 1, 0]
    assert [i for i in got if got[i][1]] == [4, 5, 6, 7, 8, 9, 10] == [i for i in got if got[i][2]]
    assert [i for i in got if got[i][3]] == list(range(16, 21))
    assert alerts.liveness(spark.createDataFrame([], "series string, t long, up double"), (0, 600, 60)).where("alert_absent").count() == 6
