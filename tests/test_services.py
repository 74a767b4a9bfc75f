"""Settings, requests, tokens, states, model hooks, ranks and alerts against plain versions and hand-made cases."""

import base64
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.functions.registry import extended
from maskwright.functions.rules import BY_NAME
from maskwright.functions.spans import with_candidates
from maskwright.operators import alerts, audit, inference, process, runtime, scoring, tokens, vault
from maskwright.operators import entities as E
from maskwright.operators.ranks import nearest_rank
from maskwright.plans.detection import spans
from maskwright.plans.entity_queries import _with_models
from maskwright.plans.service_queries import WordPredictor
from maskwright.sources import corpus, requests, settings
from maskwright.sources.models import model_candidates, with_models
from maskwright.streaming.process import process_stream

KEY = bytes(range(32))
SPAN = "struct<type:string,start:bigint,end:bigint,confidence:double,score:double,owner_type:string,owner_id:string,sources:array<string>,parts:array<string>,reasons:array<string>,personal:boolean>"


def test_settings():
    env = {"PII_VAULT_KEY": base64.b64encode(KEY).decode()}
    got = settings.load(env)
    assert (got.vault_ttl, got.model_mode, got.vault_key) == (900.0, "full", KEY) and KEY.hex() not in repr(got) and "vault_key" not in repr(got)
    assert settings.load(env | {"PII_VAULT_TTL": "1h30m", "PII_LOG_LEVEL": "DEBUG"}).vault_ttl == 5400.0
    for name, value in {
        "VAULT_KEY": "AAAA", "VAULT_TTL": "-5s", "MODEL_MODE": "slow", "LLM_MODEL": "m", "LLM_API_KEY": "k", "METRICS_LISTEN_ADDRESS": "127.0.0.1:8080", "MODEL_WORKER_URL": "ftp://x", "LOG_LEVEL": "loud", "MODEL_CLIENT_TIMEOUT": "5 parsecs",
    }.items():
        with pytest.raises(ValueError, match=f"PII_{name}"):
            settings.load(env | {f"PII_{name}": value})
    with pytest.raises(ValueError, match="required"):
        settings.load({})
    with pytest.raises(ValueError, match="PII_LLM_URL"):
        settings.load(env | {"PII_LLM_URL": "http://user@host", "PII_LLM_MODEL": "m"})


def test_request_bodies(spark):
    bodies = {
        b'{"text": "a", "mode": "strict"}': (None, "a", "strict"), b'{"text": "a"} {}': ("json", None, None), b'{"text": "a"}, {"text": "b"}': ("json", None, None), b'{"text": "a"}], [1': ("json", None, None), b'["a"]': ("json", None, None),
        b"": ("json", None, None), b'{"text": " \\u00a0 "}': ("blank", None, None), b'{"mode": "x"}': ("blank", None, None), b'{"text": 5}': ("json", None, None), b'{"text": "a", "mode": null}': (None, "a", None), b'{"text": "\xff"}': ("encoding", None, None),
        b'{"text": "' + b"x" * 200 + b'"}': ("too_large", None, None), '{"text": "я 🙂"}'.encode(): (None, "я 🙂", None),
    }
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)] + [(99, None)], "id long, body binary")
    got = {r.id: (r.error, r.text, r.mode) for r in requests.decoded(rows, ("text",), ("mode",), most_bytes=100).collect()}
    assert [got[i] for i in range(len(bodies))] == list(bodies.values()) and got[99][0] == "json"
    ids = {r[0] for r in spark.range(20).select(requests.correlation_id()).collect()}
    assert len(ids) == 20 and all(len(i) == 36 and i.startswith("req_") and int(i[4:], 16) >= 0 for i in ids)


def test_corpus_files_of_another_shape(spark, tmp_path):
    span = {"type": "PHONE", "start": 0, "end": 1, "value": "x", "personal": False}
    case = {"id": "a", "input": "x", "expected_mask": "x", "spans": [span]}
    whole = {"version": "1", "offset_unit": "utf8_byte", "cases": [case]}
    bad = {
        "extra": whole | {"more": 1}, "missing": {k: v for k, v in whole.items() if k != "version"}, "version": whole | {"version": "2"}, "case": whole | {"cases": [case | {"x": 1}]}, "case2": whole | {"cases": [{"id": "a"}]},
        "span": whole | {"cases": [case | {"spans": [span | {"x": 1}]}]}, "list": [whole],
    }
    good = tmp_path / "good.json"
    good.write_text(json.dumps(whole))
    assert corpus.load(spark, str(good)).count() == 1
    for name, x in bad.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(x))
        with pytest.raises(ValueError, match="not a corpus"):
            corpus.load(spark, str(path))


def test_tokens_of_slots(spark):
    rows = [("s", "PHONE", "1", 0), ("s", "PHONE", "1", 9), ("s", "PHONE", "1", 10), ("s", "PHONE", "2", 0), ("t", "PHONE", "1", 0), ("s", "EMAIL", "1", 0), ("s", "PHONE", "1", 25)]
    asked = spark.createDataFrame([(*r[:3], i) for i, r in enumerate(rows)], "scope string, type string, value string, n int").withColumn("at", F.element_at(F.array(*[F.timestamp_seconds(F.lit(r[3])) for r in rows]), F.col("n") + 1))
    issued, minted = tokens.issue(asked, KEY, 10)
    got = {r.n: r.token for r in issued.collect()}
    assert got[0] == got[1] and len(set(got.values())) == 6 and minted.count() == 6 and all(g.startswith("<") for g in got.values())
    assert {r.n: r.token for r in issued.collect()} == got  # random seeds stay once they are drawn
    many = spark.range(300).select(F.lit("s").alias("scope"), F.lit("PHONE").alias("type"), F.col("id").cast("string").alias("value"), F.timestamp_seconds(F.lit(0)).alias("at"))
    short = tokens.mint(tokens.slots(many, 10), KEY, suffix_bytes=2)
    assert short.select("token").distinct().count() == 300  # collisions are minted anew
    with pytest.raises(ValueError):
        tokens.mint(tokens.slots(many, 10), KEY, suffix_bytes=1)
    left = tokens.revoked(minted, spark.createDataFrame([("s",), ("s",), ("none",)], "scope string"))
    assert {r.scope for r in left.collect()} == {"t"}


def entity(kind, start, end, personal=True, confidence=1.0):
    return (kind, start, end, confidence, 0.9, "PERSON", "person-1", ["regex"], [], [], personal)


def test_replacement_in_spans(spark):
    text = "я Иван, тел 12"
    cases = [
        ([entity("B", 3, 11), entity("A", 3, 11)], "я <A:Иван>, тел 12", None), ([entity("A", 3, 11), entity("B", 3, 7)], "я <A:Иван>, тел 12", None), ([entity("A", 3, 9), entity("B", 5, 11)], None, "partial_overlap"),
        ([entity("A", 2, 6)], "я< :A>", None), ([entity("A", 4, 7)], None, "invalid_span"), ([entity("A", 3, 99)], None, "invalid_span"), ([entity("A", 5, 5)], None, "invalid_span"), ([entity("A", 3, 11, False), entity("B", 20, 22)], "я Иван, тел <B:12>", None), ([], text, None),
    ]
    cases[3] = ([entity("A", 2, 3)], "я<A: >Иван, тел 12", None)
    docs = spark.createDataFrame([(i, "s", text, e) for i, (e, _, _) in enumerate(cases)] + [(99, "s", None, [entity("A", 0, 1)])], f"doc_id long, scope string, text string, entities array<{SPAN}>")
    made = tokens.replace_spans(docs, "'<' || e.type || ':' || {value} || '>'")
    got = {r.doc_id: (r.tokenized, r.error) for r in made.collect()}
    for i, (_, want, error) in enumerate(cases):
        assert got[i] == (want, error), i
    assert got[99] == (None, None)
    held = spark.createDataFrame([("s", "<A:Иван>", "other"), ("s", "<B:12>", "12")], "scope string, token string, original string")
    texts, new = tokens.persist(made, held)
    stored = {r.doc_id: (r.tokenized, r.error) for r in texts.collect()}
    assert stored[0] == stored[1] == (None, "conflict") and stored[7][0] == "я Иван, тел <B:12>" and stored[2] == (None, "partial_overlap")
    assert {(r.token, r.original) for r in new.collect()} == {("<A: >", " ")}


def test_rows_that_share_an_id_do_not_mix(spark):
    a, b = "<PHONE_" + "a" * 32 + ">", "<PHONE_" + "b" * 32 + ">"
    docs = spark.createDataFrame([(1, "s", f"x {a} {b} {a}"), (1, "s", f"{b}"), (1, "s", f"{b}"), (1, "t", f"{a}"), (2, "s", "none"), (3, "s", None)], "doc_id long, scope string, tokenized string")
    held = spark.createDataFrame([("s", a, "A")], "scope string, token string, original string")
    got = sorted((r.doc_id, str(r.restored), r.n_unresolved, r.n_resolved, tuple(r.unresolved)) for r in vault.detokenize(docs, held).collect())
    assert got == sorted([(1, f"x A {b} A", 1, 1, (b,)), (1, b, 1, 0, (b,)), (1, b, 1, 0, (b,)), (1, a, 1, 0, (a,)), (2, "none", 0, 0, ()), (3, "None", 0, 0, ())])


def play(rows, degraded=False):
    """The requests of one id, one after the other."""
    out, original, result, failure = [], None, None, None
    for seq, payload, status in sorted(rows):
        if original is None or failure == "model_unavailable" and payload == original:
            original, failure = payload, None
            if status in ("ok", "degraded"):
                result = f"<{payload}>"
                out.append((seq, "masked" if status == "ok" else "degraded", result))
            else:
                failure = process.FAILURES[status]
                out.append((seq, failure, None))
        elif payload == original:
            out.append((seq, failure or "stored", None if failure else result))
        elif failure is None and payload == result:
            out.append((seq, "restored", original))
        else:
            out.append((seq, "conflict", None))
    return out


def played(n=300):
    rng = random.Random(8)
    return [(i, seq, rng.choice(["a", "a", "a", "<a>", "b"]), rng.choice(["ok", "ok", "unavailable", "unavailable", "error", "vault", "review"])) for i in range(n) for seq in range(rng.randrange(1, 9))]


def test_states_of_requests(spark, tmp_path):
    rows = played()
    want = {(i, *x) for i in {r[0] for r in rows} for x in play([r[1:] for r in rows if r[0] == i])}
    frame = spark.createDataFrame(rows, "payload_id long, seq long, payload string, model_status string").repartition(7)
    got = process.answers(frame, F.concat(F.lit("<"), "payload", F.lit(">")))
    assert {(r.payload_id, r.seq, r.outcome, r.reply) for r in got.collect()} == want
    states = {r.payload_id: r.state for r in process.final_states(got).collect()}
    assert set(states.values()) == {"ready", "failed:model_unavailable", "failed:masking_failed", "failed:vault_unavailable", "failed:review_required"}
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    query = process_stream(stream, lambda x: f"<{x}>").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.payload_id, r.seq, r.outcome, r.reply) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_fallback(spark):
    rows = spark.createDataFrame([(1, 1, "a", "unavailable"), (2, 1, "a", "error"), (3, 1, "a", "ok")], "payload_id long, seq long, payload string, model_status string")
    ask = lambda allowed, by=None: {r.payload_id: (r.outcome, r.reply) for r in process.answers(process.with_fallback(rows, allowed, by), F.lit("full"), rules_only=F.lit("rules")).collect()}
    assert ask(True) == {1: ("degraded", "rules"), 2: ("masking_failed", None), 3: ("masked", "full")}
    assert ask(False)[1] == ("model_unavailable", None) and ask(True, F.lit("vault"))[1] == ("vault_unavailable", None)


def test_protected_texts_come_back_or_fail(spark):
    docs = spark.createDataFrame([(i, "s", f"тел. +7 900 123-45-6{i}") for i in range(4)], "doc_id long, scope string, text string")
    owned = E.detect(docs)
    stored = vault.mappings(owned, KEY)
    answer = F.expr("CASE doc_id WHEN 0 THEN 'ok ' || tokenized WHEN 1 THEN tokenized || tokenized WHEN 2 THEN NULL ELSE tokenized END")
    got = {r.doc_id: (r.result, r.failed) for r in runtime.run(owned, lambda d: vault.tokenize(d, KEY), lambda d: d.withColumn("answer", answer), lambda d: vault.detokenize(d, stored.where("original NOT LIKE '%63'"), text="answer")).collect()}
    assert got == {0: ("ok тел. +7 900 123-45-60", None), 1: (None, "transform"), 2: (None, "transform"), 3: (None, "restore")}


class Jumpy(WordPredictor):
    """Tokens of a part can be more than those of the whole: a word at the end of a window counts twice."""

    capacity = 5

    def tokens(self, text):
        found = super().tokens(text)
        return [*found, found[-1]] if found and len(found) % 2 else found


@pytest.mark.parametrize("overlap", [0, 2])
def test_windows_of_tokens(overlap):
    words = WordPredictor().tokens
    for n in (0, 1, 5, 6, 23):
        text = "  ".join("w" * (k % 3 + 1) for k in range(n)) + "   "
        total, found = inference.token_windows(text, words, 5, overlap)
        assert total == n and all(1 <= k <= 5 and len(words(text[a:b])) == k for a, b, k in found)
        assert not n or (found[0][0] == 0 and found[-1][1] == len(text) and all(a[1] >= b[0] > a[0] for a, b in zip(found, found[1:], strict=False)))
    total, found = inference.token_windows("a b c d e f g h i j", Jumpy().tokens, 5, 0)
    assert all(k <= 5 for *_, k in found) and found[-1][1] == 19
    with pytest.raises(ValueError):
        inference.token_windows("a", words, 5, 5)
    with pytest.raises(ValueError):
        inference.token_windows("abc def", lambda t: [(i, i + 1) for i in range(len(t))] * 9, 5, 0)


def test_models_fail_their_documents_only(spark):
    class Failing(WordPredictor):
        def infer(self, found):
            if any("boom" in t for t in found):
                raise RuntimeError("no")
            return super().infer(found)

    docs = spark.createDataFrame([(1, "the one boom"), (2, "the two, the end"), (3, "the two, the end"), (4, None), (5, " ".join(["the"] * 60))], "doc_id long, text string")
    entities, errors = inference.infer_bounded(docs, Failing(), 8)
    assert {(r.doc_id, r.error) for r in errors.collect()} == {(1, "model")}
    assert {(r.doc_id, r.start_cp) for r in entities.where("doc_id < 4").collect()} == {(2, 0), (2, 9), (3, 0), (3, 9)}
    assert entities.where("doc_id = 5").count() > 60  # words in an overlap come twice
    once, _ = inference.once_per_text(docs, lambda d: inference.infer_bounded(d, Failing(), 8))
    assert {(r.doc_id, r.start_cp) for r in once.where("doc_id < 4").collect()} == {(2, 0), (2, 9), (3, 0), (3, 9)}
    assert {r.error for r in inference.infer_bounded(docs, WordPredictor(), 8, limit=50)[1].where("doc_id = 5").collect()} == {"token_limit"}


def test_a_partial_model_row_fails_its_document(spark):
    docs = spark.createDataFrame([(1, "Иванов тут"), (2, "Иванов тут")], "doc_id long, text string")
    rows = [(1, "LAST_NAME", 0, 6, 0.9, "rubert"), (1, "LAST_NAME", 0, None, 0.9, "rubert"), (2, "LAST_NAME", 0, 6, 0.9, "rubert"), (2, "", 0, 6, 0.9, "rubert"), (2, "LAST_NAME", 3, 99, 0.9, "rubert"), (2, "LAST_NAME", 0, 6, 1.5, "rubert")]
    found = model_candidates(spark.createDataFrame(rows, "doc_id long, label string, start_cp int, end_cp int, confidence double, model string"), docs).collect()
    assert [(r.doc_id, len(r.models), r.models[0].end) for r in found] == [(2, 1, 12)]


def test_models_of_a_row_need_no_join(spark):
    docs = spark.createDataFrame([(i, "Иванов 4111111111111111 тут") for i in range(9)], "doc_id long, text string")
    card, name = ("CREDIT_CARD", 7, 23, 0.9, "rubert"), ("LAST_NAME", 0, 6, 0.9, "rubert")
    said = {0: [card, name], 1: [("CREDIT_CARD", 7, 22, 0.9, "rubert"), name], 2: [name, ("NO_SUCH", 0, 6, 0.9, "rubert")], 3: [name, (*name[:2], None, *name[3:])], 4: [name, ("", 0, 6, 0.9, "rubert")], 5: [name, ("LAST_NAME", 3, 99, 0.9, "rubert")], 6: [name, ("LAST_NAME", 0, 6, 1.5, "rubert")], 7: [], 8: [("LAST_NAME", 4, 2, 0.9, "rubert"), ("CREDIT_CARD", 7, 23, 0.9, "gliner")]}
    fields = "label string, start_cp int, end_cp int, confidence double, model string"
    rows = spark.createDataFrame([(i, *m) for i, ms in said.items() for m in ms], f"doc_id long, {fields}")
    want = {r.doc_id: sorted(r.models) for r in model_candidates(rows, docs, spans(docs, (BY_NAME["card"],))).collect()}
    held = with_candidates(docs, (BY_NAME["card"],)).join(spark.createDataFrame(list(said.items()), f"doc_id long, said array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"), "doc_id")
    got = {r.doc_id: sorted(r.models) for r in with_models(held, F.col("said"), "candidates").collect()}
    assert {i for i, m in got.items() if m} == {0, 1, 4, 5, 6} and len(got[0]) == 2
    assert {i: m for i, m in got.items() if m} == want
    plan = _with_models(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_candidates_within_a_character_are_dropped(spark):
    one = lambda a, b, c, d: ("LAST_NAME", a, b, c, d, 0.9, ["rubert"])
    rows = [(1, "Иванов", [one(0, 12, 0, 6), one(1, 12, 0, 6), one(0, 11, 0, 6), one(0, 99, 0, 6), one(4, 4, 2, 2)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, models array<struct<type:string,start:bigint,end:bigint,cstart:int,cend:int,confidence:double,sources:array<string>>>")
    assert [(e.start, e.end) for e in E.detect(docs, models="models").first().entities] == [(0, 12)]


def test_ranks(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=5000).tolist(), "b": [1.0] * 3000 + [2.0] * 10, "c": [5.0], "d": [None], None: rng.integers(0, 5, 999).astype(float).tolist()}
    rows = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "g string, v double").repartition(5)
    got = {r.g: r for r in nearest_rank(rows, "g", "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    for k, x in values.items():
        x = sorted(v for v in x if v is not None)
        assert got[k].n == len(x)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert got[k][name] == (x[math.ceil(p * len(x) - 1e-9) - 1] if x else None)


def test_alerts_hold(spark):
    good = [int(c) for c in "0110111100111111"]
    steps = spark.createDataFrame([(60 * i, g) for i, g in enumerate(good)], "t long, good int")
    got = [r.firing for r in alerts.holding(steps, F.col("good") == 1, 120, "firing").orderBy("t").collect()]
    want, run = [], 0
    for g in good:
        run = run + 1 if g else 0
        want.append(run >= 3)
    assert got == want
    events = spark.createDataFrame([(60.0 * i + 1, i) for i in range(30) if i not in (10, 11, 12, 13)], "s double, n int").withColumn("ts", F.timestamp_seconds("s"))
    rows = alerts.grid(events, {"requests": F.lit(1), "errors": (F.col("n") >= 20).cast("int")}, 60)
    assert rows.count() == 30 and rows.where("requests = 0").count() == 4
    fired = {r.t: (r.burn_fast, r.ratio_5m) for r in alerts.burn_alerts(rows).collect()}
    assert not fired[20 * 60][0] and fired[29 * 60 + 60][0] and abs(fired[30 * 60][1] - 1.0) < 1e-9
    assert [r.t for r in alerts.threshold_alerts(rows.withColumns({n: F.lit(0) for n in ("rejected", "unauthorized", "model_calls", "model_failed", "llm_calls", "llm_failed")})).where("alert_down").collect()] == [780, 840]
    gauge = spark.createDataFrame([(s, 300 * i, 100.0 * i if s == "up" else 5.0) for s in ("up", "flat") for i in range(60)], "series string, t long, value double")
    grown = {(r.series, r.t): r.growing for r in alerts.growing(gauge).collect()}
    assert grown["up", 59 * 300] and not any(v for (s, _), v in grown.items() if s == "flat") and not grown["up", 0]


def test_audit_lines(spark):
    docs = spark.createDataFrame([(1, "s", "тел. +7 900 123-45-67 и ещё"), (2, "s", "")], "doc_id long, scope string, text string")
    rows = audit.projected(E.detect(docs))
    lines = {r.doc_id: json.loads(r.line) for r in audit.lines(rows, requests.correlation_id(), "detect", F.lit("success"), F.lit(3)).collect()}
    assert list(lines[1]) == ["request_id", "operation", "has_personal_data", "detected_types", "entity_count", "personal_flags", "sources", "reason_codes", "duration_ms", "model_mode", "result"]
    assert (lines[1]["detected_types"], lines[1]["personal_flags"], lines[2]["entity_count"]) == (["PHONE"], [True], 0) and "900" not in json.dumps(lines[1])
    assert [r.input_tokens for r in rows.orderBy("doc_id").collect()] == [6, 0]


def test_quality_of_a_corpus(spark):
    cases = spark.createDataFrame([("<A>", "<A>", "x", "x"), ("ab", "ax", "y", None), ("", "", "z", "q"), ("abcd", "", "w", "w")], "masked string, expected_mask string, input string, restored string")
    r = scoring.corpus_quality(cases).first()
    assert (r.n_cases, r.masking_quality, r.restoration_exact_rate) == (4, 0.625, 0.5)


def test_types_of_ones_own():
    assert extended("BADGE_NUMBER")[-1] == "BADGE_NUMBER"
    for bad in ("badge", "", "EMAIL", "DATE", "1X"):
        with pytest.raises(ValueError):
            extended(bad)


def test_detection_is_linear(spark):
    """Twice the entities in one text take no more than about twice the time."""

    def seconds(n):
        text = "\n".join(f"Клиент {i}, тел. +7 900 {i % 1000:03d}-45-67, email test{i}@example.com, г. Москва" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
        best = math.inf
        for _ in range(2):
            began = time.time()
            found = E.masked(E.detect(docs)).select(F.size("entities").alias("n")).first().n
            best = min(best, time.time() - began)
        assert found == 3 * n
        return best

    seconds(300)
    small, large = seconds(1300), seconds(2600)  # about 4000 and 8000 entities
    assert large < 2.6 * small + 0.5, (small, large)
