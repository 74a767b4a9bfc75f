"""Schemas, sinks and streams of requests, by hand."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from maskwright.operators import scoring
from maskwright.sources import audit_log, models
from maskwright.sources.corpus import load, shape_problems
from maskwright.sources.schema import checked
from maskwright.streaming import requests
from maskwright.streaming.session import in_order

# schema, bodies that fit, bodies that don't
KEYWORDS = [
    ({"type": "integer"}, ["1", "1.0", "-0", "1e3", "12345678901234567890123"], ["1.5", '"1"', "null", "true", "[1]", "1e-3"]),
    ({"type": ["number", "null"]}, ["1", "1.5", "1e300", "null"], ['"1"', "{}", "false"]),
    ({"type": "object"}, ["{}", '{"a":null}'], ["[]", '"{}"']),
    ({"type": "array"}, ["[]", "[[1]]"], ["{}", "0"]),
    ({"const": {"b": [1], "a": "x'\\"}}, ['{"a":"x\'\\\\","b":[1]}', '{"b":[1.0],"a":"x\'\\\\"}'], ["{}", '{"a":"x","b":[1]}', "null"]),
    ({"enum": [1, "1", None, False]}, ["1", "1.00", '"1"', "null", "false"], ["true", "2", '"2"', "[1]", '"null"']),
    ({"minimum": 0.1, "maximum": 5}, ["0.1", "5", "5.0", '"9"', "null", "[9]"], ["0.0999", "5.01", "1e300", "-1e300"]),
    ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, ["1.000001", "2", '"0"'], ["1", "3", "3.0"]),
    ({"multipleOf": 0.1}, ["0.3", "7", '"x"'], ["0.35"]),
    ({"minLength": 2, "maxLength": 3}, ['"жя"', '"🙂🙂🙂"', "5", "[]"], ['"ж"', '""', '"abcd"']),
    ({"pattern": "b+'$"}, ['"abb\'"', "1", "null"], ['"b"', '""']),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, ["[1]", "[1,2]", '[{"a":1},{"a":2}]', "{}"], ["[]", "[1,2,3]", "[1,1.0]", '[{"a":1,"b":2},{"b":2,"a":1}]']),
    ({"items": {"items": {"type": "string"}}}, ['[["a"],[],3]', "{}"], ['[["a"],["b",1]]']),
    ({"prefixItems": [{"type": "string"}, {"type": "null"}], "items": False}, ["[]", '["a"]', '["a",null]'], ["[1]", '["a",1]', '["a",null,0]']),
    ({"required": ["a", "b'c"]}, ['{"a":null,"b\'c":1}', "[]"], ["{}", '{"a":1}']),
    ({"properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "integer"}}, ["{}", '{"a":"x","b":1}'], ['{"a":1}', '{"b":"x"}']),
    ({"minProperties": 1, "maxProperties": 1}, ['{"a":1}', "1"], ["{}", '{"a":1,"b":1}']),
    ({"allOf": [{"minimum": 2}, {"maximum": 4}]}, ["3"], ["1", "5"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 2}]}, ['"x"', "2", "[]"], ["1"]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, ["1", "2.5"], ["3", "1.5"]),
    ({"not": {"type": "string"}}, ["1"], ['"x"']),
    ({"$defs": {"a/b": {"type": "string"}, "c": {"$ref": "#/$defs/a~1b"}}, "items": {"$ref": "#/$defs/c"}}, ['["x"]'], ["[1]"]),
    (True, ["1", "null"], ["", "nul", "[1", "1 2", '{"a":1,"a":1}']), (False, [], ["1", "{}"]),
]


def test_each_keyword(spark):
    for schema, good, bad in KEYWORDS:
        rows = spark.createDataFrame([(b, True) for b in good] + [(b, False) for b in bad] + [(None, False)], "body string, fits boolean").coalesce(1)
        wrong = [r.body for r in checked(rows, schema).collect() if (r.breaches == []) != r.fits]
        assert not wrong, (schema, wrong)


def test_places_of_breaches(spark):
    schema = {"properties": {"a/b": {"items": {"properties": {"~": {"type": "string", "minLength": 2}}, "additionalProperties": False}}}, "required": ["a/b", "c"]}
    rows = spark.createDataFrame([('{"a/b":[{"~":1,"x":0,"y/":0},{},{"~":"a"}]}',)], "body string")
    got = [tuple(b) for b in checked(rows.withColumn("l_", F.lit(1)), schema).first().breaches]
    assert got == [("/a~1b/0/x", "additionalProperties"), ("/a~1b/0/y~1", "additionalProperties"), ("/a~1b/0/~0", "type"), ("/a~1b/2/~0", "minLength"), ("/c", "required")]


def test_a_schema_that_is_not_understood_is_refused(spark):
    docs = spark.createDataFrame([("1",)], "body string")
    for schema in ({"patternProperties": {}}, {"if": {}}, {"type": "int"}, {"$ref": "http://x/y"}, {"items": {"$ref": "#"}}):
        with pytest.raises(ValueError):
            checked(docs, schema if schema != {"items": {"$ref": "#"}} else {"$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}, "$ref": "#/$defs/n"})


def test_a_long_body(spark):
    body = json.dumps([{"n": i if i % 1000 else "x"} for i in range(50_000)])
    found = checked(spark.createDataFrame([(body,)], "body string"), {"items": {"properties": {"n": {"type": "integer"}}}}).select(F.size("breaches").alias("n")).first()
    assert found.n == 50


def test_a_corpus_of_another_shape_is_refused_with_the_place(spark, tmp_path):
    span = {"type": "PHONE", "start": 0, "end": 1, "value": "x", "personal": True, "mask_token": "<PHONE>"}
    case = {"id": "a", "input": "x", "expected_mask": "<PHONE>", "spans": [span]}
    file = {"version": "1", "offset_unit": "utf8_byte", "cases": [case]}
    bad = {
        "no_json.json": ("{", "", "json"), "version.json": (file | {"version": "2"}, "/version", "const"), "extra.json": (file | {"more": 1}, "/more", "additionalProperties"), "id.json": (file | {"cases": [case | {"id": ""}]}, "/cases/0/id", "minLength"),
        "start.json": (file | {"cases": [case, case | {"spans": [span, span | {"start": -1}]}]}, "/cases/1/spans/1/start", "minimum"), "end.json": (file | {"cases": [case | {"spans": [span | {"end": "1"}]}]}, "/cases/0/spans/0/end", "type"),
        "lost.json": (file | {"cases": [{k: v for k, v in case.items() if k != "input"}]}, "/cases/0/input", "required"),
    }
    for name, (content, _, _) in bad.items():
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
    got = {(r.file.rsplit("/", 1)[1], r.path, r.keyword) for r in shape_problems(spark, str(tmp_path)).collect()}
    assert got == {(name, path, keyword) for name, (_, path, keyword) in bad.items()}
    with pytest.raises(ValueError, match="minimum at /cases/1/spans/1/start"):
        load(spark, str(tmp_path / "start.json"))
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "c.json").write_text(json.dumps(file))
    assert shape_problems(spark, str(tmp_path / "good")).count() == 0 and load(spark, str(tmp_path / "good")).first().id == "a"


# --- the audit log


def append(rows, path, name=None, **options):
    writer = rows.write.format(audit_log.FORMAT).mode("append").options(**options)
    (writer.option("name", name) if name else writer).save(path)


def lines(spark, path):
    return sorted(r.line for r in spark.read.format(audit_log.FORMAT).load(path).collect())


def test_a_commit_counts_once(spark, tmp_path):
    audit_log.register(spark)
    path = str(tmp_path / "log")
    rows = spark.range(0, 1000, 1, 4).selectExpr("concat('ж', id) AS line")
    append(rows, path, "one")
    append(rows, path, "one")
    append(rows.limit(0), path, "none")
    append(rows, path)
    append(rows, path)
    found = spark.read.format(audit_log.FORMAT).load(path)
    assert sorted(r["count"] for r in found.groupBy("commit").count().collect()) == [1000, 1000, 1000] and found.where("commit = 'one'").select("line").distinct().count() == 1000
    assert len(os.listdir(f"{path}/lines")) == 12 and len(os.listdir(f"{path}/commits")) == 4


def test_a_failed_job_leaves_no_line(spark, tmp_path):
    audit_log.register(spark)
    path = str(tmp_path)
    append(spark.createDataFrame([("kept",)], "line string"), path)
    rows = spark.range(0, 40, 1, 4).selectExpr("CASE WHEN id < 35 THEN 'l' || id END AS line", "id")
    for bad in (rows, rows.selectExpr("coalesce(line, 'a\\nb') AS line"), rows.selectExpr("coalesce(line, repeat('x', 200)) AS line"), rows.selectExpr("CASE WHEN id = 39 THEN raise_error('lost') ELSE 'l' END AS line")):
        with pytest.raises(PySparkException):
            append(bad.select("line"), path, mostBytes="100")
        assert lines(spark, path) == ["kept"]
    with pytest.raises(PySparkException):
        spark.range(1).selectExpr("'x' AS line").write.format(audit_log.FORMAT).mode("overwrite").save(path)
    open(f"{path}/lines/left-behind.jsonl", "w").write("what a killed task wrote\n")
    assert lines(spark, path) == ["kept"]
    assert audit_log.sweep(spark, path) == 0 and audit_log.sweep(spark, path, 0) >= 1
    assert len(os.listdir(f"{path}/lines")) == 1 and lines(spark, path) == ["kept"]


def test_an_empty_log_and_a_damaged_one(spark, tmp_path):
    audit_log.register(spark)
    path = str(tmp_path / "new")
    assert lines(spark, path) == [] and audit_log.sweep(spark, path, 0) == 0
    append(spark.createDataFrame([("",), ("x",)], "line string").coalesce(1), path)
    assert lines(spark, path) == ["", "x"]
    (file,) = os.listdir(f"{path}/lines")
    open(f"{path}/lines/{file}", "a").write("more\n")
    with pytest.raises(PySparkException, match="not what its commit says"):
        lines(spark, path)


def test_a_stream_that_loses_its_checkpoint_adds_nothing(spark, tmp_path):
    audit_log.register(spark)
    path = str(tmp_path / "log")
    arriving = in_order(spark.range(30).selectExpr("id", "id % 3 AS part"), F.col("part"), 3, 2).selectExpr("CAST(id AS STRING) AS line")

    def run(state, name="s"):
        writer = arriving.writeStream.format(audit_log.FORMAT).option("path", path).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True)
        (writer.option("name", name) if name else writer).start().awaitTermination()

    run("a")
    run("b")
    run("b")
    assert lines(spark, path) == sorted(map(str, range(30))) and len(os.listdir(f"{path}/commits")) == 3
    run("c", "other")
    assert len(lines(spark, path)) == 60
    with pytest.raises(PySparkException):
        run("d", None)


# --- requests as a stream


def test_a_restart_writes_no_row_twice(spark, tmp_path):
    rows = [(i, i % 4, None if i % 5 == 0 else "{" if i % 5 == 1 else json.dumps({"text": f"т{i}", "scope_id": "s"})) for i in range(40)]
    arriving = in_order(spark.createDataFrame(rows, "id int, part int, body string"), F.col("part"), 4, 2)
    out, state, seen = str(tmp_path / "out"), str(tmp_path / "state"), []

    def lost(batch):
        seen.append(batch)
        if seen.count(batch) == 1 and batch in (0, 2):
            raise RuntimeError("lost")

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            requests.serve(arriving, out, state, ("text",), ("scope_id",), then=lost).awaitTermination()
    requests.serve(arriving, out, state, ("text",), ("scope_id",), then=lost).awaitTermination()
    assert seen == [0, 0, 1, 2, 2, 3]
    columns = "id int, part int, text string, scope_id string"
    good, refused = requests.served(spark, out, columns), requests.served(spark, out, columns, True)
    assert sorted((r.id, r.text, r.batch) for r in good.collect()) == [(i, f"т{i}", i % 4) for i in range(40) if i % 5 > 1]
    assert sorted((r.id, r.error, r.text) for r in refused.collect()) == [(i, "json", None) for i in range(40) if i % 5 < 2]
    assert requests.served(spark, out, columns, None).count() == 40 and "body" not in good.columns
    requests.serve(arriving, out, state, ("text",), ("scope_id",), then=lost).awaitTermination()
    assert seen == [0, 0, 1, 2, 2, 3]


# --- answers of models, support of types


def test_answers_of_another_shape_are_refused(spark):
    e = {"label": "ru_pii_person", "start": 2, "end": 5, "confidence": 0.5, "model": "gliner"}
    whole = lambda *es, **more: json.dumps({"entities": list(es), **more})
    good = [whole(), whole(e), whole(e, e | {"label": ""}, e | {"start": -1}, e | {"end": 99}, e | {"confidence": 2}), whole(e | {"confidence": 1}), " " + whole(e) + "\n"]
    bad = ["", "{}", "[]", "null", '{"entities":null}', '{"entities":{}}', whole(took=1), whole(e | {"why": ""}), whole(e) + " {}", whole(e)[:-1], whole(e, None), whole([e])]
    bad += [whole({k: v for k, v in e.items() if k != name}) for name in e] + [whole(e | {name: None}) for name in e]
    bad += [whole(e | {"start": 1.5}), whole(e | {"start": "1"}), whole(e | {"start": 1 << 31}), whole(e).replace("2", "2.0"), whole(e | {"confidence": "1"}), whole(e | {"model": "GLINER"}), whole(e | {"label": 1})]
    rows = spark.createDataFrame([(i, "я яяя", a) for i, a in enumerate([*good, *bad, None])], "doc_id long, text string, answer string")
    got = {r.doc_id: (r.error, r.entities) for r in models.answers(rows).collect()}
    n = len(good)
    assert [got[i][0] for i in range(n)] == [None] * n and [i for i in range(n, n + len(bad)) if got[i] != ("invalid_response", None)] == [] and got[n + len(bad)] == ("unavailable", None)
    assert [len(got[i][1]) for i in range(n)] == [0, 1, 5, 1, 1] and tuple(got[1][1][0]) == ("ru_pii_person", 2, 5, 0.5, "gliner")
    found = models.model_candidates(models.answered(rows), rows.drop("answer")).select("doc_id", F.inline("models")).collect()
    assert sorted((r.doc_id, r.type, r.start, r.end) for r in found) == [(i, "FULL_NAME", 3, 9) for i in (1, 2, 3, 4)]


def test_support_and_types_that_only_negatives_have(spark):
    span = lambda rows: spark.createDataFrame(rows, "case_id string, type string, start long, end long")
    truth = span([("a", "X", 0, 1), ("a", "X", 0, 1), ("b", "X", 0, 1), ("a", "Y", 5, 6), (None, "X", 0, 1)])
    found = span([("a", "X", 0, 1), ("b", "X", 0, 2), ("b", "X", 0, 2), ("a", "Z", 0, 1), (None, "X", 0, 1)])
    doubted = span([("b", "X", 0, 2), ("a", "X", 0, 1), ("c", "W", 0, 1)])
    got = {r.type: (r.support, r.predicted, r.tp, r.fp, r.fn, r.fp_on_hard_negative, r.precision_defined, r.recall_defined) for r in scoring.detection_metrics(truth, found, doubted).collect()}
    assert got == {"X": (3, 3, 2, 1, 1, 1, True, True), "Y": (1, 0, 0, 0, 1, 0, False, True), "Z": (0, 1, 0, 1, 0, 0, True, False), "W": (0, 0, 0, 0, 0, 0, False, False)}
    assert scoring.detection_metrics(truth.limit(0), found.limit(0)).count() == 0 and scoring.detection_metrics(truth, found).where("type = 'X'").first().fp_on_hard_negative == 0


def test_answers_are_decoded_once(spark, monkeypatch):
    from maskwright.plans import queries as engine
    from maskwright.sources import models

    calls, decode = [], models.answers
    monkeypatch.setattr(models, "answers", lambda *args: calls.append(1) or decode(*args))
    plan = engine.CATALOG.queries["model_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "parse_json" not in plan  # what is joined was written before


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    from maskwright.sources.tables import spread

    path = str(tmp_path / "one")
    spark.range(1000).withColumn("text", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(path)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        many = spark.read.parquet(path)
        assert many.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism  # of which one has rows
        sizes = [n for n in spread(many).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
