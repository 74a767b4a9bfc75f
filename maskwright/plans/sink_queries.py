"""Queries of schemas, sinks and streams of requests."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.catalog import Catalog
from maskwright.operators import audit
from maskwright.sources import audit_log, models
from maskwright.sources.schema import checked
from maskwright.sources.shared import folder, kept
from maskwright.sources.tables import spread, table
from maskwright.streaming import requests
from maskwright.streaming.session import in_order

#: The bodies of ``schema_breaches``.
EVENT_SCHEMA = {
    "$defs": {"k": {"type": "integer", "minimum": 3, "exclusiveMaximum": 95, "multipleOf": 2}},
    "type": "object",
    "required": ["id", "kind", "props"],
    "minProperties": 4,
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "kind": {"enum": ["view", "click", "purchase", None]},
        "props": {"type": "object", "properties": {"k": {"$ref": "#/$defs/k"}}, "required": ["k"], "additionalProperties": False, "maxProperties": 1},
        "value": {"oneOf": [{"type": "number", "maximum": 100}, {"type": "number", "minimum": 90}, {"type": "null"}]},
        "tags": {"type": "array", "maxItems": 3, "uniqueItems": True, "items": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 6}},
        "unit": {"const": 1},
        "who": {"not": {"type": "string", "minLength": 3}},
    },
    "additionalProperties": {"type": "boolean"},
}


def register(catalog: Catalog) -> None:
    # --- schemas ---

    def bodies(text: str) -> str:
        """SQL of a JSON text per event, some of them odd; ``text`` is the dialect's type."""
        quoted = "'\"' || event_type || '\"'"
        say = lambda x: f"CAST({x} AS {text})"
        return (
            f"CASE event_id % 101 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN '[]' WHEN 4 THEN '{{}} {{}}' WHEN 5 THEN '{{\"id\":1,\"id\":2}}' WHEN 6 THEN '7' ELSE "
            f"'{{\"id\":' || {say('event_id')} || CASE event_id % 103 WHEN 1 THEN '.0' WHEN 2 THEN '.5' ELSE '' END || CASE WHEN event_id % 107 = 1 THEN '' ELSE ',\"kind\":' || CASE WHEN event_id % 109 = 1 THEN 'null' ELSE {quoted} END END"
            f" || ',\"props\":' || CASE event_id % 113 WHEN 1 THEN '{{}}' WHEN 2 THEN '{{\"k\":\"4\",\"a/~b\":1}}' ELSE props END || ',\"value\":' || {say('CAST(value * 100 AS BIGINT)')} || 'e-2'"
            f" || ',\"tags\":[' || {quoted} || ',\"a\"' || CASE event_id % 127 WHEN 1 THEN ',\"a\"' WHEN 2 THEN ',1,\"ж\"' ELSE '' END || ']' || CASE event_id % 131 WHEN 1 THEN ',\"unit\":1.0' WHEN 2 THEN ',\"unit\":\"1\"' ELSE '' END"
            f" || CASE event_id % 137 WHEN 1 THEN ',\"who\":\"ab\"' WHEN 2 THEN ',\"who\":\"abc\"' WHEN 3 THEN ',\"more\":true' WHEN 4 THEN ',\"more\":0' ELSE '' END || '}}' END AS body"
        )

    number = "TRY_CAST(json_extract_string(body, '$.props.k') AS BIGINT)"
    tests = [
        ("''", "json", "NOT fine"), ("''", "type", "fine AND json_type(body) <> 'OBJECT'"),
        *((f"'/{n}'", "required", f"object AND NOT json_exists(body, '$.{n}')") for n in ("id", "kind", "props")), ("''", "minProperties", "object AND len(json_keys(body)) < 4"),
        ("'/id'", "type", "object AND event_id % 103 = 2"), ("'/kind'", "enum", "object AND json_extract_string(body, '$.kind') NOT IN ('view', 'click', 'purchase')"),
        ("'/props/k'", "required", "object AND event_id % 113 = 1"), ("'/props/k'", "type", "object AND event_id % 113 = 2"), ("'/props/a~1~0b'", "additionalProperties", "object AND event_id % 113 = 2"),
        ("'/props'", "maxProperties", "object AND event_id % 113 = 2"),
        *(("'/props/k'", n, f"object AND event_id % 113 <> 2 AND {number} {t}") for n, t in (("minimum", "< 3"), ("exclusiveMaximum", ">= 95"), ("multipleOf", "% 2 <> 0"))),
        ("'/value'", "oneOf", "object AND CAST(value * 100 AS BIGINT) BETWEEN 9000 AND 10000"), ("'/tags'", "uniqueItems", "object AND event_id % 127 = 1"), ("'/tags'", "maxItems", "object AND event_id % 127 = 2"),
        ("'/tags/0'", "maxLength", "object AND length(event_type) > 6"), ("'/tags/2'", "type", "object AND event_id % 127 = 2"), ("'/tags/3'", "pattern", "object AND event_id % 127 = 2"),
        ("'/unit'", "const", "object AND event_id % 131 = 2"), ("'/who'", "not", "object AND event_id % 137 = 2"), ("'/more'", "type", "object AND event_id % 137 = 4"),
    ]
    each = " UNION ALL ".join(f"SELECT event_id, {path} AS path, '{keyword}' AS keyword FROM k WHERE {test}" for path, keyword, test in tests)

    @catalog.query(
        "schema_breaches",
        f"""WITH b AS (SELECT event_id, event_type, value, {bodies('VARCHAR')} FROM events),
        j AS (SELECT *, body IS NOT NULL AND event_id % 101 NOT IN (2, 4, 5) AS fine FROM b), k AS MATERIALIZED (SELECT * REPLACE (CASE WHEN fine THEN body END AS body), fine AND event_id % 101 NOT IN (3, 6) AS object FROM j) {each}""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select("event_id", F.expr(bodies("STRING")))
        return checked(rows, EVENT_SCHEMA).select("event_id", F.inline("breaches"))

    # answers of a model over "Клиент <name>", some of them of another shape

    def replies(text: str) -> str:
        say = lambda x: f"CAST({x} AS {text})"
        start = f"CASE c_custkey % 17 WHEN 1 THEN '\"7\"' WHEN 2 THEN '7.0' WHEN 3 THEN 'null' WHEN 4 THEN '-1' WHEN 5 THEN '99999999999' ELSE '7' END"
        model = "CASE c_custkey % 19 WHEN 1 THEN 'other' WHEN 2 THEN 'rubert' ELSE 'gliner' END"
        label = "CASE c_custkey % 19 WHEN 2 THEN 'CITY' WHEN 3 THEN '' ELSE 'ru_pii_person' END"
        entity = f"'{{\"entities\":[{{\"label\":\"' || {label} || '\",\"start\":' || {start} || ',\"end\":' || {say('7 + length(c_name) + CASE WHEN c_custkey % 29 = 1 THEN 1 ELSE 0 END')} || ',\"confidence\":' || CASE c_custkey % 31 WHEN 1 THEN '1.5' WHEN 2 THEN '1' ELSE '0.5' END || ',\"model\":\"' || {model} || '\"' || CASE WHEN c_custkey % 37 = 1 THEN ',\"why\":\"\"' ELSE '' END || '}}'"
        return f"CASE c_custkey % 13 WHEN 1 THEN {entity} || '}}' WHEN 2 THEN {entity} || '],\"took\":1}}' WHEN 3 THEN {entity} || ',{{\"label\":\"X\"}}]}}' WHEN 4 THEN '{{\"entities\":null}}' WHEN 5 THEN {entity} || ']}} {{}}' WHEN 6 THEN NULL WHEN 7 THEN '{{\"entities\":[]}}' ELSE {entity} || ']}}' END"

    @catalog.query(
        "model_answers",
        """WITH c AS (SELECT c_custkey, c_name, c_custkey % 13 AS m, c_custkey % 17 AS s, c_custkey % 19 AS l FROM customer),
        e AS (SELECT *, CASE WHEN m = 6 THEN 'unavailable' WHEN m BETWEEN 1 AND 5 OR m <> 7 AND (s IN (1, 2, 3, 5) OR l = 1 OR c_custkey % 37 = 1) THEN 'invalid_response' END AS error FROM c)
        SELECT c_custkey, error, CASE WHEN error IS NULL AND m <> 7 AND s <> 4 AND l <> 3 AND c_custkey % 29 <> 1 AND c_custkey % 31 <> 1 THEN CASE l WHEN 2 THEN 'ADDRESS_CITY' ELSE 'FULL_NAME' END END AS type,
               CASE WHEN error IS NULL AND m <> 7 AND s <> 4 AND l <> 3 AND c_custkey % 29 <> 1 AND c_custkey % 31 <> 1 THEN 13 + strlen(c_name) END AS end_byte FROM e""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")).select("doc_id", F.concat(F.lit("Клиент "), "c_name").alias("text"), F.expr(replies("STRING").replace("c_custkey", "doc_id")).alias("answer"))
        said = kept(models.answers(rows).drop("answer"), "answers")
        found = models.model_candidates(models.entities_of(said), said).select("doc_id", F.inline("models"))
        return said.select("doc_id", "error").join(found, "doc_id", "left").select(F.col("doc_id").alias("c_custkey"), "error", "type", F.col("end").alias("end_byte"))

    # --- sinks ---

    part = "CAST(floor((day(ts) - 1) / 8) AS INT)"  # the events come in four parts, by day
    quoted = "'\"' || upper(event_type) || '\"'"
    several = "event_id % 3"

    @catalog.query(
        "audit_log_commits",
        f"""WITH e AS (SELECT event_id, {several} AS n, {quoted} AS type FROM events)
        SELECT '{{"request_id":"req_' || md5(CAST(event_id AS VARCHAR)) || '","operation":"detect","has_personal_data":' || (n = 2) || ',"detected_types":[' || CASE n WHEN 0 THEN '' WHEN 1 THEN type ELSE '"A",' || type END || '],"entity_count":' || n
          || ',"personal_flags":[' || CASE n WHEN 0 THEN '' WHEN 1 THEN 'false' ELSE 'false,true' END || '],"sources":[' || CASE n WHEN 0 THEN '' WHEN 1 THEN '"regex"' ELSE '"regex","rubert"' END || '],"reason_codes":[],"duration_ms":' || event_id % 50
          || ',"model_mode":"full","result":"success"}}' AS line, CAST(x.n_commits AS BIGINT) AS n_commits FROM e, (SELECT count(DISTINCT floor((day(ts) - 1) / 8)) + 1 AS n_commits FROM events) x
        UNION ALL SELECT '{{"request_id":"customer-' || c_custkey || '"}}', (SELECT count(DISTINCT floor((day(ts) - 1) / 8)) + 1 FROM events) FROM customer""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        audit_log.register(spark)
        out = folder(spark, "audit")
        entity = "named_struct('type', upper(event_type), 'sources', array('regex'), 'reasons', CAST(array() AS array<string>), 'personal', false)"
        other = "named_struct('type', 'A', 'sources', array('rubert', 'regex'), 'reasons', CAST(array() AS array<string>), 'personal', true)"
        rows = table(spark, sf_dir, "events").selectExpr("event_id AS doc_id", "event_type AS text", f"slice(array({entity}, {other}), 1, CAST({several} AS INT)) AS entities", f"{part} AS part")
        arriving = in_order(rows, F.col("part"), 4)
        said = audit.lines(audit.projected(arriving), F.concat(F.lit("req_"), F.md5(F.col("doc_id").cast("string"))), "detect", F.lit("success"), F.col("doc_id") % 50).select("line")
        for state in ("first", "again"):  # the second run has lost its checkpoint, so that all batches come again
            query = said.writeStream.format(audit_log.FORMAT).option("path", out).option("name", "events").option("checkpointLocation", folder(spark, state)).trigger(availableNow=True).start()
            query.awaitTermination()
        customers = table(spark, sf_dir, "customer").select(F.format_string('{"request_id":"customer-%d"}', "c_custkey").alias("line"))
        for _ in range(2):
            customers.write.format(audit_log.FORMAT).mode("append").option("name", "customers").save(out)
        lines = spark.read.format(audit_log.FORMAT).load(out)
        n_commits = lines.select("commit").distinct().count()
        return lines.select("line", F.lit(n_commits).cast("bigint").alias("n_commits"))

    refusal = "event_id % 7 WHEN 1 THEN 'json' WHEN 2 THEN 'blank' WHEN 3 THEN 'json'"

    @catalog.query(
        "stream_requests",
        f"SELECT event_id, CASE {refusal} END AS error, CASE WHEN event_id % 7 NOT IN (1, 2, 3) THEN event_type || ' ж' END AS text, CAST(floor((day(ts) - 1) / 8) AS INT) AS batch FROM events",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = "CASE event_id % 7 WHEN 1 THEN '{\"text\": 5}' WHEN 2 THEN '{\"text\": \" \"}' WHEN 3 THEN '[]' ELSE '{\"text\":\"' || event_type || ' ж\"}' END AS body"
        arriving = in_order(table(spark, sf_dir, "events").selectExpr("event_id", body, f"{part} AS part"), F.col("part"), 4)
        out, state, lost = folder(spark, "requests"), folder(spark, "state"), []

        def fail_once(batch: int) -> None:
            if batch == 1 and not lost:
                lost.append(batch)
                raise RuntimeError("the driver is lost after the rows are written and before the batch counts")

        try:
            requests.serve(arriving, out, state, ("text",), then=fail_once).awaitTermination()
        except StreamingQueryException:
            requests.serve(arriving, out, state, ("text",), then=fail_once).awaitTermination()
        return requests.served(spark, out, "event_id long, part int, text string", None).select("event_id", "error", "text", "batch")
