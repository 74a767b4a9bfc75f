"""Queries of tokens, requests, states, models, audit and alerts: what runs around detection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.catalog import Catalog
from maskwright.functions import checks
from maskwright.functions.crypto import slot_token_sql, token_sql
from maskwright.functions.dialect import DUCK, SPARK
from maskwright.functions.rules import BY_NAME
from maskwright.functions.spans import rule_spans_sql
from maskwright.operators import alerts, audit, inference, process, runtime, scoring, tokens, vault, windows
from maskwright.operators import entities as E
from maskwright.operators.ranks import nearest_rank
from maskwright.plans import entity_sql as S
from maskwright.plans.detection import spans, texts, texts_sql
from maskwright.plans.entity_queries import _models_ctes, _with_models, model_rows
from maskwright.plans.other_queries import BUCKETS, KEY, owned_docs
from maskwright.sources import corpus, requests
from maskwright.sources.models import model_candidates
from maskwright.sources.shared import kept
from maskwright.sources.synthetic import load_pool, ru_docs_sql
from maskwright.sources.tables import table
from maskwright.streaming.process import process_stream

TTL_DAYS = 2
HIDDEN = "(personal OR (review AND NOT contains(reasons, 'type_disabled_by_policy')))"


class WordPredictor:
    """A stand-in for a model, fast enough for tests: words are tokens, some of them are entities."""

    model, capacity = "words", 48

    def tokens(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(r"[^ \t\n\r\f\v]+", text)]

    def infer(self, found: list[str]) -> list[list[tuple[str, int, int, float]]]:
        return [[("WORD", *m.span(), 0.75) for m in re.finditer(r"[^ \t\n\r\f\v]+", t) if re.fullmatch(r"[Tt]h[ae]t?[.,]?", m[0])] for t in found]


class PickyPredictor(WordPredictor):
    """One that fails on texts with a word, to show what becomes of their documents."""

    model = "picky"

    def infer(self, found: list[str]) -> list[list[tuple[str, int, int, float]]]:
        if any(re.search(r"(?<!\S)le(?!\S)", t) for t in found):
            raise RuntimeError("model failure")
        return super().infer(found)


OVERLAP = 8
_STEP = WordPredictor.capacity - OVERLAP


def _spans_of(doc: DataFrame) -> DataFrame:
    """Texts of three parts with the spans that a detector might give, right and wrong, by key."""
    name = "CAST(octet_length(c_name) AS BIGINT)"
    entity = lambda kind, a, b, personal, conf="1.0D": f"named_struct('type', '{kind}', 'start', CAST({a} AS BIGINT), 'end', CAST({b} AS BIGINT), 'confidence', {conf}, 'score', 0.9D, 'owner_type', 'PERSON', 'owner_id', 'person-1', 'sources', array('regex'), 'parts', CAST(array() AS array<string>), 'reasons', CAST(array() AS array<string>), 'personal', {personal})"
    whole, tail = f"2 + {name}", f"octet_length(text) - octet_length(c_mktsegment)"
    cases = (
        [entity("LAST_NAME", "2", "10", "true"), entity("FULL_NAME", "2", whole, "true", "0.9D"), entity("CARDHOLDER_NAME", "2", whole, "true", "0.5D")], [entity("FULL_NAME", "2", "10", "true"), entity("LAST_NAME", "6", "14", "true")],
        [entity("FULL_NAME", "1", "5", "true")], [entity("FULL_NAME", "2", whole, "true"), entity("CITY", tail, "octet_length(text)", "true"), entity("CITY", tail, "octet_length(text) - 1", "false")], [entity("FULL_NAME", "2", whole, "false")],
    )
    case = "CASE c_custkey % 5 " + " ".join(f"WHEN {i} THEN array({', '.join(c)})" for i, c in enumerate(cases)) + " END"
    rows = doc.select("c_custkey", "c_name", "c_mktsegment", F.expr("'ж' || c_name || 'я' || c_mktsegment").alias("text"))
    return rows.select(F.col("c_custkey").cast("bigint").alias("doc_id"), F.concat(F.lit("s"), (F.col("c_custkey") % 3).cast("string")).alias("scope"), "text", F.expr(case).alias("entities"))


def _requests(orders: DataFrame) -> DataFrame:
    status = F.col("o_orderstatus")
    payload = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<"), F.upper(status), F.lit(">"))).otherwise(status)
    ended = F.expr("CASE WHEN o_orderkey % 8 < 3 THEN 'unavailable' WHEN o_orderkey % 8 = 3 THEN 'error' WHEN o_orderkey % 8 = 4 THEN 'vault' ELSE 'ok' END")
    return orders.select(F.col("o_custkey").cast("bigint").alias("payload_id"), F.col("o_orderkey").cast("bigint").alias("seq"), payload.alias("payload"), ended.alias("model_status"))


def _answers_sql(degraded: bool) -> str:
    """The state machine as a recursion over each id's requests."""
    status = "CASE WHEN status = 'unavailable' THEN CASE WHEN seq % 4 = 0 THEN 'error' ELSE 'degraded' END ELSE status END" if degraded else "status"
    failed = "CASE n.status WHEN 'unavailable' THEN 'model_unavailable' WHEN 'vault' THEN 'vault_unavailable' ELSE 'masking_failed' END"
    new = "(s.k = 0 OR s.state = 'failed:model_unavailable' AND n.payload = s.original)"
    works = "n.status IN ('ok', 'degraded')"
    mask = "CASE WHEN n.status = 'degraded' THEN '[' || n.payload || ']' ELSE '<' || upper(n.payload) || '>' END"
    return f"""WITH RECURSIVE q AS (
          SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN '<' || upper(o_orderstatus) || '>' ELSE o_orderstatus END AS payload,
                 CASE WHEN o_orderkey % 8 < 3 THEN 'unavailable' WHEN o_orderkey % 8 = 3 THEN 'error' WHEN o_orderkey % 8 = 4 THEN 'vault' ELSE 'ok' END AS status FROM orders),
        n AS (SELECT id, seq, payload, {status} AS status, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM q),
        s AS (
          SELECT DISTINCT id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS original, CAST(NULL AS VARCHAR) AS result, CAST('' AS VARCHAR) AS state, CAST('' AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS reply FROM n
          UNION ALL
          SELECT s.id, n.k, n.seq, CASE WHEN {new} THEN n.payload ELSE s.original END, CASE WHEN {new} AND {works} THEN {mask} ELSE s.result END,
                 CASE WHEN {new} THEN CASE WHEN {works} THEN 'ready' ELSE 'failed:' || {failed} END ELSE s.state END,
                 CASE WHEN {new} THEN CASE n.status WHEN 'ok' THEN 'masked' WHEN 'degraded' THEN 'degraded' ELSE {failed} END
                      WHEN s.state = 'ready' THEN CASE n.payload WHEN s.original THEN 'stored' WHEN s.result THEN 'restored' ELSE 'conflict' END
                      WHEN n.payload = s.original THEN replace(s.state, 'failed:', '') ELSE 'conflict' END,
                 CASE WHEN {new} THEN CASE WHEN {works} THEN {mask} END WHEN s.state = 'ready' THEN CASE n.payload WHEN s.original THEN s.result WHEN s.result THEN s.original END END
          FROM s JOIN n ON n.id = s.id AND n.k = s.k + 1),
        answered AS (SELECT id AS payload_id, seq, outcome, reply, state FROM s WHERE k > 0)"""


def _log(events: DataFrame) -> DataFrame:
    """A request log out of the events: what each one counts as."""
    return events.select("ts", "event_id", "event_type", "user_id", "value")


_COUNTS = {
    "requests": "true", "errors": "event_type = 'error' AND user_id % 7 = 0", "rejected": "event_type = 'click' AND user_id % 9 = 0", "unauthorized": "event_type = 'view'", "model_calls": "event_type IN ('view', 'signup')",
    "model_failed": "event_type = 'signup' AND user_id % 3 = 0", "llm_calls": "event_type = 'purchase'", "llm_failed": "event_type = 'purchase' AND user_id % 4 = 0",
}
_STEP_S = 300


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(alerts.grid(_log(table(spark, sf_dir, "events")), {n: F.expr(t).cast("int") for n, t in _COUNTS.items()}, _STEP_S), "steps")


_STEPS_SQL = f"""c AS (SELECT CAST(ceil(epoch_us(ts) / ({_STEP_S} * 1000000)) * {_STEP_S} AS BIGINT) AS t, {', '.join(f'count(*) FILTER ({t}) AS {n}' for n, t in _COUNTS.items())} FROM events GROUP BY 1),
        steps AS (SELECT g.t, {', '.join(f'coalesce(c.{n}, 0) AS {n}' for n in _COUNTS)} FROM (SELECT unnest(range((SELECT min(t) FROM c), (SELECT max(t) FROM c) + 1, {_STEP_S})) AS t) g LEFT JOIN c ON c.t = g.t)"""


def _ratio_sql(part: str, whole: str, seconds: int) -> str:
    over = f"OVER (ORDER BY t RANGE BETWEEN {seconds - 1} PRECEDING AND CURRENT ROW)"
    return f"(sum({part}) {over} / nullif(sum({whole}) {over}, 0))"


def _held_sql(source: str, test: str, seconds: int) -> str:
    """(t, firing) of a test over steps: the length of the current run of true steps, by a join with the last false one."""
    return f"""SELECT t, good AND t - (SELECT min(b.t) FROM ({source}) b WHERE b.t <= a.t AND b.t > coalesce(a.last_bad, -1)) >= {seconds} AS firing
        FROM (SELECT t, {test} AS good, max(CASE WHEN NOT coalesce({test}, false) THEN t END) OVER (ORDER BY t) AS last_bad FROM ({source})) a"""


def register(catalog: Catalog) -> None:
    base = S.entities(f"(SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {ru_docs_sql()})")
    valued = f"{base}, v AS (SELECT doc_id, 's' || (doc_id % 3) AS scope, type, start_byte, substr(text, cstart + 1, cend - cstart) AS original FROM entities JOIN texts USING (doc_id) WHERE {HIDDEN})"

    # --- checks, context ---

    @catalog.query("luhn_lineitem", f"SELECT l_orderkey, l_linenumber, {checks.luhn(DUCK, 'v')} AS valid FROM (SELECT *, lpad(CAST(l_orderkey AS VARCHAR), 8, '4') || lpad(CAST(l_partkey AS VARCHAR), 7, '2') || CAST(l_linenumber AS VARCHAR) AS v FROM lineitem)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("lpad(CAST(l_orderkey AS STRING), 8, '4') || lpad(CAST(l_partkey AS STRING), 7, '2') || CAST(l_linenumber AS STRING)").alias("v"))
        return rows.select("l_orderkey", "l_linenumber", F.expr(checks.luhn(SPARK, "v")).alias("valid"))

    modelled = f"WITH RECURSIVE mtexts AS {texts_sql()}, mcards AS ({rule_spans_sql(BY_NAME['card'], 'mtexts')}), {_models_ctes()}, {S.classified(texts_sql(), 'models')}"

    def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _with_models(spark, sf_dir)
        both = F.concat("candidates", F.coalesce("models", F.expr(f"CAST(array() AS array<{E.CANDIDATE}>)")))
        found = E.classify(E.in_line(E.with_candidates(docs).withColumn("candidates", both)))
        rows = found.select("doc_id", F.explode_outer("classified").alias("c")).where("c is not null")
        return rows.select("doc_id", "c.type", F.col("c.start").alias("start_byte"), F.col("c.end").alias("end_byte"), "c.confidence", F.array_join("c.sources", ",").alias("sources"))

    for name, test in (("classify_dates", "type IN ('BIRTH_DATE', 'PASSPORT_ISSUE_DATE')"), ("classify_locations", "type IN ('BIRTH_PLACE', 'ADDRESS')"), ("exact_duplicate_merge", "sources LIKE '%,%' AND sources <> 'regex,validator'")):
        catalog.query(name, f"{modelled} SELECT doc_id, type, start_byte, end_byte, confidence, sources FROM classified WHERE {test}")(lambda spark, sf_dir, t=test: classified(spark, sf_dir).where(t))

    @catalog.query(
        "drop_contained_addresses",
        f"""{modelled} SELECT r.doc_id, r.start_byte, r.end_byte FROM retyped r WHERE r.type = 'ADDRESS' AND NOT EXISTS (SELECT 1 FROM classified c WHERE c.doc_id = r.doc_id AND c.type = 'ADDRESS' AND c.start_byte = r.start_byte AND c.end_byte = r.end_byte)""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        from maskwright.functions.phrases import promoted_type

        both = F.concat("candidates", F.coalesce("models", F.expr(f"CAST(array() AS array<{E.CANDIDATE}>)")))
        found = kept(E.classify(E.in_line(E.with_candidates(_with_models(spark, sf_dir)).withColumn("candidates", both))).select("doc_id", "candidates", "classified"), "classified")
        promoted = f"transform(filter(candidates, c -> {promoted_type(SPARK, 'c.type', 'c.left60')} = 'ADDRESS'), c -> named_struct('s', c.start, 'e', c.end))"
        gone = f"filter({promoted}, a -> NOT exists(classified, c -> c.type = 'ADDRESS' AND c.start = a.s AND c.end = a.e))"
        rows = found.select("doc_id", F.explode_outer(F.expr(gone)).alias("a")).where("a is not null")
        return rows.select("doc_id", F.col("a.s").alias("start_byte"), F.col("a.e").alias("end_byte"))

    @catalog.query("negated_context", f"SELECT doc_id, {E.present(DUCK, 'low', E.POSITIVE)} AS said, {E.present_not_negated(DUCK, 'low', E.POSITIVE)} AS holds FROM (SELECT doc_id, lower(text) AS low FROM {ru_docs_sql()})")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        from maskwright.sources.synthetic import ru_docs

        rows = ru_docs(spark, sf_dir).select("doc_id", F.lower("text").alias("low"))
        return rows.select("doc_id", F.expr(E.present(SPARK, "low", E.POSITIVE)).alias("said"), F.expr(E.present_not_negated(SPARK, "low", E.POSITIVE)).alias("holds"))

    full = S.entities(texts_sql(), models="models").replace("WITH RECURSIVE ", f"WITH RECURSIVE mtexts AS {texts_sql()}, mcards AS ({rule_spans_sql(BY_NAME['card'], 'mtexts')}), {_models_ctes()}, ", 1)

    @catalog.query("detect_all", f"{full} SELECT t.doc_id, count(e.type) AS n_entities, count(*) FILTER (e.personal) AS n_personal, coalesce(bool_or(e.personal), false) AS has_personal_data FROM texts t LEFT JOIN entities e ON e.doc_id = t.doc_id GROUP BY t.doc_id")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = E.detect(_with_models(spark, sf_dir), models="models")
        return found.select("doc_id", F.size("entities").cast("bigint").alias("n_entities"), F.size(F.filter("entities", lambda e: e["personal"])).cast("bigint").alias("n_personal"), F.exists("entities", lambda e: e["personal"]).alias("has_personal_data"))

    # --- tokens and vault ---

    asked = "SELECT event_id, 's' || (user_id % 5) AS scope, upper(event_type) AS type, 'v' || user_id AS value, ts AS asked FROM events"
    seed_sql = "unhex(md5(scope || '|' || type || '|' || value || '|' || strftime(slot_at, '%Y-%m-%d %H:%M:%S.%f')))"

    @catalog.query(
        "token_slots",
        f"""WITH RECURSIVE r AS ({asked}), g AS (SELECT scope, type, value, list(asked ORDER BY asked) AS ats FROM r GROUP BY ALL),
        k AS (SELECT scope, type, value, ats, ats[1] AS slot_at FROM g UNION ALL
              SELECT scope, type, value, ats, nxt FROM (SELECT *, list_filter(ats, lambda x: x >= slot_at + INTERVAL {TTL_DAYS} DAY)[1] AS nxt FROM k) WHERE nxt IS NOT NULL)
        SELECT event_id, strftime(slot_at, '%Y-%m-%d %H:%M:%S.%f') AS slot_at, {slot_token_sql(DUCK, KEY, seed_sql, 'scope', 'type', 'value')} AS token
        FROM (SELECT r.event_id, r.scope, r.type, r.value, k.slot_at FROM r ASOF JOIN k ON r.scope = k.scope AND r.type = k.type AND r.value = k.value AND r.asked >= k.slot_at)""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select("event_id", *[F.expr(x) for x in ("'s' || CAST(user_id % 5 AS STRING) AS scope", "upper(event_type) AS type", "'v' || CAST(user_id AS STRING) AS value", "ts AS at")])
        when = F.date_format("slot_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        issued, _ = tokens.issue(rows, KEY, TTL_DAYS * 86400, F.unhex(F.md5(F.concat_ws("|", "scope", "type", "value", when))))
        return issued.select("event_id", when.alias("slot_at"), "token")

    mapped = f"SELECT 's' || (user_id % 5) AS scope, 't' || user_id || event_type AS token, max(ts) + INTERVAL {TTL_DAYS} DAY AS expires_at FROM events GROUP BY ALL"

    def expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events").select(*[F.expr(x) for x in ("'s' || CAST(user_id % 5 AS STRING) AS scope", "'t' || CAST(user_id AS STRING) || event_type AS token", "ts")])
        return events.groupBy("scope", "token").agg((F.max("ts") + F.expr(f"INTERVAL {TTL_DAYS} DAY")).alias("expires_at"))

    now = lambda: F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'")

    @catalog.query("vault_live_count", f"SELECT scope, count(*) AS n FROM ({mapped}) WHERE expires_at > TIMESTAMP '2024-01-30 12:00:00' GROUP BY scope")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tokens.live(expiring(spark, sf_dir), now()).groupBy("scope").agg(F.count("*").alias("n"))

    @catalog.query("sweep_expired", f"SELECT scope, token FROM ({mapped}) WHERE expires_at <= TIMESTAMP '2024-01-30 12:00:00' ORDER BY expires_at, scope, token LIMIT 64")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tokens.next_to_expire(expiring(spark, sf_dir), now()).select("scope", "token")

    @catalog.query(
        "vault_tamper_detected",
        "SELECT c_custkey, CASE WHEN c_custkey % 5 > 1 THEN c_name END AS original, CASE c_custkey % 5 WHEN 0 THEN 'corrupted' WHEN 1 THEN 'not_found' END AS error FROM customer",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("scope"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"), F.col("c_name").alias("original"))
        sealed = vault.sealed_vault(rows.where("c_custkey % 5 <> 1"), KEY)
        touched = F.sha2(F.concat(F.lit("t"), F.col("_k").cast("string")), 256)
        bad = rows.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("_k")).select(touched.alias("token_digest"), F.lit(True).alias("_bad"))
        sealed = sealed.join(bad, "token_digest", "left").withColumn("sealed", F.when(F.col("_bad"), F.reverse(F.hex("sealed")).cast("binary")).otherwise(F.col("sealed"))).drop("_bad")
        return vault.resolve_sealed(rows.drop("original"), sealed, KEY).select("c_custkey", "original", "error")

    @catalog.query(
        "token_sequence_match",
        f"{valued}, n AS (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id) SELECT t.doc_id, coalesce(n.n, 0) = 0 OR t.doc_id % 4 IN (0, 3) AS matches FROM texts t LEFT JOIN n USING (doc_id)",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vault.tokenize(owned_docs(spark, sf_dir), KEY)
        got = F.expr(f"CASE doc_id % 4 WHEN 0 THEN 'OK ' || tokenized WHEN 1 THEN regexp_replace(tokenized, r'{tokens.TOKEN}', '', 1) WHEN 2 THEN tokenized || tokenized ELSE tokenized END".replace(", '', 1)", ", '')"))
        return rows.select("doc_id", tokens.tokens_match(F.col("tokenized"), got).alias("matches"))

    @catalog.query(
        "detokenize_preserve",
        f"""{valued}, p AS (SELECT doc_id, {token_sql(DUCK, KEY, 'scope', 'type', 'original')} AS token, min(start_byte) AS first_ FROM v WHERE type = 'PHONE' GROUP BY ALL),
        cuts AS (SELECT e.doc_id, cstart, cend, {token_sql(DUCK, KEY, "('s' || (e.doc_id % 3))", 'type', 'substr(text, cstart + 1, cend - cstart)')} AS token, text, lag(cend, 1, 0) OVER (PARTITION BY e.doc_id ORDER BY cstart) AS last_end FROM entities e JOIN texts USING (doc_id) WHERE {HIDDEN} AND type = 'PHONE'),
        left_ AS (SELECT doc_id, string_agg(substr(text, last_end + 1, cstart - last_end) || token, '' ORDER BY cstart) || substr(any_value(text), max(cend) + 1) AS restored FROM cuts GROUP BY doc_id),
        u AS (SELECT doc_id, count(*) AS n, string_agg(token, ',' ORDER BY first_) AS unresolved FROM p GROUP BY doc_id),
        k AS (SELECT doc_id, count(DISTINCT (type, original)) AS n FROM v WHERE type <> 'PHONE' GROUP BY doc_id)
        SELECT t.doc_id, coalesce(l.restored, t.text) AS restored, coalesce(u.n, 0) AS n_unresolved, coalesce(k.n, 0) AS n_resolved, coalesce(u.unresolved, '') AS unresolved
        FROM texts t LEFT JOIN left_ l USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN k USING (doc_id)""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        owned = owned_docs(spark, sf_dir)
        return vault.detokenize(vault.tokenize(owned, KEY), vault.mappings(owned, KEY).where("type <> 'PHONE'")).withColumn("unresolved", F.array_join("unresolved", ","))

    token = "'<' || e.type || ':' || {value} || '>'"

    @catalog.query(
        "replace_checked",
        """SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'ж<CARDHOLDER_NAME:' || c_name || '>я' || c_mktsegment WHEN 3 THEN 'ж<FULL_NAME:' || c_name || '>я<CITY:' || c_mktsegment || '>' WHEN 4 THEN 'ж' || c_name || 'я' || c_mktsegment END AS tokenized,
               CASE c_custkey % 5 WHEN 1 THEN 'partial_overlap' WHEN 2 THEN 'invalid_span' END AS error, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 0 END AS n_replaced FROM customer""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tokens.replace_spans(_spans_of(table(spark, sf_dir, "customer")), token).select("doc_id", "tokenized", "error", F.size("replacements").alias("n_replaced"))

    named = "'<' || e.type || '_' || lower(md5({value})) || '>'"
    held = "c_custkey % 7 = 0"

    def persisted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        customer = table(spark, sf_dir, "customer")
        old = customer.where(held).select(F.expr("'s' || CAST(c_custkey % 3 AS STRING)").alias("scope"), F.expr("'<FULL_NAME_' || md5(c_name) || '>'").alias("token"), F.lit("another").alias("original"))
        return tokens.persist(tokens.replace_spans(_spans_of(customer), named), old)

    @catalog.query(
        "persist_all_or_nothing",
        f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'ж<CARDHOLDER_NAME_' || md5(c_name) || '>я' || c_mktsegment WHEN c_custkey % 5 = 3 AND NOT {held} THEN 'ж<FULL_NAME_' || md5(c_name) || '>я<CITY_' || md5(c_mktsegment) || '>' WHEN c_custkey % 5 = 4 THEN 'ж' || c_name || 'я' || c_mktsegment END AS tokenized,
               CASE WHEN c_custkey % 5 = 1 THEN 'partial_overlap' WHEN c_custkey % 5 = 2 THEN 'invalid_span' WHEN c_custkey % 5 = 3 AND {held} THEN 'conflict' END AS error FROM customer""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return persisted(spark, sf_dir)[0].select("doc_id", "tokenized", "error")

    @catalog.query(
        "persisted_mappings",
        f"""SELECT scope, original, count(*) AS n FROM (SELECT DISTINCT * FROM (
          SELECT 's' || (c_custkey % 3) AS scope, 'CARDHOLDER_NAME' AS type, c_name AS original FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 's' || (c_custkey % 3), 'FULL_NAME', c_name FROM customer WHERE c_custkey % 5 = 3 AND NOT {held}
          UNION ALL SELECT 's' || (c_custkey % 3), 'CITY', c_mktsegment FROM customer WHERE c_custkey % 5 = 3 AND NOT {held})) GROUP BY ALL""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return persisted(spark, sf_dir)[1].groupBy("scope", "original").agg(F.count("*").alias("n"))

    # --- requests and states ---

    @catalog.query(
        "request_errors",
        """SELECT c_custkey, CASE c_custkey % 9 WHEN 1 THEN 'json' WHEN 2 THEN 'json' WHEN 3 THEN 'blank' WHEN 4 THEN 'blank' WHEN 5 THEN 'json' WHEN 6 THEN 'encoding' WHEN 7 THEN 'too_large' END AS error,
               CASE WHEN c_custkey % 9 IN (0, 8) THEN c_name END AS text, CASE WHEN c_custkey % 9 = 8 THEN c_mktsegment END AS scope_id FROM customer""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        good = """'{"text": "' || c_name || '"'"""
        body = f"""CASE c_custkey % 9 WHEN 0 THEN encode({good} || '}}', 'UTF-8') WHEN 1 THEN encode({good} || '}} {{}}', 'UTF-8') WHEN 2 THEN encode('["' || c_name || '"]', 'UTF-8') WHEN 3 THEN encode('{{"other": "x"}}', 'UTF-8')
            WHEN 4 THEN encode('{{"text": " \\\\u00a0\\\\t"}}', 'UTF-8') WHEN 5 THEN encode('{{"text": 5}}', 'UTF-8') WHEN 6 THEN concat(encode('{{"text": "', 'UTF-8'), X'C328', encode('"}}', 'UTF-8'))
            WHEN 7 THEN encode('{{"text": "' || repeat('x', 300) || '"}}', 'UTF-8') ELSE encode({good} || ', "scope_id": "' || c_mktsegment || '", "more": [1]}}', 'UTF-8') END"""
        rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(body).alias("body"))
        return requests.decoded(rows, ("text",), ("scope_id",), most_bytes=256).select("c_custkey", "error", "text", "scope_id")

    mask = lambda: F.concat(F.lit("<"), F.upper("payload"), F.lit(">"))

    def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = process.with_fallback(_requests(table(spark, sf_dir, "orders")), True, F.when(F.col("seq") % 4 == 0, "error").otherwise("ok"))
        return process.answers(asked, mask(), rules_only=F.concat(F.lit("["), F.col("payload"), F.lit("]")))

    @catalog.query("process_state_transitions", f"{_answers_sql(False)} SELECT payload_id, seq, outcome, reply, state FROM answered")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return process.answers(_requests(table(spark, sf_dir, "orders")), mask())

    @catalog.query("process_conflicts", f"{_answers_sql(False)} SELECT payload_id, arg_max(state, seq) AS state, count(*) AS n, count(*) FILTER (outcome = 'conflict') AS conflicts FROM answered GROUP BY payload_id")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return process.final_states(process.answers(_requests(table(spark, sf_dir, "orders")), mask()))

    @catalog.query("degraded_fallback", f"{_answers_sql(True)} SELECT payload_id, seq, outcome, reply, state FROM answered")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return degraded(spark, sf_dir)

    @catalog.query("stream_process_failures", f"{_answers_sql(False)} SELECT payload_id, seq, outcome, reply FROM answered")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        from maskwright.sources.shared import folder

        root = sf_dir.rstrip("/")
        orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(root)
        out = folder(spark, "answers")
        query = process_stream(_requests(orders), lambda x: f"<{x.upper()}>").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(f"{out}/rows")

    @catalog.query(
        "protected_flow",
        f"""{valued}, n AS (SELECT doc_id, count(*) AS n, bool_or(type = 'EMAIL') AS mail FROM v GROUP BY doc_id), o AS (SELECT t.doc_id, t.text, coalesce(n.n, 0) AS n, coalesce(mail, false) AS mail FROM texts t LEFT JOIN n USING (doc_id)),
        f AS (SELECT *, CASE WHEN doc_id % 5 = 4 THEN 'transform' WHEN doc_id % 5 IN (1, 2) AND n > 0 THEN 'transform' WHEN mail THEN 'restore' END AS failed FROM o)
        SELECT doc_id, CASE WHEN failed IS NULL THEN CASE doc_id % 5 WHEN 0 THEN 'Ответ: ' || text WHEN 2 THEN text || text ELSE text END END AS result, failed FROM f""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        owned = owned_docs(spark, sf_dir)
        stored = vault.mappings(owned, KEY).where("type <> 'EMAIL'")
        answer = F.expr(f"CASE doc_id % 5 WHEN 0 THEN 'Ответ: ' || tokenized WHEN 1 THEN regexp_replace(tokenized, r'{tokens.TOKEN}', '') WHEN 2 THEN tokenized || tokenized WHEN 4 THEN NULL ELSE tokenized END")
        return runtime.run(owned, lambda d: vault.tokenize(d, KEY), lambda d: d.withColumn("answer", answer), lambda d: vault.detokenize(d, stored, text="answer"))

    # --- quality ---

    truth = f"{base}, p AS (SELECT DISTINCT doc_id, type, start_byte, end_byte FROM entities WHERE personal)"

    @catalog.query(
        "hard_negative_fp",
        f"{truth}, g AS (SELECT * FROM p WHERE doc_id % 10 <> 0), neg AS (SELECT * FROM p WHERE doc_id % 20 = 0), f AS (SELECT p.type, g.doc_id IS NOT NULL AS ing, neg.doc_id IS NOT NULL AS inn FROM p LEFT JOIN g USING (doc_id, type, start_byte, end_byte) LEFT JOIN neg USING (doc_id, type, start_byte, end_byte)) SELECT type, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT ing AND inn) AS fp_on_hard_negative, count(*) FILTER (ing) > 0 AS recall_defined, true AS precision_defined FROM f GROUP BY type",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = E.rows(owned_docs(spark, sf_dir)).where("personal").select(F.col("doc_id").alias("case_id"), "type", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
        return scoring.detection_metrics(found.where("case_id % 10 <> 0"), found, found.where("case_id % 20 = 0")).select("type", "fp", "fp_on_hard_negative", "recall_defined", "precision_defined").orderBy("type")

    cuts = f"cuts AS (SELECT doc_id, cstart, cend, type, lag(cend, 1, 0) OVER (PARTITION BY doc_id ORDER BY cstart) AS last_end FROM entities WHERE personal), m AS (SELECT doc_id, string_agg(substr(text, last_end + 1, cstart - last_end) || '<' || type || '>', '' ORDER BY cstart) || substr(any_value(text), max(cend) + 1) AS masked FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id)"

    @catalog.query(
        "restoration_rate",
        f"{valued}, {cuts}, k AS (SELECT DISTINCT doc_id FROM v WHERE doc_id % 3 = 0), q AS (SELECT t.doc_id, length(coalesce(m.masked, t.text)) AS n, k.doc_id IS NULL AS exact FROM texts t LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)) SELECT count(*) AS n_cases, round(avg(CASE WHEN doc_id % 2 = 0 THEN 1 - 1 / (n + 1) ELSE 1 END), 6) AS masking_quality, round(avg(CAST(exact AS INTEGER)), 6) AS restoration_exact_rate FROM q",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        owned = owned_docs(spark, sf_dir)
        back = vault.detokenize(vault.tokenize(owned, KEY), vault.mappings(owned, KEY).where("scope <> 's0'"), strict=True).select("doc_id", "restored")
        cases = E.masked(owned).select("doc_id", F.col("text").alias("input"), "masked", F.expr("masked || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END").alias("expected_mask"))
        return scoring.corpus_quality(cases.join(back, "doc_id", "left"))

    @catalog.query(
        "corpus_validation",
        "SELECT CASE WHEN c_custkey % 8 = 4 THEN '' ELSE 'c' || c_custkey END AS id, CASE c_custkey % 8 WHEN 1 THEN 'bounds' WHEN 2 THEN 'value' WHEN 3 THEN 'mask_token' WHEN 4 THEN 'id' WHEN 5 THEN 'overlap' WHEN 6 THEN 'version' WHEN 7 THEN 'mask_token' END AS problem FROM customer WHERE c_custkey % 8 > 0",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        span = "named_struct('type', 'PHONE', 'start', 2, 'end', CAST(2 + octet_length(c_name) + CASE WHEN c_custkey % 8 = 1 THEN 1 ELSE 0 END AS INT), 'value', CASE WHEN c_custkey % 8 = 2 THEN 'x' ELSE c_name END, 'personal', c_custkey % 8 <> 3, 'mask_token', '<PHONE>')"
        inner = "named_struct('type', 'PHONE', 'start', 2, 'end', 4, 'value', substr(c_name, 1, 2), 'personal', true, 'mask_token', '<PHONE>')"
        columns = {
            "version": "CASE WHEN c_custkey % 8 = 6 THEN '2' ELSE '1' END", "offset_unit": "'utf8_byte'", "id": "CASE WHEN c_custkey % 8 = 4 THEN '' ELSE 'c' || CAST(c_custkey AS STRING) END", "input": "'я' || c_name",
            "expected_mask": "CASE WHEN c_custkey % 8 = 7 THEN 'я' ELSE 'я<PHONE>' END", "spans": f"CASE WHEN c_custkey % 8 = 5 THEN array({span}, {inner}) ELSE array({span}) END",
        }
        return corpus.problems(table(spark, sf_dir, "customer").select(*[F.expr(x).alias(n) for n, x in columns.items()]))

    # --- models ---

    @catalog.query(
        "model_doc_confirmation",
        f"WITH mtexts AS {texts_sql()}, mcards AS ({rule_spans_sql(BY_NAME['card'], 'mtexts')}), {_models_ctes()} SELECT doc_id, start_byte, end_byte FROM models WHERE sources = 'rubert' AND type = 'BANK_CARD_NUMBER'",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = texts(spark, sf_dir)
        found = model_candidates(model_rows(docs), docs, spans(docs, (BY_NAME["card"],)))
        rows = found.select("doc_id", F.explode("models").alias("c")).where("c.type = 'BANK_CARD_NUMBER'")
        return rows.select("doc_id", F.col("c.start").alias("start_byte"), F.col("c.end").alias("end_byte"))

    @catalog.query(
        "window_offsets",
        f"""WITH RECURSIVE h AS (SELECT doc_id, encode(text) AS b, strlen(text) AS n FROM documents),
        c AS (SELECT *, list_transform(range(0, n), lambda i: hex(b[i + 1 : i + 1])[1] IN ('8', '9', 'A', 'B')) AS inner_ FROM h WHERE n > 0),
        w AS (SELECT doc_id, 0 AS i, 0 AS s, least(400, n) - CASE WHEN n <= 400 OR NOT inner_[401] THEN 0 WHEN NOT inner_[400] THEN 1 WHEN NOT inner_[399] THEN 2 ELSE 3 END AS e FROM c
          UNION ALL SELECT doc_id, i + 1, s2, CASE WHEN s2 + 400 >= n THEN n WHEN NOT inner_[s2 + 401] THEN s2 + 400 WHEN NOT inner_[s2 + 400] THEN s2 + 399 WHEN NOT inner_[s2 + 399] THEN s2 + 398 ELSE s2 + 397 END
          FROM (SELECT w.*, c.n, c.inner_, CASE WHEN NOT inner_[e - 39] THEN e - 40 WHEN NOT inner_[e - 38] THEN e - 39 WHEN NOT inner_[e - 37] THEN e - 38 ELSE e - 37 END AS s2 FROM w JOIN c USING (doc_id) WHERE e < c.n)),
        t AS (SELECT w.doc_id, w.s, decode(b[w.s + 1 : w.e]) AS piece FROM w JOIN h USING (doc_id))
        SELECT doc_id, 'WORD' AS label, CAST(s + strlen(string_split(piece, ' the ')[1]) + 1 AS BIGINT) AS start_byte, CAST(s + strlen(string_split(piece, ' the ')[1]) + 4 AS BIGINT) AS end_byte FROM t WHERE contains(piece, ' the ')""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        cut = windows.split_windows(docs, 400, 40)
        piece = F.expr("CAST(substring(encode(text, 'UTF-8'), CAST(start_byte + 1 AS INT), CAST(end_byte - start_byte AS INT)) AS STRING)")
        found = cut.join(docs, "doc_id").withColumn("piece", piece).where("contains(piece, ' the ')")
        at = F.octet_length(F.substring_index("piece", " the ", 1)).cast("bigint")
        found = found.select("doc_id", "window", F.lit("WORD").alias("label"), (at + 1).alias("start"), (at + 4).alias("end"), F.lit(0.75).alias("confidence"), F.lit("words").alias("model"))
        return windows.global_offsets(found, cut).select("doc_id", "label", "start_byte", "end_byte")

    words = r"WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS m, string_split_regex(text, '[^ \t\n\r\f\x0B]+') AS g FROM documents),"
    placed = f"""{words} k AS (SELECT doc_id, length(text) AS n_chars, len(m) AS total, i, m[i] AS word, length(array_to_string(g[1 : i], '') || array_to_string(m[1 : i - 1], '')) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM d)),
        w AS (SELECT doc_id, n_chars, total, j, j * {_STEP} + 1 AS first, least(j * {_STEP} + {WordPredictor.capacity}, total) AS last FROM (SELECT doc_id, n_chars, total, unnest(range(0, CAST(greatest(ceil((total - {WordPredictor.capacity}) / {_STEP}), 0) AS BIGINT) + 1)) AS j FROM (SELECT DISTINCT doc_id, n_chars, total FROM k)))"""

    @catalog.query(
        "token_window_plan",
        f"""{placed} SELECT w.doc_id, CAST(w.j AS INTEGER) AS i, CAST(CASE WHEN w.j = 0 THEN 0 ELSE x.a END AS INTEGER) AS "start", CAST(CASE WHEN w.last = w.total THEN w.n_chars ELSE y.a + length(y.word) END AS INTEGER) AS "end", CAST(w.last - w.first + 1 AS INTEGER) AS tokens
        FROM w JOIN k x ON x.doc_id = w.doc_id AND x.i = w.first JOIN k y ON y.doc_id = w.doc_id AND y.i = w.last""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inference.plan_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), WordPredictor(), OVERLAP)[1]

    hits = f"SELECT k.doc_id, 'WORD' AS label, CAST(k.a AS INTEGER) AS start_cp, CAST(k.a + length(k.word) AS INTEGER) AS end_cp, 0.75::DOUBLE AS confidence, 'words' AS model FROM w JOIN k ON k.doc_id = w.doc_id AND k.i BETWEEN w.first AND w.last WHERE regexp_full_match(k.word, '[Tt]h[ae]t?[.,]?')"

    @catalog.query("window_inference", f"{placed} {hits}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inference.in_model_order(inference.infer_bounded(table(spark, sf_dir, "documents").select("doc_id", "text"), WordPredictor(), OVERLAP)[0])

    @catalog.query(
        "distinct_inference",
        f"{placed}, hits AS ({hits}), bad AS (SELECT DISTINCT doc_id FROM k WHERE word = 'le'), both_ AS (SELECT * FROM hits UNION ALL SELECT * REPLACE ('picky' AS model) FROM hits) SELECT b.doc_id, b.model, count(*) AS n FROM both_ b WHERE b.doc_id NOT IN (SELECT doc_id FROM bad) GROUP BY ALL",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        both = [inference.once_per_text(docs, lambda d, p=p: inference.infer_bounded(d, p, OVERLAP)) for p in (WordPredictor(), PickyPredictor())]
        return inference.concat(*both)[0].groupBy("doc_id", "model").agg(F.count("*").alias("n"))

    @catalog.query("token_limit_check", rf"SELECT doc_id, n AS n_tokens, CASE WHEN n > 300 THEN 'token_limit' END AS error FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS BIGINT) AS n FROM documents)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        counted = inference.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), WordPredictor())
        return counted.withColumn("error", inference.limit_error(F.col("n_tokens"), 300))

    # --- audit, load, alerts ---

    distinct = lambda c, x: f"list_sort(list_distinct(list({x}) FILTER ({x} <> ''))) AS {c}"
    quoted = lambda c: f"'[' || array_to_string(list_transform({c}, lambda x: '\"' || x || '\"'), ',') || ']'"

    @catalog.query(
        "audit_lines",
        f"""{base}, t AS (SELECT doc_id, list_sort(list_distinct(list(type))) AS types, count(*) AS n, list(personal ORDER BY start_byte, end_byte, type) AS flags, bool_or(personal) AS has FROM entities GROUP BY doc_id),
        s AS (SELECT doc_id, {distinct('sources', 'x')} FROM (SELECT doc_id, unnest(string_split(sources, ',')) AS x FROM entities) GROUP BY doc_id), r AS (SELECT doc_id, {distinct('reasons', 'x')} FROM (SELECT doc_id, unnest(string_split(reasons, ',')) AS x FROM entities) GROUP BY doc_id)
        SELECT d.doc_id, '{{"request_id":"req_' || md5(CAST(d.doc_id AS VARCHAR)) || '","operation":"detect","has_personal_data":' || coalesce(has, false) || ',"detected_types":' || coalesce({quoted('types')}, '[]') || ',"entity_count":' || coalesce(n, 0) || ',"personal_flags":[' || coalesce(array_to_string(flags, ','), '')
          || '],"sources":' || coalesce({quoted('sources')}, '[]') || ',"reason_codes":' || coalesce({quoted('reasons')}, '[]') || ',"duration_ms":' || (d.doc_id % 50) || ',"model_mode":"fast","result":"success"}}' AS line
        FROM texts d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = audit.projected(owned_docs(spark, sf_dir))
        return audit.lines(rows, F.concat(F.lit("req_"), F.md5(F.col("doc_id").cast("string"))), "detect", F.lit("success"), F.col("doc_id") % 50, "fast")

    @catalog.query("load_pool", "SELECT 'load-' || o_orderkey AS payload_id, 'Клиент Тестов Тест Тестович, телефон +7 900 123-45-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || ', email test' || o_orderkey || '@example.com' AS payload FROM orders")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return load_pool(table(spark, sf_dir, "orders"), "o_orderkey")

    @catalog.query(
        "target_met",
        "SELECT event_type, count(*) AS completed, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS achieved_rate, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.99) <= 100.0 AS target_met FROM events GROUP BY event_type",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events")
        micros = lambda f: F.unix_micros(f("ts").cast("timestamp"))
        rate = events.groupBy("event_type").agg(F.count("*").alias("completed"), F.round(F.count("*") / (micros(F.max) - micros(F.min)) * 1e6, 9).alias("achieved_rate"))
        ranks = nearest_rank(events, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
        return rate.join(ranks, "event_type").withColumn("target_met", F.col("p99") <= 100.0)

    @catalog.query("body_size_histogram", " UNION ALL ".join(f"SELECT lang, CAST({64 * 4**i} AS BIGINT) AS le, count(*) FILTER (strlen(coalesce(text, '')) <= {64 * 4**i}) AS n FROM documents GROUP BY lang" for i in range(10)))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        sizes = [64 * 4**i for i in range(10)]
        size = F.octet_length(F.coalesce("text", F.lit("")))
        wide = table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.count_if(size <= b).alias(f"b{i}") for i, b in enumerate(sizes)])
        return wide.select("lang", F.inline(F.array(*[F.struct(F.lit(b).cast("bigint").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(sizes)])))

    @catalog.query("outcome_counters", f"{_answers_sql(True)} SELECT coalesce(a.label, k.label) AS label, coalesce(a.n, 0) AS n FROM (SELECT unnest(['fallback_used', 'cache_hit', 'cache_miss', 'other']) AS label) k FULL JOIN (SELECT CASE outcome WHEN 'degraded' THEN 'fallback_used' WHEN 'stored' THEN 'cache_hit' WHEN 'masked' THEN 'cache_miss' ELSE 'other' END AS label, count(*) AS n FROM answered GROUP BY 1) a ON a.label = k.label")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = degraded(spark, sf_dir)
        label = F.when(F.col("outcome") == "degraded", "fallback_used").when(F.col("outcome") == "stored", "cache_hit").when(F.col("outcome") == "masked", "cache_miss").otherwise("other")
        kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("fallback_used", "cache_hit", "cache_miss", "other")))).alias("label"))
        return kinds.join(rows.groupBy(label.alias("label")).agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))

    known = ("PHONE", "EMAIL", "INN_PERSON")

    @catalog.query("entity_counters_other", f"{base} SELECT CASE WHEN type IN {known} THEN type ELSE 'other' END AS type, count(*) AS n FROM entities WHERE personal GROUP BY 1")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = E.rows(owned_docs(spark, sf_dir)).where("personal")
        return rows.groupBy(F.when(F.col("type").isin(*known), F.col("type")).otherwise("other").alias("type")).agg(F.count("*").alias("n"))

    ratios = ", ".join(f"round({_ratio_sql('errors', 'requests', s)}, 9) AS ratio_{n}" for n, s in alerts.WINDOWS.items())

    @catalog.query("ratio_windows", f"WITH {_STEPS_SQL} SELECT t, requests, errors, {ratios} FROM steps")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = alerts.ratios(_steps(spark, sf_dir))
        return rows.select("t", "requests", "errors", *[F.round(f"ratio_{n}", 9).alias(f"ratio_{n}") for n in alerts.WINDOWS])

    raw = ", ".join(f"{_ratio_sql('errors', 'requests', s)} AS ratio_{n}" for n, s in alerts.WINDOWS.items())
    test = {n: f"ratio_{a} > {f * alerts.BUDGET!r} AND ratio_{b} > {f * alerts.BUDGET!r}" for n, (a, b, f, _) in alerts.BURNS.items()}

    @catalog.query(
        "burn_rate_windows",
        f"WITH {_STEPS_SQL}, r AS (SELECT t, {raw} FROM steps) SELECT r.t, " + ", ".join(f"coalesce({n}.firing, false) AS burn_{n}" for n in alerts.BURNS) + " FROM r " + " ".join(f"JOIN ({_held_sql('SELECT * FROM r', test[n], alerts.BURNS[n][3])}) {n} ON {n}.t = r.t" for n in alerts.BURNS),
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return alerts.burn_alerts(_steps(spark, sf_dir)).select("t", *[f"burn_{n}" for n in alerts.BURNS])

    values = {n: _ratio_sql(a, b, 300) if b else f"(sum({a}) OVER (ORDER BY t RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) / 300)" for n, (a, b, _, _) in alerts.THRESHOLDS.items()}
    fired = {n: (f"value_{n} > {limit!r}", hold) for n, (_, _, limit, hold) in alerts.THRESHOLDS.items()} | {"down": ("requests = 0", 120)}

    @catalog.query(
        "threshold_alerts",
        f"WITH {_STEPS_SQL}, r AS (SELECT t, requests, " + ", ".join(f"{x} AS value_{n}" for n, x in values.items()) + " FROM steps) SELECT r.t, " + ", ".join(f"coalesce({n}.firing, false) AS alert_{n}" for n in fired) + " FROM r " + " ".join(f"JOIN ({_held_sql('SELECT * FROM r', x, hold)}) {n} ON {n}.t = r.t" for n, (x, hold) in fired.items()),
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return alerts.threshold_alerts(_steps(spark, sf_dir)).select("t", *[f"alert_{n}" for n in fired])

    counts = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(BUCKETS))

    @catalog.query(
        "latency_alert",
        f"""WITH c AS (SELECT CAST(ceil(epoch_us(ts) / 21600000000) * 21600 AS BIGINT) AS t, count(*) AS total, {counts} FROM events GROUP BY 1),
        u AS (SELECT t, total, unnest([{', '.join(f"{{'le': {b}::DOUBLE, 'low': {BUCKETS[i - 1] if i else 0.0}::DOUBLE, 'n': b{i}, 'below': {f'b{i - 1}' if i else '0'}}}" for i, b in enumerate(BUCKETS))}]) AS x FROM c),
        q AS (SELECT t, coalesce(min(x.low + (x.le - x.low) * (0.95 * total - x.below) / (x.n - x.below)) FILTER (x.n >= 0.95 * total AND x.below < 0.95 * total), {BUCKETS[-1]}) AS p95 FROM u GROUP BY t),
        r AS (SELECT g.t, q.p95 FROM (SELECT unnest(range((SELECT min(t) FROM c), (SELECT max(t) FROM c) + 1, 21600)) AS t) g LEFT JOIN q ON q.t = g.t)
        SELECT r.t, round(r.p95, 6) AS p95, coalesce(h.firing, false) AS alert_latency FROM r JOIN ({_held_sql('SELECT * FROM r', 'p95 > 60.0', 43200)}) h ON h.t = r.t""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        steps = alerts.grid(table(spark, sf_dir, "events"), {"total": F.lit(1)} | {f"b{i}": (F.col("value") <= b).cast("int") for i, b in enumerate(BUCKETS)}, 21600)
        rows = steps.withColumn("p95", alerts.quantile(0.95, "total", [f"b{i}" for i in range(len(BUCKETS))], BUCKETS))
        return alerts.holding(rows, F.col("p95") > 60.0, 43200, "alert_latency").select("t", F.round("p95", 6).alias("p95"), "alert_latency")

    gauge = "SELECT event_type AS series, CAST(ceil(epoch_us(ts) / 21600000000) * 21600 AS BIGINT) AS t, sum(value) AS value FROM events GROUP BY ALL"
    frame = lambda s: f"OVER (PARTITION BY series ORDER BY t RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)"

    @catalog.query(
        "vault_growth_alert",
        f"""WITH g AS ({gauge}), s AS (SELECT * REPLACE (CASE WHEN NOT isnan(slope) THEN slope END AS slope) FROM (SELECT *, regr_slope(value, t::DOUBLE) {frame(86400)} AS slope FROM g)), l AS (SELECT *, min(slope) {frame(43200)} AS least FROM s),
        b AS (SELECT *, count(*) FILTER (NOT coalesce(least > 0, false)) {frame(21600)} AS bad, t - min(t) OVER (PARTITION BY series) AS age FROM l)
        SELECT series, t, round(slope * 1e6, 4) AS slope, bad = 0 AND age >= 21600 AS growing FROM b""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), (F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / 21600000000) * 21600).cast("bigint").alias("t")).agg(F.sum("value").alias("value"))
        return alerts.growing(rows, 86400, 43200, hold=21600).select("series", "t", F.round(F.col("slope") * 1e6, 4).alias("slope"), "growing")
