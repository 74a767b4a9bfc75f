"""Queries of checks, tokens, scoring, requests and observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.catalog import Catalog
from maskwright.functions import checks
from maskwright.functions.crypto import seal, token_sql, unseal
from maskwright.functions.dialect import DUCK, SPARK
from maskwright.functions.registry import TYPES
from maskwright.operators import entities as E
from maskwright.operators import alerts, audit, scoring, tokens, vault, windows
from maskwright.operators.ranks import nearest_rank
from maskwright.plans import entity_sql as S
from maskwright.sources.shared import folder, kept
from maskwright.sources.synthetic import ru_docs, ru_docs_sql
from maskwright.sources.tables import table
from maskwright.streaming.process import process_stream
from maskwright.streaming.rates import error_rates, streamed

KEY = bytes(range(32))
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)


def owned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer texts (doc_id, text) with entities and scope, detected once."""
    docs = ru_docs(spark, sf_dir).select(F.col("doc_id").cast("bigint"), "text")
    return kept(E.detect(docs).withColumn("scope", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))), "owned")


def register(catalog: Catalog) -> None:
    base = S.entities(f"(SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {ru_docs_sql()})")
    hidden = "(personal OR (review AND NOT contains(reasons, 'type_disabled_by_policy')))"
    valued = f"{base}, v AS (SELECT doc_id, 's' || (doc_id % 3) AS scope, type, substr(text, cstart + 1, cend - cstart) AS original FROM entities JOIN texts USING (doc_id) WHERE {hidden})"
    digits = "lpad(CAST(o_orderkey AS STRING), 8, '4') || lpad(CAST(o_custkey AS STRING), 8, '1')"

    for name, check, what in (
        ("luhn_valid", checks.luhn, digits), ("inn_person_valid", checks.inn_person, "lpad(CAST(o_orderkey * 37 AS STRING), 12, '7')"), ("inn_org_valid", checks.inn_organization, "lpad(CAST(o_orderkey * 13 AS STRING), 10, '7')"),
        ("calendar_valid", checks.numeric_date, "lpad(CAST(o_orderkey % 40 AS STRING), 2, '0') || '.' || lpad(CAST(o_custkey % 15 AS STRING), 2, '0') || '.20' || lpad(CAST(o_orderkey % 30 AS STRING), 2, '0')"),
    ):
        def run(spark: SparkSession, sf_dir: str, check=check, what=what) -> DataFrame:
            rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(what).alias("v"))
            return rows.select("o_orderkey", "v", F.expr(check(SPARK, "v")).alias("valid"))

        catalog.query(name, f"SELECT o_orderkey, v, {check(DUCK, 'v')} AS valid FROM (SELECT o_orderkey, {what} AS v FROM orders)")(run)

    @catalog.query("token_reuse", f"{valued} SELECT scope, type, original, {token_sql(DUCK, KEY, 'scope', 'type', 'original')} AS token FROM v GROUP BY ALL")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vault.mappings(owned_docs(spark, sf_dir), KEY).select("scope", "type", "original", "token")

    @catalog.query(
        "tokenize_keyed",
        f"""{base}, cuts AS (SELECT e.doc_id, cstart, cend, {token_sql(DUCK, KEY, "('s' || (e.doc_id % 3))", 'type', 'substr(text, cstart + 1, cend - cstart)')} AS token, text, lag(cend, 1, 0) OVER (PARTITION BY e.doc_id ORDER BY cstart) AS last_end
          FROM entities e JOIN texts USING (doc_id) WHERE {hidden})
        SELECT doc_id, string_agg(substr(text, last_end + 1, cstart - last_end) || token, '' ORDER BY cstart) || substr(any_value(text), max(cend) + 1) AS tokenized FROM cuts GROUP BY doc_id""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vault.tokenize(owned_docs(spark, sf_dir).where(f"exists(entities, e -> {vault.HIDDEN})"), KEY).select("doc_id", "tokenized")

    @catalog.query("round_trip_exact", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text AS restored, CAST(0 AS BIGINT) AS n_unresolved FROM {ru_docs_sql()}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        owned = owned_docs(spark, sf_dir)
        return vault.detokenize(vault.tokenize(owned, KEY), vault.mappings(owned, KEY)).select("doc_id", "restored", "n_unresolved")

    @catalog.query("detokenize_strict", f"{valued} SELECT t.doc_id, CASE WHEN t.doc_id % 3 = 0 AND v.doc_id IS NOT NULL THEN NULL ELSE t.text END AS restored, CASE WHEN t.doc_id % 3 = 0 THEN coalesce(v.n, 0) ELSE 0 END AS n_unresolved FROM texts t LEFT JOIN (SELECT doc_id, count(*) AS n FROM v GROUP BY doc_id) v USING (doc_id)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        owned = owned_docs(spark, sf_dir)
        return vault.detokenize(vault.tokenize(owned, KEY), vault.mappings(owned, KEY).where("scope <> 's0'"), strict=True).select("doc_id", "restored", "n_unresolved")

    @catalog.query("vault_aes_round_trip", "SELECT c_custkey, c_name AS opened, CAST(NULL AS VARCHAR) AS tampered FROM customer")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer").select("c_custkey", seal(F.col("c_name"), KEY, F.col("c_mktsegment")).alias("sealed"), "c_mktsegment")
        return rows.select("c_custkey", unseal(F.col("sealed"), KEY, F.col("c_mktsegment")).alias("opened"), unseal(F.col("sealed"), KEY, F.concat("c_mktsegment", F.lit("x"))).alias("tampered"))

    saves = "SELECT 's' || (user_id % 5) AS scope, 't' || user_id AS token, event_type AS original, ts AS saved, event_id FROM events"

    @catalog.query(
        "vault_conflicts",
        f"""WITH RECURSIVE s AS ({saves}), n AS (SELECT *, row_number() OVER (PARTITION BY scope, token ORDER BY saved, original) AS k FROM s),
        f AS (SELECT scope, token, k, event_id, saved AS first_at, original AS stored, CAST('stored' AS VARCHAR) AS outcome FROM n WHERE k = 1
          UNION ALL SELECT n.scope, n.token, n.k, n.event_id, CASE WHEN n.saved >= f.first_at + INTERVAL 3 DAY THEN n.saved ELSE f.first_at END, CASE WHEN n.saved >= f.first_at + INTERVAL 3 DAY THEN n.original ELSE f.stored END,
            CASE WHEN n.saved >= f.first_at + INTERVAL 3 DAY THEN 'replaced' WHEN n.original = f.stored THEN 'same' ELSE 'conflict' END FROM f JOIN n ON n.scope = f.scope AND n.token = f.token AND n.k = f.k + 1)
        SELECT event_id, outcome FROM f""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("scope"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("token"), F.col("event_type").alias("original"), F.col("ts").alias("at"), "event_id")
        return vault.save(rows, 3 * 86400).select("event_id", "outcome")

    @catalog.query("vault_resolve_ttl", "WITH v AS (SELECT user_id, min(ts) + INTERVAL 2 DAY AS expires_at, min(event_type) AS original FROM events GROUP BY user_id) SELECT e.event_id, CASE WHEN v.expires_at > e.ts THEN v.original END AS original FROM events e JOIN v USING (user_id)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("token"), F.lit("s").alias("scope"), F.col("ts").alias("at"), "event_type")
        held = events.groupBy("scope", "token").agg((F.min("at") + F.expr("INTERVAL 2 DAY")).alias("expires_at"), F.min("event_type").alias("original"))
        return vault.resolve(events.select("event_id", "scope", "token", "at"), held).select("event_id", "original")

    requests = "WITH r AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN '<' || upper(o_orderstatus) || '>' ELSE o_orderstatus END AS payload FROM orders), w AS (SELECT *, first(payload) OVER o AS original, '<' || upper(first(payload) OVER o) || '>' AS result, row_number() OVER o AS k FROM r WINDOW o AS (PARTITION BY id ORDER BY seq)), d AS (SELECT *, CASE WHEN k = 1 THEN 'masked' WHEN payload = original THEN 'stored' WHEN payload = result THEN 'restored' ELSE 'conflict' END AS outcome FROM w) SELECT id AS payload_id, seq, outcome, CASE WHEN outcome IN ('masked', 'stored') THEN result WHEN outcome = 'restored' THEN original END AS reply FROM d"

    @catalog.query("process_idempotent", requests)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        status = F.col("o_orderstatus")
        rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("payload_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<"), F.upper(status), F.lit(">"))).otherwise(status).alias("payload"))
        return scoring.idempotent(rows, F.concat(F.lit("<"), F.upper("payload"), F.lit(">")))

    @catalog.query("stream_process_state", requests)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        status = F.col("o_orderstatus")
        root = sf_dir.rstrip("/")
        orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(root)
        rows = orders.select(F.col("o_custkey").cast("bigint").alias("payload_id"), F.col("o_orderkey").cast("bigint").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<"), F.upper(status), F.lit(">"))).otherwise(status).alias("payload"))
        out = folder(spark, "answers")
        process_stream(rows, lambda x: f"<{x.upper()}>").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{out}/rows")

    truth = f"{base}, p AS (SELECT DISTINCT doc_id, type, start_byte, end_byte FROM entities WHERE personal), g AS (SELECT doc_id, type, start_byte, CASE WHEN doc_id % 10 = 0 THEN end_byte + 1 ELSE end_byte END AS end_byte FROM p)"
    metric = f"""{truth}, f AS (SELECT coalesce(p.type, g.type) AS type, p.type IS NOT NULL AS inp, g.type IS NOT NULL AS ing FROM p FULL JOIN g USING (doc_id, type, start_byte, end_byte)),
        c AS (SELECT type, count(*) FILTER (inp AND ing) AS tp, count(*) FILTER (inp AND NOT ing) AS fp, count(*) FILTER (ing AND NOT inp) AS fn FROM f GROUP BY type),
        r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision_, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall_ FROM c),
        m AS (SELECT *, CASE WHEN precision_ + recall_ > 0 THEN 2 * precision_ * recall_ / (precision_ + recall_) ELSE 0.0 END AS f1_ FROM r)"""

    def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = E.rows(owned_docs(spark, sf_dir)).where("personal").select(F.col("doc_id").alias("case_id"), "type", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
        return scoring.detection_metrics(found.withColumn("end", F.when(F.col("case_id") % 10 == 0, F.col("end") + 1).otherwise(F.col("end"))), found)

    @catalog.query("detection_metrics", f"{metric} SELECT type, tp, fp, fn, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1_, 6) AS f1, tp + fp > 0 AS precision_defined, tp + fn > 0 AS recall_defined, tp + fp > 0 AND tp + fn > 0 AS f1_defined FROM m")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scored(spark, sf_dir).drop("fp_on_hard_negative", "support", "predicted").orderBy("type")

    spans = "SELECT l_orderkey AS case_id, l_returnflag || l_linestatus AS type, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INT) AS e, l_partkey FROM lineitem"
    moved = "SELECT case_id, CASE WHEN l_partkey % 11 = 0 THEN 'odd' ELSE type END AS type, start, e + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS e FROM s WHERE l_partkey % 5 > 0"
    unsure = "SELECT case_id, CASE WHEN l_partkey % 13 = 0 THEN 'never' ELSE type END AS type, start, e + 1 AS e FROM s WHERE l_partkey % 3 = 0"

    @catalog.query(
        "detection_support",
        f"""WITH s AS ({spans}), t AS (SELECT DISTINCT case_id, type, start, e FROM s), p AS (SELECT DISTINCT * FROM ({moved})), n AS (SELECT DISTINCT * FROM ({unsure}))
        SELECT k.type, (SELECT count(*) FROM t WHERE t.type = k.type) AS support, (SELECT count(*) FROM p WHERE p.type = k.type) AS predicted, (SELECT count(*) FROM p SEMI JOIN t USING (case_id, type, start, e) WHERE p.type = k.type) AS tp,
               (SELECT count(*) FROM p ANTI JOIN t USING (case_id, type, start, e) WHERE p.type = k.type) AS fp, (SELECT count(*) FROM t ANTI JOIN p USING (case_id, type, start, e) WHERE t.type = k.type) AS fn,
               (SELECT count(*) FROM p ANTI JOIN t USING (case_id, type, start, e) SEMI JOIN n USING (case_id, type, start, e) WHERE p.type = k.type) AS fp_on_hard_negative
        FROM (SELECT type FROM t UNION SELECT type FROM p UNION SELECT type FROM n) k""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        every, found, doubted = (spark.sql(f"WITH s AS ({spans.replace('lineitem', '{lines}')}) {q}", lines=lines).withColumnRenamed("e", "end") for q in ("SELECT * FROM s", moved, unsure))
        return scoring.detection_metrics(every, found, doubted).select("type", "support", "predicted", "tp", "fp", "fn", "fp_on_hard_negative")

    @catalog.query("macro_average", f"{metric} SELECT round(avg(round(precision_, 6)) FILTER (tp + fp > 0), 6) AS macro_precision, round(avg(round(recall_, 6)) FILTER (tp + fn > 0), 6) AS macro_recall, round(avg(round(f1_, 6)) FILTER (tp + fp > 0 AND tp + fn > 0), 6) AS macro_f1, count(*) FILTER (tp + fp > 0) AS precision_types, count(*) FILTER (tp + fn > 0) AS recall_types, count(*) FILTER (tp + fp > 0 AND tp + fn > 0) AS f1_types, count(*) AS n_types FROM m")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scoring.macro_average(scored(spark, sf_dir))

    @catalog.query("levenshtein_quality", "SELECT c_custkey, round(greatest(0, 1 - levenshtein(c_name, c_mktsegment) / greatest(length(c_name), length(c_mktsegment))), 6) AS quality FROM customer")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "customer").select("c_custkey", F.round(scoring.masking_quality(F.col("c_name"), F.col("c_mktsegment")), 6).alias("quality"))

    @catalog.query("entity_counters_zero_filled", f"{base} SELECT t.type, count(e.type) AS n FROM (SELECT unnest([{', '.join(repr(t) for t in TYPES)}]) AS type) t LEFT JOIN entities e ON e.type = t.type GROUP BY t.type")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, TYPES))).alias("type"))
        return kinds.join(E.rows(owned_docs(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))

    spaces = "\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"

    @catalog.query("token_counts", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{spaces}]+')) AS BIGINT) AS n_tokens FROM (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN replace(text, ' ', chr(160)) WHEN 2 THEN replace(text, ' ', chr(8195)) WHEN 3 THEN replace(text, ' ', chr(133)) ELSE text END AS text FROM documents)")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.expr("CASE doc_id % 4 WHEN 1 THEN replace(text, ' ', '\u00a0') WHEN 2 THEN replace(text, ' ', '\u2003') WHEN 3 THEN replace(text, ' ', '\u0085') ELSE text END")
        return table(spark, sf_dir, "documents").select("doc_id", audit.token_count(text).alias("n_tokens"))

    @catalog.query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.99) <= 100.0 AS target_met FROM events GROUP BY event_type")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n").withColumn("target_met", F.col("p99") <= 100.0)

    @catalog.query("duration_histogram", " UNION ALL ".join(f"SELECT event_type, {b}::DOUBLE AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY event_type" for b in BUCKETS))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)])
        return wide.select("event_type", F.inline(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)])))

    rates = "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_ratio FROM events GROUP BY 1"

    @catalog.query("error_ratio_windows", rates)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return error_rates(table(spark, sf_dir, "events"), "1 day")

    @catalog.query("stream_error_windows", rates)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return streamed(spark, sf_dir, "1 day")

    days = "d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)"

    @catalog.query("burn_rate_alerts", f"WITH {days}, w AS (SELECT day, sum(errors) OVER s / sum(n) OVER s AS short, sum(errors) OVER l / sum(n) OVER l AS long FROM d WINDOW s AS (ORDER BY day RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), l AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)) SELECT CAST(day AS VARCHAR) AS day, round(short / 0.1, 6) AS short_burn, round(long / 0.1, 6) AS long_burn, short > 2.0 * 0.1 AND long > 2.0 * 0.1 AS firing FROM w")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
        over = lambda k: Window.orderBy(F.unix_date("day")).rangeBetween(-k, 0)  # noqa: E731  a row a day: bounded by the time covered
        ratio = lambda k: F.sum("errors").over(over(k)) / F.sum("n").over(over(k))
        rows = daily.select("day", ratio(1).alias("s"), ratio(6).alias("l"))
        return rows.select(F.col("day").cast("string").alias("day"), F.round(F.col("s") / 0.1, 6).alias("short_burn"), F.round(F.col("l") / 0.1, 6).alias("long_burn"), ((F.col("s") > 0.2) & (F.col("l") > 0.2)).alias("firing"))

    @catalog.query("audit_rollup", f"{base} SELECT doc_id, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS entity_count, bool_or(personal) AS has_personal_data FROM entities GROUP BY doc_id")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = E.rows(owned_docs(spark, sf_dir))
        return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count("*").alias("entity_count"), F.max("personal").alias("has_personal_data"))

    @catalog.query("gauge_growth_slope", "SELECT event_type, round(regr_slope(value, epoch(ts)) * 1e6, 6) AS slope FROM events GROUP BY event_type")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.regr_slope(F.col("value"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) * 1e6, 6).alias("slope"))

    @catalog.query("absent_series", "SELECT k.event_type, count(e.event_id) = 0 AS absent FROM (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'refund']) AS event_type) k LEFT JOIN events e USING (event_type) GROUP BY 1")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, ("view", "click", "purchase", "signup", "error", "refund")))).alias("event_type"))
        seen = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
        return kinds.join(seen, "event_type", "left").select("event_type", F.col("n").isNull().alias("absent"))

    hexes = "h AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents)"
    cont = lambda i: f"(({i}) < n AND substr(h, 2 * ({i}) + 1, 1) IN ('8', '9', 'A', 'B'))"
    back = lambda e: f"CASE WHEN {cont(e)} THEN CASE WHEN {cont(e + ' - 1')} THEN CASE WHEN {cont(e + ' - 2')} THEN {e} - 3 ELSE {e} - 2 END ELSE {e} - 1 END ELSE {e} END"
    ahead = lambda e: f"CASE WHEN {cont(e)} THEN CASE WHEN {cont(e + ' + 1')} THEN CASE WHEN {cont(e + ' + 2')} THEN {e} + 3 ELSE {e} + 2 END ELSE {e} + 1 END ELSE {e} END"

    @catalog.query(
        "window_split",
        f"""WITH RECURSIVE {hexes}, w AS (
          SELECT doc_id, h, n, 0 AS i, 0 AS s, {back('least(512, n)')} AS e FROM h WHERE n > 0
          UNION ALL SELECT doc_id, h, n, i + 1, s2, {back('least(s2 + 512, n)')} FROM (SELECT *, {ahead('(e - 64)')} AS s2 FROM w WHERE e < n))
        SELECT doc_id, CAST(i AS INTEGER) AS "window", CAST(s AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte FROM w""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.split_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), 512, 64)

    planned = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 7 = 3 THEN 0 ELSE (c_custkey % 4 + 1) * 80 + 20 END AS n_chars, CASE WHEN c_custkey % 7 = 3 THEN 0 ELSE 100 END AS total, CASE WHEN c_custkey % 11 = 4 THEN 20 ELSE 64 END AS capacity FROM customer"
    spread = "SELECT c_custkey AS doc_id, i, CASE WHEN i = 0 THEN 0 WHEN c_custkey % 13 = 6 THEN i * 80 + 25 ELSE i * 80 END AS start_, CASE WHEN c_custkey % 17 = 8 AND i = c_custkey % 4 THEN (i + 1) * 80 ELSE (i + 1) * 80 + 20 END AS end_, 30 + i AS tokens"

    @catalog.query(
        "window_plan_validation",
        f"""WITH p AS ({planned}), w AS ({spread} FROM (SELECT c_custkey, unnest(range(0, c_custkey % 4 + 1)) AS i FROM customer WHERE c_custkey % 7 <> 3)),
        l AS (SELECT *, lag(start_) OVER o AS ps, lag(end_) OVER o AS pe FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        d AS (SELECT doc_id, bool_and(start_ >= 0 AND end_ > start_ AND tokens > 0 AND CASE WHEN pe IS NULL THEN start_ = 0 ELSE start_ > ps AND end_ > pe AND start_ < pe END) AS ok, max(tokens) AS most, max(end_) AS reach, count(*) AS k FROM l GROUP BY doc_id)
        SELECT p.doc_id, total >= 0 AND capacity > 0 AND capacity > 16 AND CASE WHEN coalesce(k, 0) = 0 THEN total = 0 ELSE n_chars > 0 AND total > 0 AND ok AND most <= capacity AND reach = n_chars END AS valid FROM p LEFT JOIN d USING (doc_id)""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        customer = table(spark, sf_dir, "customer").select("c_custkey")
        plans = customer.select(*[F.expr(x) for x in ("c_custkey AS doc_id", "CASE WHEN c_custkey % 7 = 3 THEN 0 ELSE (c_custkey % 4 + 1) * 80 + 20 END AS n_chars", "CASE WHEN c_custkey % 7 = 3 THEN 0 ELSE 100 END AS total", "CASE WHEN c_custkey % 11 = 4 THEN 20 ELSE 64 END AS capacity")])
        parts = customer.where("c_custkey % 7 <> 3").select("c_custkey", F.explode(F.expr("sequence(0, CAST(c_custkey % 4 AS INT))")).alias("i"))
        parts = parts.select(F.col("c_custkey").alias("doc_id"), "i", F.expr("CASE WHEN i = 0 THEN 0 WHEN c_custkey % 13 = 6 THEN i * 80 + 25 ELSE i * 80 END AS start"), F.expr("CASE WHEN c_custkey % 17 = 8 AND i = c_custkey % 4 THEN (i + 1) * 80 ELSE (i + 1) * 80 + 20 END AS end"), F.expr("30 + i AS tokens"))
        return windows.plan_is_valid(plans, parts, 16)

    cumulative = " UNION ALL ".join(f"SELECT event_type, {b}::DOUBLE AS le, {BUCKETS[i - 1] if i else 0.0}::DOUBLE AS low, count(*) FILTER (value <= {b}) AS n, count(*) FILTER (value <= {BUCKETS[i - 1] if i else -1.0}) AS below, count(*) AS total FROM events GROUP BY event_type" for i, b in enumerate(BUCKETS))

    @catalog.query("histogram_quantile", f"WITH c AS ({cumulative}), r AS (SELECT *, 0.95 * total AS rank FROM c) SELECT event_type, round(coalesce(min(low + (le - low) * (rank - below) / (n - below)) FILTER (n >= rank AND below < rank), {BUCKETS[-1]}), 6) AS p95 FROM r GROUP BY event_type")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"), *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)])
        return wide.select("event_type", F.round(alerts.quantile(0.95, "total", [f"b{i}" for i in range(len(BUCKETS))], BUCKETS), 6).alias("p95"))

    @catalog.query("alert_hold_islands", f"WITH {days}, f AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM d WHERE errors / n > 0.2) SELECT CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS n_days FROM f GROUP BY island HAVING count(*) >= 2")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("r")).where("r > 0.2")
        islands = daily.withColumn("island", F.unix_date("day") - F.row_number().over(Window.orderBy("day")))
        out = islands.groupBy("island").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count("*").alias("n_days"))
        return out.where("n_days >= 2").drop("island")

    @catalog.query("revoke_scope", f"{valued} SELECT scope, count(DISTINCT (type, original)) AS n FROM v WHERE scope <> 's1' GROUP BY scope")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tokens.revoked(vault.mappings(owned_docs(spark, sf_dir), KEY), spark.createDataFrame([("s1",), ("s1",)], "scope string")).groupBy("scope").agg(F.count("*").alias("n"))

    @catalog.query("token_scope_isolation", f"{valued} SELECT type, original, count(DISTINCT scope) AS n_scopes, count(DISTINCT scope) AS n_tokens FROM v GROUP BY ALL")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vault.mappings(owned_docs(spark, sf_dir), KEY)
        return rows.groupBy("type", "original").agg(F.count_distinct("scope").alias("n_scopes"), F.count_distinct("token").alias("n_tokens"))
