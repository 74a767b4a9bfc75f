"""Tokens in place of values, the mapping table, and the way back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.crypto import TOKEN, seal, token_sql, unseal
from maskwright.functions.dialect import SPARK
from maskwright.operators.entities import masked

HIDDEN = "(e.personal OR (e.review AND NOT array_contains(e.reasons, 'type_disabled_by_policy')))"


def tokenize(docs: DataFrame, key: bytes, scope: str = "scope", which: str = HIDDEN) -> DataFrame:
    """``docs`` with ``tokenized``: personal and undecided entities replaced by tokens of the row's scope."""
    return masked(docs, which, token_sql(SPARK, key, scope, "e.type", "value"), to="tokenized")


def mappings(docs: DataFrame, key: bytes, scope: str = "scope", which: str = HIDDEN) -> DataFrame:
    """Distinct (scope, token, type, original) of the same entities."""
    value = "CAST(substring(raw, CAST(e.start + 1 AS INT), CAST(e.end - e.start AS INT)) AS STRING)"
    found = f"transform(array(encode(text, 'UTF-8')), raw -> transform(filter(entities, e -> {which}), e -> named_struct('type', e.type, 'original', {value})))[0]"
    rows = docs.select(scope, F.explode_outer(F.expr(found)).alias("e")).where("e is not null").select(scope, "e.*")
    return rows.distinct().withColumn("token", F.expr(token_sql(SPARK, key, scope, "type", "original")))


def _lives(keys: tuple[str, ...]):
    """Rows sorted by key and time: first_at and ends_at of the life that each one falls into. The last two columns are at and at + ttl."""

    def fold(batches):
        key, first_at, ends = None, None, None
        for batch in batches:
            own = [batch.column(c).to_pylist() for c in keys]
            times = [batch.column(c).cast(pa.int64()).to_pylist() for c in ("_at", "_ends")]
            made: tuple[list, list] = ([], [])
            for *name, at, end in zip(*own, *times, strict=True):
                if name != key or at is not None and ends is not None and at >= ends:
                    key, first_at, ends = name, at, end
                made[0].append(first_at)
                made[1].append(ends)
            columns = [pa.array(m, pa.int64()).cast(batch.column("_at").type) for m in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[*batch.schema.names[:-2], "first_at", "ends_at"])

    return fold


def lifetimes(requests: DataFrame, keys: tuple[str, ...], ttl_seconds: int, order: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` with first_at and ends_at: a key's life begins with its first request and ends ``ttl_seconds`` later, whatever comes between; the next request begins another one."""
    rest = [c for c in requests.columns if c not in ("first_at", "ends_at")]
    at = F.col("at") + F.make_dt_interval(secs=F.lit(0))
    rows = requests.select(*rest, at.alias("_at"), (at + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("_ends"))
    schema = rows.select(*rest, F.col("_at").alias("first_at"), F.col("_ends").alias("ends_at")).schema
    return rows.repartition(*keys).sortWithinPartitions(*keys, "at", *order).mapInArrow(_lives(keys), schema)


def save(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Save requests (scope, token, original, at) in order: the first of a live mapping stores it, an equal one changes nothing, another one conflicts; a mapping lives ``ttl_seconds`` from its first save, and the first request after that replaces it by a new one that lives as long. ``stored`` is what the mapping holds. A request with a null or empty scope, token or original, or without a time, touches no mapping: its outcome is empty_scope, empty_token, empty_original or no_time."""
    empty = lambda name: F.coalesce(F.col(name).cast("string") == "", F.lit(True))
    flaw = F.when(empty("scope"), "empty_scope").when(empty("token"), "empty_token").when(empty("original"), "empty_original").when(F.col("at").isNull(), "no_time")
    every = requests.drop("first_at", "stored", "outcome").withColumn("outcome", flaw)
    rows = lifetimes(every.where("outcome is null").drop("outcome"), ("scope", "token"), ttl_seconds, ("original",))
    life = Window.partitionBy("scope", "token", "first_at").orderBy("at", "original")
    rows = rows.withColumns({"stored": F.first("original").over(life), "_n": F.row_number().over(life), "_born": F.min("first_at").over(Window.partitionBy("scope", "token"))})
    first = F.when(F.col("first_at").eqNullSafe(F.col("_born")), "stored").otherwise("replaced")
    outcome = F.when(F.col("_n") == 1, first).when(F.col("original") == F.col("stored"), "same").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("ends_at", "_n", "_born").unionByName(every.where("outcome is not null"), allowMissingColumns=True)


def resolve(requests: DataFrame, vault: DataFrame) -> DataFrame:
    """``requests`` (scope, token, at) with ``original`` where the vault (scope, token, original, expires_at) has a live mapping."""
    return requests.join(vault.select("scope", "token", "original", "expires_at"), ["scope", "token"], "left").withColumn("original", F.when(F.col("expires_at") > F.col("at"), F.col("original")))


def resolve_sealed(requests: DataFrame, sealed: DataFrame, key: bytes) -> DataFrame:
    """``requests`` (scope, token) with ``original`` and ``error`` from a ``sealed_vault``: not_found, or corrupted where the record does not open for its scope and token."""
    asked = requests.withColumns({"_scope": F.sha2("scope", 256), "_token": F.sha2("token", 256)})
    held = sealed.select(F.col("scope_digest").alias("_scope"), F.col("token_digest").alias("_token"), "sealed")
    found = asked.join(held, ["_scope", "_token"], "left").withColumn("original", unseal(F.col("sealed"), key, F.concat_ws("|", "_scope", "_token")))
    error = F.when(F.col("sealed").isNull(), "not_found").when(F.col("original").isNull(), "corrupted")
    return found.withColumn("error", error).drop("_scope", "_token", "sealed")


def detokenize(docs: DataFrame, vault: DataFrame, strict: bool = False, text: str = "tokenized") -> DataFrame:
    """(doc_id, restored, n_unresolved, n_resolved, unresolved) of texts (doc_id, scope, text).

    Tokens of a scope are put back at every place; each distinct one is asked
    for once. One that the vault lacks stays and is listed in ``unresolved``,
    in order of first appearance; with ``strict`` the text is null then. Only
    tokens travel to the vault's join; texts meet them again by id, scope and
    the text's hash, so rows that share an id do not mix.
    """
    row = ["doc_id", "scope", "_text"]
    cut = docs.select("doc_id", "scope", F.xxhash64(text).alias("_text"), F.expr(f"split({text}, '{TOKEN}', -1)").alias("gaps"), F.expr(f"regexp_extract_all({text}, '{TOKEN}', 0)").alias("tokens"))
    asked = cut.select(*row, F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    found = asked.join(vault.select("scope", "token", "original").distinct(), ["scope", "token"], "left")
    known = found.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("token", "original")))).alias("_known"))
    known = known.withColumnsRenamed({c: f"_of_{c}" for c in row})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in row]
    joined = cut.join(known, same[0] & same[1] & same[2], "left")
    value = "coalesce(try_element_at(_known, t), t)"
    whole = F.expr(f"array_join(zip_with(gaps, concat(transform(tokens, t -> {value}), array('')), (g, v) -> g || v), '')")
    unresolved = F.expr("coalesce(filter(array_distinct(tokens), t -> _known IS NULL OR try_element_at(_known, t) IS NULL), CAST(array() AS array<string>))")
    rows = joined.select("doc_id", whole.alias("_whole"), unresolved.alias("unresolved"), F.size(F.array_distinct("tokens")).alias("_n"))
    n = F.size("unresolved").cast("bigint")
    return rows.select("doc_id", (F.when(n == 0, F.col("_whole")) if strict else F.col("_whole")).alias("restored"), n.alias("n_unresolved"), F.coalesce((F.col("_n") - n).cast("bigint"), F.lit(0).cast("bigint")).alias("n_resolved"), "unresolved")


def sealed_vault(mapped: DataFrame, key: bytes) -> DataFrame:
    """The mapping table at rest: digests of scope and token, and the sealed original bound to both."""
    aad = F.concat_ws("|", F.sha2("scope", 256), F.sha2("token", 256))
    return mapped.select(F.sha2("scope", 256).alias("scope_digest"), F.sha2("token", 256).alias("token_digest"), seal(F.col("original"), key, aad).alias("sealed"))
