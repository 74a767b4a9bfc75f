"""Token slots with a life time, replacement in checked spans, and what both promise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.crypto import TOKEN, slot_token_sql
from maskwright.functions.dialect import SPARK
from maskwright.operators.vault import lifetimes
from maskwright.sources.shared import kept

SLOT = ("scope", "type", "value")
ATTEMPTS = 8


def random_seed() -> Column:
    """16 random bytes."""
    return F.expr("unhex(md5(concat(uuid(), uuid())))")


def slots(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """Requests (scope, type, value, at) with the slot that each one falls into: slot_at, its first request, and slot_ends. A slot lives ``ttl_seconds`` from its first request; the next request opens a new one."""
    return lifetimes(requests, SLOT, ttl_seconds).withColumnsRenamed({"first_at": "slot_at", "ends_at": "slot_ends"})


def mint(found: DataFrame, key: bytes, seed: Column | None = None, suffix_bytes: int = 16) -> DataFrame:
    """One row per slot of ``slots``, with seed and token.

    The seed is 16 random bytes unless ``seed`` gives it (for the first
    attempt). A token that an earlier slot has is minted anew from a random
    seed, until all differ; the table is written each time, so seeds stay.
    """
    token = lambda: F.expr(slot_token_sql(SPARK, key, "seed", "scope", "type", "value", suffix_bytes))
    rows = found.select(*SLOT, "slot_at", "slot_ends").distinct()
    rows = kept(rows.withColumn("seed", random_seed() if seed is None else seed).withColumn("token", token()), "slots")
    for _ in range(ATTEMPTS):
        taken = rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
        if taken.isEmpty():
            return rows
        number = F.row_number().over(Window.partitionBy("token").orderBy("slot_at", *SLOT))
        again = rows.join(taken.select("token"), "token", "left_semi").withColumn("_n", number)
        fresh = again.where("_n > 1").withColumn("seed", random_seed()).withColumn("token", token())
        rows = kept(rows.join(taken.select("token"), "token", "left_anti").unionByName(again.where("_n = 1").drop("_n")).unionByName(fresh.drop("_n")), "slots")
    raise ValueError("tokens still collide; the suffix is too short")


def refused(types: tuple[str, ...] | None = None) -> Column:
    """Why a request can't have a slot, in the order of the tests: empty_scope, empty_value, unknown_type (null, empty, or none of ``types``) or no_time; null where it can. A null counts as empty."""
    empty = lambda name: F.coalesce(F.col(name).cast("string") == "", F.lit(True))
    unknown = empty("type") if types is None else ~F.coalesce(F.col("type").isin(*types), F.lit(False))
    return F.when(empty("scope"), "empty_scope").when(empty("value"), "empty_value").when(unknown, "unknown_type").when(F.col("at").isNull(), "no_time")


def issue(requests: DataFrame, key: bytes, ttl_seconds: int, seed: Column | None = None, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests with their token and ``error``, the slots): equal values of a scope and type share a token while their slot lives.

    A request that ``refused`` names gets no token and touches no slot; each
    request comes back once. ``types``: the types there are (``registry.extended``
    adds one's own); without it, any that is not empty.
    """
    rows = requests.withColumn("error", refused(types))
    found = slots(rows.where("error is null"), ttl_seconds)
    minted = mint(found, key, seed)
    names = [*SLOT, "slot_at"]
    issued = found.join(minted.select(*names, "token"), names)
    return issued.unionByName(rows.where("error is not null"), allowMissingColumns=True), minted


def revoked(table: DataFrame, scopes: DataFrame, scope: str = "scope") -> DataFrame:
    """``table`` (slots or mappings) without the rows of revoked scopes; revoking twice changes nothing."""
    return table.join(scopes.select(F.col("scope").alias("_scope")).distinct(), F.col(scope) == F.col("_scope"), "left_anti")


def live(table: DataFrame, at: Column, ends: str = "expires_at") -> DataFrame:
    """The rows that have not expired at a time."""
    return table.where(F.col(ends) > at)


def next_to_expire(table: DataFrame, at: Column, most: int = 64, ends: str = "expires_at") -> DataFrame:
    """Of the rows expired at a time, those that did first, ``most`` at most: what one bounded sweep takes away."""
    return table.where(F.col(ends) <= at).orderBy(ends, *[c for c in table.columns if c != ends]).limit(most)


def tokens_of(text: Column) -> Column:
    """The tokens of a text in order, each as often as it comes."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokens_match(wanted: Column, got: Column) -> Column:
    """Whether two texts have the same tokens in the same order, each as often."""
    return tokens_of(wanted) == tokens_of(got)


def _chosen(entities: str, which: str) -> str:
    """The spans to replace in their total order; the outermost comes first, ties go by type, confidence, score, owner, sources, parts and reasons."""
    keys = "e.start, -e.end, e.type, -e.confidence, -e.score, e.owner_type, e.owner_id, e.sources, e.parts, e.reasons"
    named = ", ".join(f"'k{i}', {k}" for i, k in enumerate(keys.split(", ")))
    return f"transform(array_sort(transform(filter({entities}, e -> {which}), e -> named_struct({named}, 'e', e))), k -> k.e)"


def replace_spans(docs: DataFrame, token: str, which: str = "e.personal", text: str = "text", at: str = "entities") -> DataFrame:
    """``docs`` with tokenized, replacements and error.

    Only the chosen entities are replaced, by UTF-8 byte offsets, each by the
    SQL expression ``token`` over ``e`` and its ``value``. Of equal spans and
    of spans inside another one the outer stays, so a value gets one token.
    Spans that overlap in part (``partial_overlap``) and spans out of the text
    or within a character (``invalid_span``) are errors: then nothing of the
    text is given out. A null text has null results.
    """
    raw = f"encode({text}, 'UTF-8')"
    inner = lambda i: f"substring(hex(substring({raw}, {i} + 1, 1)), 1, 1) IN ('8', '9', 'A', 'B')"  # noqa: E731  a byte that goes on with a character
    invalid = f"exists(chosen, e -> e.start < 0 OR e.end <= e.start OR e.end > octet_length({text}) OR {inner('e.start')} OR (e.end < octet_length({text}) AND {inner('e.end')}))"
    step = """CASE WHEN size(s.kept) = 0 OR e.start >= element_at(s.kept, -1).end THEN named_struct('kept', concat(s.kept, array(e)), 'bad', s.bad)
        WHEN e.end <= element_at(s.kept, -1).end THEN s ELSE named_struct('kept', s.kept, 'bad', true) END"""
    kind = docs.schema[at].dataType.elementType.simpleString()
    state = f"struct<kept:array<{kind}>,bad:boolean>"
    fold = f"aggregate(chosen, CAST(named_struct('kept', array(), 'bad', false) AS {state}), (s, e) -> CAST({step} AS {state}))"
    rows = docs.withColumn("chosen", F.explode_outer(F.array(F.expr(_chosen(at, which))))).withColumn("folded", F.explode_outer(F.array(F.expr(fold))))
    rows = rows.withColumn("error", F.expr(f"CASE WHEN {text} IS NULL THEN NULL WHEN {invalid} THEN 'invalid_span' WHEN folded.bad THEN 'partial_overlap' END"))
    value = f"CAST(substring({raw}, e.start + 1, e.end - e.start) AS STRING)"
    made = f"transform(transform(folded.kept, e -> named_struct('e', e, 'value', {value})), x -> named_struct('type', x.e.type, 'start', x.e.start, 'end', x.e.end, 'value', x.value, 'token', {token.replace('e.', 'x.e.').replace('{value}', 'x.value')}))"
    rows = rows.withColumn("replacements", F.explode_outer(F.array(F.expr(f"CASE WHEN error IS NULL AND {text} IS NOT NULL THEN {made} END"))))
    cut = f"CAST(substring({raw}, s.at + 1, r.start - s.at) AS STRING)"
    joined = f"aggregate(replacements, named_struct('at', 0L, 'out', ''), (s, r) -> named_struct('at', r.end, 'out', s.out || {cut} || r.token), s -> s.out || CAST(substring({raw}, s.at + 1, octet_length({text})) AS STRING))"
    return rows.withColumn("tokenized", F.expr(joined)).drop("chosen", "folded")


def persist(replaced: DataFrame, vault: DataFrame, scope: str = "scope") -> tuple[DataFrame, DataFrame]:
    """(texts, new mappings) of ``replace_spans``, all or nothing.

    A text is given out only if every mapping of it can be stored: it has a
    scope (else ``empty_scope``), its tokens and originals are not null or
    empty (``empty_mapping``), and none of its tokens has another original in
    the vault (scope, token, original) or in another text of the batch
    (``conflict``). Else it is null and ``error`` says so. What becomes of a
    row depends on its scope and replacements alone, so rows without an
    identifier or with one that repeats are rows like others. Mappings come
    from the texts given out, each once, without those that the vault has.
    """
    nothing = F.coalesce(F.size("replacements"), F.lit(0)) == 0
    hollow = F.exists("replacements", lambda r: F.coalesce((r["token"] == "") | (r["value"] == ""), F.lit(True)))
    flaw = F.when(F.col("error").isNotNull() | nothing, F.col("error")).when(F.coalesce(F.col(scope) == "", F.lit(True)), "empty_scope").when(hollow, "empty_mapping")
    rows = replaced.withColumns({"error": flaw, "_fate": F.sha2(F.to_json(F.struct(scope, F.transform("replacements", lambda r: F.struct(r["token"], r["value"])).alias("r"))), 256)})
    asked = rows.where("error is null").select("_fate", scope, F.explode("replacements").alias("r")).select("_fate", scope, "r.token", F.col("r.value").alias("original")).distinct()
    held = vault.select(F.col("scope").alias(scope), "token", F.col("original").alias("held"))
    every = asked.select(scope, "token", F.col("original").alias("held")).unionByName(held)
    clash = every.groupBy(scope, "token").agg((F.min("held") != F.max("held")).alias("clash")).where("clash").select(scope, "token")
    failed = asked.join(clash, [scope, "token"], "left_semi").select(F.col("_fate").alias("_failed")).distinct()
    texts = rows.join(failed, F.col("_fate") == F.col("_failed"), "left").withColumn("error", F.coalesce("error", F.when(F.col("_failed").isNotNull(), "conflict")))
    texts = texts.withColumn("tokenized", F.when(F.col("error").isNull(), F.col("tokenized"))).drop("_failed", "_fate", "replacements")
    new = asked.join(failed, F.col("_fate") == F.col("_failed"), "left_anti").select(scope, "token", "original").distinct().join(held.select(scope, "token"), [scope, "token"], "left_anti")
    return texts, new
