"""The entity operators once more, as relational DuckDB SQL: what the array operators must agree with."""

from __future__ import annotations

from maskwright.functions.dialect import DUCK
from maskwright.functions.phrases import CLIENT, ORGANIZATION, ORGANIZATION_INN, PASSPORT, POSITIVE, PUBLIC, addressed, present, present_not_negated, promoted_type
from maskwright.functions.registry import ADDRESS_PARTS, HIGH_RISK_TYPES, LINKED_TYPES, NAME_TYPES, REASON_SCORES, REASONS, SOURCES
from maskwright.functions.rules import RULES
from maskwright.functions.spans import rule_spans_sql


def _list(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _canonical(expr: str) -> str:
    """Sources of a group of comma lists, in fixed order."""
    return f"array_to_string(list_filter([{', '.join(repr(s) for s in SOURCES)}], lambda s: list_contains(string_split({expr}, ','), s)), ',')"


def classified(texts: str, models: str = "") -> str:
    """CTEs up to ``classified``: doc_id, type, start_byte, end_byte, cstart, cend, confidence, sources, line, left60."""
    rules = " UNION ALL ".join(rule_spans_sql(r, "texts", places=True) for r in RULES)
    return f"""
    texts AS {texts},
    cand AS ({rules}{" UNION ALL SELECT doc_id, type, start_byte, end_byte, confidence, sources, cstart, cend FROM " + models if models else ""}),
    placed AS (SELECT c.*, start_byte - strlen(before_) AS line, right(before_, 60) AS left60 FROM (
      SELECT c.*, string_split(substr(text, 1, cstart), chr(10))[-1] AS before_ FROM cand c JOIN texts USING (doc_id)) c),
    retyped AS (SELECT * REPLACE ({promoted_type(DUCK, 'type', 'left60')} AS type) FROM placed),
    blocks AS (SELECT * FROM (
      SELECT doc_id, 'ADDRESS' AS type, min(start_byte) AS start_byte, max(end_byte) AS end_byte, max(confidence) AS confidence, {_canonical("string_agg(sources, ',')")} AS sources,
             min(cstart) AS cstart, max(cend) AS cend, line, arg_min(left60, start_byte) AS left60 FROM placed WHERE type IN {_list(ADDRESS_PARTS)} GROUP BY doc_id, line) WHERE {addressed(DUCK, 'left60')}),
    every AS (
      SELECT * FROM retyped r WHERE type IS NOT NULL AND NOT (type = 'ADDRESS' AND EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = r.doc_id AND b.start_byte <= r.start_byte AND r.end_byte <= b.end_byte))
      UNION ALL BY NAME SELECT * FROM blocks),
    classified AS (
      SELECT doc_id, type, start_byte, end_byte, max(confidence) AS confidence, CASE WHEN count(*) = 1 THEN any_value(sources) ELSE {_canonical("string_agg(sources, ',')")} END AS sources,
             any_value(cstart) AS cstart, any_value(cend) AS cend, any_value(line) AS line, any_value(left60) AS left60 FROM every GROUP BY doc_id, type, start_byte, end_byte)"""


def merged(source: str = "classified", to: str = "m") -> str:
    """CTEs from candidates to ``{to}_won`` and ``{to}_parts``: best first, by a recursion over the rank."""
    tier = "CASE WHEN contains(sources, 'validator') THEN 3 WHEN contains(sources, 'regex') THEN 2 ELSE 1 END"
    return f"""
    {to}_ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {tier} DESC, confidence DESC, end_byte - start_byte DESC, start_byte, end_byte, type) AS rank FROM {source}),
    {to}_fold AS (
      SELECT doc_id, rank AS k, [{{'s': start_byte, 'e': end_byte, 'r': rank}}] AS wins FROM {to}_ranked WHERE rank = 1
      UNION ALL
      SELECT f.doc_id, c.rank, CASE WHEN len(list_filter(f.wins, lambda w: w.s < c.end_byte AND c.start_byte < w.e)) = 0 THEN list_append(f.wins, {{'s': c.start_byte, 'e': c.end_byte, 'r': c.rank}}) ELSE f.wins END
      FROM {to}_fold f JOIN {to}_ranked c ON c.doc_id = f.doc_id AND c.rank = f.k + 1),
    {to}_wins AS (SELECT doc_id, unnest(wins) AS w FROM (SELECT doc_id, arg_max(wins, k) AS wins FROM {to}_fold GROUP BY doc_id)),
    {to}_won AS (SELECT r.* FROM {to}_ranked r JOIN {to}_wins w ON w.doc_id = r.doc_id AND w.w.r = r.rank),
    {to}_parts AS (
      SELECT w.doc_id, w.rank AS owner, p.* EXCLUDE (doc_id) FROM {to}_won w JOIN {to}_ranked p ON p.doc_id = w.doc_id AND p.rank <> w.rank AND w.start_byte <= p.start_byte AND p.end_byte <= w.end_byte
      WHERE NOT EXISTS (SELECT 1 FROM {to}_wins x WHERE x.doc_id = p.doc_id AND x.w.r = p.rank))"""


def assessed(to: str = "m", out: str = "entities", disabled: bool = False) -> str:
    """CTEs from ``{to}_won`` and ``{to}_parts`` to ``{out}``, flat."""
    tests = {"client_context": present(DUCK, "low", CLIENT), "passport_context": present(DUCK, "low", (PASSPORT,)), "positive_context": present_not_negated(DUCK, "low", POSITIVE), "linked_entities": "(name AND line_linked) OR (linked AND line_name)", "field_label": "risk"}
    reasons = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{r}' END" for r, t in tests.items()) + "], lambda r: r IS NOT NULL)"
    score = "list_max(list_transform(why, lambda r: CASE r " + " ".join(f"WHEN '{r}' THEN {s}::DOUBLE" for r, s in REASON_SCORES.items()) + " ELSE 0 END))"
    has = lambda kinds: f"(type IN {_list(kinds)} OR EXISTS (SELECT 1 FROM {to}_parts p WHERE p.doc_id = w.doc_id AND p.owner = w.rank AND p.type IN {_list(kinds)}))"
    said = "CASE owner_type WHEN 'ORGANIZATION' THEN ['organization_context'] WHEN 'PUBLIC' THEN ['public_context'] WHEN 'UNKNOWN' THEN ['ambiguous_context'] ELSE why END"
    if disabled:
        said = f"list_filter([{', '.join(repr(r) for r in REASONS)}], lambda r: list_contains({said}, r) OR r = 'type_disabled_by_policy')"
    return f"""
    {to}_seen AS (
      SELECT w.*, lower(left60 || value || CASE WHEN contains(value, chr(10)) THEN '' ELSE left(string_split(substr(text, cend + 1), chr(10))[1], 60) END) AS low,
             {has(NAME_TYPES)} AS name, {has(LINKED_TYPES)} AS linked, type IN {_list(HIGH_RISK_TYPES)} AS risk
      FROM (SELECT w.*, text, substr(text, cstart + 1, cend - cstart) AS value FROM {to}_won w JOIN texts USING (doc_id)) w),
    {to}_lines AS (SELECT *, bool_or(name) OVER (PARTITION BY doc_id, line) AS line_name, bool_or(linked) OVER (PARTITION BY doc_id, line) AS line_linked FROM {to}_seen),
    {to}_kind AS (SELECT *, {reasons} AS why, CASE WHEN {present(DUCK, 'low', ORGANIZATION_INN)} OR NOT risk AND {present(DUCK, 'low', ORGANIZATION)} THEN 'ORGANIZATION' WHEN NOT risk AND {present(DUCK, 'low', PUBLIC)} THEN 'PUBLIC' END AS kind FROM {to}_lines),
    {to}_owner AS (SELECT *, CASE WHEN kind IS NOT NULL THEN kind WHEN len(why) > 0 THEN 'PERSON' ELSE 'UNKNOWN' END AS owner_type FROM {to}_kind),
    {out} AS (
      SELECT doc_id, type, start_byte, end_byte, cstart, cend, confidence, sources,
             coalesce((SELECT string_agg(p.type || ':' || p.start_byte || '-' || p.end_byte, ',' ORDER BY p.start_byte, p.end_byte, p.type) FROM {to}_parts p WHERE p.doc_id = o.doc_id AND p.owner = o.rank), '') AS parts,
             {'false' if disabled else "owner_type = 'PERSON'"} AS personal, owner_type,
             {"''" if disabled else "CASE WHEN owner_type IN ('PERSON', 'ORGANIZATION') THEN lower(owner_type) || '-' || dense_rank() OVER (PARTITION BY doc_id, owner_type ORDER BY line) ELSE '' END"} AS owner_id,
             CASE owner_type WHEN 'PERSON' THEN {score} WHEN 'UNKNOWN' THEN 0.3 ELSE 0.9 END::DOUBLE AS score, array_to_string({said}, ',') AS reasons, owner_type = 'UNKNOWN' AS review
      FROM {to}_owner o)"""


FLAT = "doc_id, type, start_byte, end_byte, confidence, sources, parts, personal, owner_type, owner_id, score, reasons, review"


def entities(texts: str, allowed: tuple[str, ...] | None = None, models: str = "") -> str:
    """``WITH`` clause that ends in ``entities``."""
    head = "WITH RECURSIVE " + classified(texts, models)
    if allowed is None:
        return head + ", " + merged() + ", " + assessed()
    return (
        head + f", on_c AS (SELECT * FROM classified WHERE type IN {_list(allowed)}), off_c AS (SELECT * FROM classified WHERE type NOT IN {_list(allowed)}), " + merged("on_c", "a") + ", " + assessed("a", "on_e")
        + ", " + merged("off_c", "b") + ", " + assessed("b", "off_e", True)
        + ", entities AS (SELECT * FROM on_e UNION ALL SELECT * FROM off_e d WHERE NOT EXISTS (SELECT 1 FROM on_e a WHERE a.doc_id = d.doc_id AND d.start_byte < a.end_byte AND a.start_byte < d.end_byte))"
    )
