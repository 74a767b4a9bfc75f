"""Spans of rules in a text, with UTF-8 byte offsets, as one array column."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.dialect import DUCK, SPARK, Spark
from maskwright.functions.rules import ADDRESS_NEAR, POSTAL_CONTEXT, RULES, Rule

CANDIDATE = "struct<type:string,start:bigint,end:bigint,cstart:int,cend:int,confidence:double,sources:array<string>>"
_NEAR_BYTES = 60


def cut_value(d: Spark, rule: Rule, value: str) -> str:
    """The value up to its first stop word."""
    if not rule.stops:
        return value
    return d.cut(value, rf"(?i)(?s)(?:\A|[ \t])(?:{'|'.join(rule.stops)})(?:[ \t].*)?\z")


def strip_value(d: Spark, rule: Rule, value: str) -> str:
    return d.cut(value, rf"[{rule.strip}]+\z") if rule.strip else value


def near_address(d: Spark, before: str, after: str, value: str) -> str:
    """An address word within 60 bytes on the line; a letter that the window cuts only guards."""
    words = "|".join(sorted(ADDRESS_NEAR, key=len, reverse=True))
    return d.like(f"({d.window('right', before, _NEAR_BYTES)} || {value} || {d.window('left', after, _NEAR_BYTES)})", rf"(?i)(?:\A|[\x00-\x7F])(?:{words})(?:\z|[\x00-\x7F])")


def holds(d: Spark, rule: Rule, left: str, match: str, value: str, right: str, cut: str, kept: str, before: str, after: str) -> str:
    """Whether a match passes its rule; the arguments are SQL."""
    tests = [("" if want else "NOT ") + d.like(left, p) for p, want in rule.left]
    head = f"({left} || substr({match}, 1, length({match}) - length({value})))"
    tests += [("" if want else "NOT ") + d.like(head, p) for p, want in rule.before_value]
    tail = f"(substr({value}, length({kept}) + 1) || {right})"
    tests += [("" if want else "NOT ") + d.like(tail, p) for p, want in rule.right]
    if rule.words != (0, 1 << 30):
        tests.append(f"{d.count(cut, '[^ \t]+')} BETWEEN {rule.words[0]} AND {rule.words[1]}")
    if rule.group:
        tests.append(f"{kept} <> ''")
    if rule.check:
        tests.append(rule.check(d, kept))
    if rule.window:
        tests.append(f"({d.like(left, POSTAL_CONTEXT[0])} OR {near_address(d, before, after, kept)})")
    return " AND ".join(f"({t})" for t in tests)


_BLOCK = 256  # items of an array that are folded in one go


def let(value: str, name: str, body: str) -> str:
    """``body`` with a value worked out once and named."""
    return f"transform(array({value}), {name} -> {body})[0]"


def prefixes(items: str, zero: str, join: Callable[[str, str], str]) -> str:
    """What the items before each one fold to, for an associative ``join`` of values like ``zero``.

    A fold that builds an array copies it at each step, so it goes by blocks:
    inside each block, then over the blocks' totals.
    """
    fold = lambda array: f"aggregate({array}, named_struct('to', {zero}, 'out', slice(array({zero}), 1, 0)), (s, y) -> named_struct('to', {join('s.to', 'y')}, 'out', concat(s.out, array(s.to))))"
    blocks = f"transform(sequence(0, greatest(size(f_) - 1, 0) div {_BLOCK}), k -> slice(f_, CAST(k * {_BLOCK} + 1 AS INT), {_BLOCK}))"
    inner = f"transform({blocks}, z -> {fold('z')})"
    whole = f"flatten(transform(w_, (w, i) -> transform(w.out, o -> {join('t_.out[i]', 'o')})))"
    few = f"WHEN size(f_) < 2 THEN slice(array({zero}), 1, size(f_)) WHEN size(f_) <= {_BLOCK} THEN {fold('f_')}.out"
    return let(items, "f_", f"CASE {few} ELSE {let(inner, 'w_', let(fold('transform(w_, w -> w.to)'), 't_', whole))} END")


def _cyrillic_only(hint: str) -> bool:
    """Whether each alternative of a hint has a Cyrillic letter, so that a text without one needs no search for it."""
    return all(re.search("[а-яё]", part, re.IGNORECASE) for part in hint.split("|"))


def _found(rule: Rule, text: str) -> str:
    """Spark SQL for the candidates of one rule; ``cyrillic_`` is whether the text has a letter of that script.

    Matches and the gaps between them interleave, so their running lengths are
    the offsets, in characters and bytes; they are taken in one pass, and only
    if a match passes the checks. Matches and gaps are bound once (``b``);
    each match sees the gap before it with the end of the match before that,
    and the gap and match after it. Steps that a rule has no use for are left
    out: each one is interpreted and copies its strings.
    """
    p = SPARK.lit(rule.pattern)
    value = f"regexp_extract_all({text}, {p}, 1)" if rule.group else "array()"
    bound = f"array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1), 'v', {value}))"
    lengths = "transform(b.m, (m, i) -> named_struct('c', length(b.g[i]) + length(m), 'b', CAST(octet_length(b.g[i]) + octet_length(m) AS BIGINT)))"
    before_each = prefixes(lengths, "named_struct('c', 0, 'b', 0L)", lambda x, y: f"named_struct('c', {x}.c + {y}.c, 'b', {x}.b + {y}.b)")
    running = f"transform({before_each}, (p, i) -> named_struct('c', p.c + length(b.g[i]), 'b', p.b + octet_length(b.g[i])))"
    left = "CASE WHEN i = 0 THEN b.g[0] ELSE right(b.m[i - 1], 3) || b.g[i] END"
    right = "CASE WHEN i + 1 = size(b.m) THEN b.g[i + 1] ELSE b.g[i + 1] || b.m[i + 1] END"
    seen = f"transform(b.m, (m, i) -> named_struct('i', i, 'match', m, 'value', {'b.v[i]' if rule.group else 'm'}, 'left', {left}, 'right', {right}))"
    keep = "'i', x.i, 'match', x.match, 'value', x.value, 'left', x.left, 'right', x.right"
    # 80 characters on either side are more than any test of the surroundings looks at; that many and a cut one are in 324 bytes
    stretch = lambda start, size: f"CAST(substring(raw, CAST({start} + 1 AS INT), CAST({size} AS INT)) AS STRING)"
    before = f"substring_index(right({stretch('greatest(o[x.i].b - 324, 0L)', 'least(o[x.i].b, 324L)')}, 80), '\\n', -1)"
    after = f"substring_index(left({stretch('o[x.i].b + octet_length(x.match)', '324')}, 80), '\\n', 1)"
    cut, kept = "x.value", "x.value"
    if rule.stops:
        seen, cut, kept = f"transform({seen}, x -> named_struct({keep}, 'cut', {cut_value(SPARK, rule, 'x.value')}))", "x.cut", "x.cut"
    if rule.strip:
        seen, kept = f"transform({seen}, x -> named_struct({keep}, 'cut', {cut}, 'kept', {strip_value(SPARK, rule, cut)}))", "x.kept"
    good = f"filter({seen}, x -> {holds(SPARK, rule, 'x.left', 'x.match', 'x.value', 'x.right', cut, kept, before, after)})"
    placed = f"transform(q, x -> named_struct('kept', {kept}, 's', o[x.i].b + octet_length(x.match) - octet_length(x.value), 'c', o[x.i].c + length(x.match) - length(x.value)))"
    sources = "array('regex', 'validator')" if rule.validated else "array('regex')"
    out = f"transform({placed}, x -> named_struct('type', '{rule.type}', 'start', x.s, 'end', x.s + octet_length(x.kept), 'cstart', x.c, 'cend', x.c + length(x.kept), 'confidence', 1.0D, 'sources', {sources}))"
    none = f"CAST(array() AS array<{CANDIDATE}>)"
    hint = f"{'cyrillic_ AND ' if _cyrillic_only(rule.hint) else ''}{SPARK.like(text, rule.hint)}"
    if rule.window:
        found = let(f"encode({text}, 'UTF-8')", "raw", let(running, "o", let(good, "q", f"CAST({out} AS array<{CANDIDATE}>)")))
    else:
        found = f"transform(array({good}), q -> CASE WHEN size(q) = 0 THEN {none} ELSE transform(array({running}), o -> CAST({out} AS array<{CANDIDATE}>))[0] END)[0]"
    return f"(CASE WHEN {hint} THEN transform({bound}, b -> {found})[0] ELSE {none} END)"


def bound(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """``docs`` with a column that is worked out once per row.

    The one-element generator is a wall for the optimiser, which would
    otherwise copy a costly expression into each later filter and reference.
    """
    return docs.withColumn(name, F.explode_outer(F.array(value)))


def with_candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", to: str = "candidates") -> DataFrame:
    """``docs`` with an array of candidates of the rules, in order of start, end and type; one pass over the text, no shuffle.

    Confidence is 1. A null text has none.
    """
    every = let(SPARK.like(text, r"\p{IsCyrillic}"), "cyrillic_", f"concat({', '.join(_found(r, text) for r in rules)})")
    return bound(docs, to, in_order(F.expr(every)))


def in_order(candidates: Column) -> Column:
    """Candidates by start, end and type."""
    keyed = F.transform(candidates, lambda c: F.struct(c["start"], c["end"], c["type"], c.alias("c")))
    return F.transform(F.sort_array(keyed), lambda k: k["c"])


def rule_spans_sql(rule: Rule, docs: str, text: str = "text", places: bool = False) -> str:
    """DuckDB SQL for the spans of one rule: doc_id, type, start, end, confidence, sources [, first and last character]."""
    d = DUCK
    return f"""
    SELECT doc_id, '{rule.type}' AS type, s AS start_byte, s + strlen(kept) AS end_byte, 1.0::DOUBLE AS confidence, '{"regex,validator" if rule.validated else "regex"}' AS sources{", c AS cstart, c + length(kept) AS cend" if places else ""} FROM (
      SELECT *, {strip_value(d, rule, "cut")} AS kept, b + strlen(match) - strlen(value) AS s, length(array_to_string(g[1 : i], '') || array_to_string(m[1 : i - 1], '')) + length(match) - length(value) AS c FROM (
        SELECT *, {cut_value(d, rule, "value")} AS cut FROM (
          SELECT doc_id, m, g, i, m[i] AS match, v[i] AS value, right(CASE WHEN i > 1 THEN m[i - 1] ELSE '' END, 3) || g[i] AS left_, g[i + 1] || CASE WHEN i < len(m) THEN m[i + 1] ELSE '' END AS right_,
                 strlen(array_to_string(g[1 : i], '') || array_to_string(m[1 : i - 1], '')) AS b,
                 string_split(substr({text}, 1, length(array_to_string(g[1 : i], '') || array_to_string(m[1 : i - 1], ''))), chr(10))[-1] AS before_,
                 string_split(substr({text}, length(array_to_string(g[1 : i], '') || array_to_string(m[1 : i], '')) + 1), chr(10))[1] AS after_
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, {text}, regexp_extract_all({text}, {d.lit(rule.pattern)}) AS m, regexp_extract_all({text}, {d.lit(rule.pattern)}, {rule.group}) AS v, string_split_regex({text}, {d.lit(rule.pattern)}) AS g FROM {docs}))))
    ) WHERE {holds(d, rule, "left_", "match", "value", "right_", "cut", "kept", "before_", "after_")}"""


def line_left(text: Column, cstart: Column) -> Column:
    """What stands before a place on its line."""
    return F.substring_index(F.substring(text, F.lit(1), cstart), "\n", -1)


def line_right(text: Column, cend: Column) -> Column:
    """What stands after a place on its line."""
    return F.substring_index(F.substring(text, cend + 1, F.length(text)), "\n", 1)
