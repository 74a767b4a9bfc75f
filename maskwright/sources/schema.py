"""JSON Schema compiled to expressions over VARIANT: the breaches of each body, with their places."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import bound, let

BREACH = "struct<path:string,keyword:string>"
_NONE = f"CAST(array() AS array<{BREACH}>)"
_END = "end of the body"
# Keywords that say nothing about whether a value is valid.
ANNOTATIONS = ("$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format")
_TYPES = ("object", "array", "string", "boolean", "null", "number", "integer")


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _breach(path: str, keyword: str) -> str:
    return f"named_struct('path', {path}, 'keyword', '{keyword}')"


class _Compiler:
    """SQL for the breaches of one schema; values are named by their depth."""

    def __init__(self, root: Any) -> None:
        self.root = root

    def target(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise ValueError(f"{ref}: only references into the same schema are followed")
        found = self.root
        for step in ref[1:].split("/")[1:]:
            found = found[int(step)] if isinstance(found, list) else found[step.replace("~1", "/").replace("~0", "~")]
        return found

    def node(self, schema: Any, value: str, path: str, depth: int = 0, refs: tuple[str, ...] = ()) -> str:
        """SQL of the breaches of ``value`` (a VARIANT) at ``path``."""
        if schema is True or schema == {}:
            return _NONE
        if schema is False:
            return f"array({_breach(path, 'false')})"
        x, p, f = f"x{depth}", f"p{depth}", f"f{depth}"
        # what the value is decides which keywords look at it
        facts = f"named_struct('m', try_variant_get({x}, '$', 'map<string,variant>'), 'a', try_variant_get({x}, '$', 'array<variant>'), 'd', try_variant_get({x}, '$', 'decimal(38,18)'), 'n', try_variant_get({x}, '$', 'double'))"
        scalar = f"schema_of_variant({x})"
        kind = (
            f"CASE WHEN {f}.m IS NOT NULL THEN 'object' WHEN {f}.a IS NOT NULL THEN 'array' ELSE CASE {scalar} WHEN 'STRING' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VOID' THEN 'null' WHEN 'BIGINT' THEN 'integer' "
            f"ELSE CASE WHEN {scalar} LIKE '%,0)' OR {scalar} = 'DOUBLE' AND {f}.n = floor({f}.n) THEN 'integer' ELSE 'number' END END END"
        )
        parts = [part for key, said in schema.items() for part in self.keyword(key, said, schema, depth, refs)]
        if not parts:
            return _NONE
        body = f"concat({', '.join(parts)})"
        return let(value, x, let(path, p, let(facts, f, let(kind, f"k{depth}", body))))

    def keyword(self, key: str, said: Any, schema: dict, depth: int, refs: tuple[str, ...]) -> list[str]:
        x, p, f, k = f"x{depth}", f"p{depth}", f"f{depth}", f"k{depth}"
        number = f"{k} IN ('integer', 'number')"
        when = lambda test: [f"CASE WHEN {test} THEN array({_breach(p, key)}) ELSE {_NONE} END"]
        inner = lambda s, v, at: self.node(s, v, at, depth + 1, refs)
        under = lambda name: f"concat({p}, '/', replace(replace({name}, '~', '~0'), '/', '~1'))"
        # a value of another kind has no size; null fails no test
        size = {"Length": f"CASE WHEN {k} = 'string' THEN char_length(try_variant_get({x}, '$', 'string')) END", "Items": f"size({f}.a)", "Properties": f"size(map_keys({f}.m))"}
        match key:
            case _ if key in ANNOTATIONS:
                return []
            case "$ref":
                if said in refs:
                    raise ValueError(f"{said} refers to itself: a schema must have a depth")
                return [self.node(self.target(said), x, p, depth + 1, (*refs, said))]
            case "type":
                names = [said] if isinstance(said, str) else list(said)
                if set(names) - set(_TYPES):
                    raise ValueError(f"no types: {sorted(set(names) - set(_TYPES))}")
                return when(f"{k} NOT IN ({', '.join(map(_text, names + ['integer'] * ('number' in names)))})")
            case "const":
                return when(f"NOT {self.equal(said, x, f, k)}")
            case "enum":
                return when(f"NOT ({' OR '.join(self.equal(v, x, f, k) for v in said) or 'false'})")
            case "minimum" | "maximum" | "exclusiveMinimum" | "exclusiveMaximum":
                sign = {"minimum": "<", "maximum": ">", "exclusiveMinimum": "<=", "exclusiveMaximum": ">="}[key]
                return when(f"{number} AND {self.compared(sign, said, f)}")
            case "multipleOf":
                return when(f"{number} AND coalesce({f}.d % CAST('{said}' AS DECIMAL(38,18)) <> 0, {f}.n % {float(said)!r}D <> 0)")
            case "pattern":
                return when(f"{k} = 'string' AND NOT regexp_like(try_variant_get({x}, '$', 'string'), {_text(said)})")
            case "uniqueItems":
                return when(f"size(array_distinct(transform({f}.a, u -> to_json(u)))) < size({f}.a)") if said else []
            case "required":
                return [f"CASE WHEN {f}.m IS NOT NULL AND NOT map_contains_key({f}.m, {_text(n)}) THEN array({_breach(under(_text(n)), key)}) ELSE {_NONE} END" for n in said]
            case "properties":
                return [f"CASE WHEN map_contains_key({f}.m, {_text(n)}) THEN {inner(s, f'{f}.m[{_text(n)}]', under(_text(n)))} ELSE {_NONE} END" for n, s in said.items()]
            case "additionalProperties":
                known = f"array({', '.join(map(_text, schema.get('properties', {})))})"
                more = f"array_except(map_keys({f}.m), CAST({known} AS array<string>))"
                found = f"array({_breach(under(f'e{depth}'), key)})" if said is False else inner(said, f"{f}.m[e{depth}]", under(f"e{depth}"))
                return [f"coalesce(flatten(transform({more}, e{depth} -> {found})), {_NONE})"]
            case "prefixItems":
                return [f"CASE WHEN size({f}.a) > {i} THEN {inner(s, f'{f}.a[{i}]', f'''concat({p}, '/{i}')''')} ELSE {_NONE} END" for i, s in enumerate(said)]
            case "items":
                rest = f"slice({f}.a, {len(schema.get('prefixItems', ())) + 1}, size({f}.a))"
                place = f"concat({p}, '/', CAST(i{depth} + {len(schema.get('prefixItems', ()))} AS STRING))"
                return [f"coalesce(flatten(transform({rest}, (e{depth}, i{depth}) -> {inner(said, f'e{depth}', place)})), {_NONE})"]
            case "allOf":
                return [inner(s, x, p) for s in said]
            case "anyOf" | "oneOf":
                fits = " + ".join(f"IF(size({inner(s, x, p)}) = 0, 1, 0)" for s in said)
                return when(f"{fits} {'= 0' if key == 'anyOf' else '<> 1'}")
            case "not":
                return when(f"size({inner(said, x, p)}) = 0")
            case _ if key[:3] in ("min", "max") and key[3:] in size:
                return when(f"{size[key[3:]]} {'<' if key[:3] == 'min' else '>'} {int(said)}")
        raise ValueError(f"{key}: this keyword is not checked")

    def equal(self, said: Any, x: str, f: str, k: str) -> str:
        if isinstance(said, (int, float)) and not isinstance(said, bool):
            return f"({k} IN ('integer', 'number') AND {self.compared('=', said, f)})"
        return f"(to_json({x}) = to_json(parse_json({_text(json.dumps(said))})))"

    def compared(self, sign: str, said: Any, f: str) -> str:
        """Numbers by their 18 decimal places; those that a decimal can't hold as floating point."""
        return f"coalesce({f}.d {sign} TRY_CAST('{said}' AS DECIMAL(38,18)), {f}.n {sign} {float(said)!r}D)"


def breaches(schema: Any, body: str) -> str:
    """Spark SQL for the breaches of the text ``body``; see ``checked``."""
    # the parser stops after the first value; in a list with an end mark, anything beside that value shows
    listed = f"try_variant_get(try_parse_json(concat('[', {body}, ',\"{_END}\"]')), '$', 'array<variant>')"
    whole = f"size(l_) = 2 AND try_variant_get(l_[1], '$', 'string') = '{_END}'"
    wrong = f"array({_breach(_text(''), 'json')})"
    return let(listed, "l_", f"CASE WHEN {whole} THEN {_Compiler(schema).node(schema, 'l_[0]', _text(''))} ELSE {wrong} END")


def checked(docs: DataFrame, schema: Any, body: str = "body", to: str = "breaches") -> DataFrame:
    """``docs`` with an array of (path, keyword) of what in the text ``body`` breaches the JSON Schema (2020-12), in order, each once.

    Paths are JSON pointers; a missing or additional property has its own.
    ``json`` at the root: null, no JSON, more than one value, or an object
    that has a key twice. A schema is inlined, so that references which lead
    back to themselves are an error, as are keywords that are not checked
    (``patternProperties``, ``contains``, ``if`` and the like): none is
    passed over silently but annotations. A branch of ``anyOf``, ``oneOf`` or
    ``not`` counts whole; its own breaches are not listed. Patterns are Java's.
    The work on a body is one pass inside its row: no shuffle, no Python.
    """
    return bound(docs, to, F.array_sort(F.array_distinct(F.expr(breaches(schema, f"`{body}`")))))
