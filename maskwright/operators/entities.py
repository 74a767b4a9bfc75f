"""From candidates to owned entities: context, overlaps, ownership, policy, masks.

Everything about a document happens inside its row, on arrays of structs: the
text is read once and never shuffled, and no step needs another document.
Candidates are sorted, so duplicates, lines and overlaps are runs of
neighbours; texts are cut by bytes, which costs what the piece is long. Only
within one line's or one cluster's candidates does work grow with the square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.dialect import SPARK
from maskwright.functions.phrases import CLIENT, ORGANIZATION, ORGANIZATION_INN, PASSPORT, POSITIVE, PUBLIC, addressed, present, present_not_negated, promoted_type
from maskwright.functions.registry import ADDRESS_PARTS, HIGH_RISK_TYPES, LINKED_TYPES, NAME_TYPES, REASON_SCORES, REASONS, SOURCES
from maskwright.functions.spans import CANDIDATE, bound, with_candidates, prefixes

PLACED = CANDIDATE.removesuffix(">") + ",line:bigint,left60:string>"
_MERGED = f"struct<c:{PLACED},parts:array<{PLACED}>>"
ENTITY = "struct<type:string,start:bigint,end:bigint,cstart:int,cend:int,confidence:double,sources:array<string>,parts:array<string>,personal:boolean,owner_type:string,owner_id:string,score:double,reasons:array<string>,review:boolean>"


def _list(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _union(arrays: str) -> str:
    return f"filter(array{_list(SOURCES)}, s -> array_contains(flatten({arrays}), s))"


def _struct(c: str, **other: str) -> str:
    fields = ("type", "start", "end", "cstart", "cend", "confidence", "sources", "line", "left60")
    return "named_struct(" + ", ".join(f"'{f}', {other.get(f, f'{c}.{f}')}" for f in fields) + ")"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _runs(array: str, same: str) -> str:
    """Runs of neighbours of an array: ``same`` tells of ``p`` and ``q``, which follows it, whether they belong together."""
    test = same.replace("p.", "a[i - 1].").replace("q.", "a[i].")
    starts = f"filter(transform(a, (x, i) -> i), i -> CASE WHEN i = 0 THEN true ELSE NOT ({test}) END)"
    return _let(array, "a", _let(starts, "s", "transform(s, (b, k) -> slice(a, b + 1, (CASE WHEN k + 1 < size(s) THEN s[k + 1] ELSE size(a) END) - b))"))


def _sorted(array: str, *keys: str) -> str:
    named = ", ".join(f"'k{i}', {k}" for i, k in enumerate(keys))
    return f"transform(sort_array(transform({array}, c -> named_struct({named}, 'c', c))), k -> k.c)"


def _unique(array: str) -> str:
    """Candidates of equal type and span as one, in document order: highest confidence, sources in fixed order; a lone one keeps its own."""
    both = _struct("g[0]", confidence="array_max(transform(g, c -> c.confidence))", sources=_union("transform(g, c -> c.sources)"))
    same = "p.start = q.start AND p.end = q.end AND p.type = q.type"
    return f"transform({_runs(_sorted(array, 'c.start', 'c.end', 'c.type'), same)}, g -> CASE WHEN size(g) = 1 THEN g[0] ELSE {both} END)"


_BYTES = 1024  # bytes of a text whose first line is noted
_BEFORE = 244  # bytes that hold 60 characters and the rest of a cut one


def _text(raw: str, start: str, size: str) -> str:
    """A stretch of bytes as text."""
    return f"CAST(substring({raw}, CAST({start} + 1 AS INT), CAST({size} AS INT)) AS STRING)"


def in_line(docs: DataFrame, text: str = "text", at: str = "candidates") -> DataFrame:
    """Candidates that lie in the text and between characters, with their line's first byte and up to 60 characters before them on it."""
    stretch = _text("raw", f"k * {_BYTES}", str(_BYTES))
    noted = "named_struct('b', s.b + octet_length(t), 'l', CASE WHEN contains(t, '\n') THEN s.b + octet_length(t) - octet_length(substring_index(t, '\n', -1)) ELSE s.l END, 'out', concat(s.out, array(s.l)))"
    lines = f"aggregate(transform(sequence(0, octet_length(raw) div {_BYTES}), k -> {stretch}), named_struct('b', 0L, 'l', 0L, 'out', CAST(array() AS array<bigint>)), (s, t) -> {noted}, s -> s.out)"
    head = _text("raw", f"c.start - c.start % {_BYTES}", f"c.start % {_BYTES}")
    line = _let(head, "h", f"CASE WHEN contains(h, '\n') THEN c.start - octet_length(substring_index(h, '\n', -1)) ELSE lines[CAST(c.start div {_BYTES} AS INT)] END")
    left = f"substring_index(right({_text('raw', f'greatest(c.start - {_BEFORE}, 0)', f'least(c.start, {_BEFORE})')}, 60), '\n', -1)"
    inner = lambda i: f"substring(hex(substring(raw, CAST({i} + 1 AS INT), 1)), 1, 1) IN ('8', '9', 'A', 'B')"  # noqa: E731  a byte that goes on with a character
    valid = f"filter({at}, c -> c.start >= 0 AND c.end > c.start AND c.end <= octet_length(raw) AND NOT {inner('c.start')} AND NOT (c.end < octet_length(raw) AND {inner('c.end')}))"
    placed = _let(f"encode({text}, 'UTF-8')", "raw", _let(lines, "lines", f"transform({valid}, c -> {_struct('c', line=line, left60=left)})"))
    none = f"CAST(array() AS array<{PLACED}>)"
    return bound(docs, at, F.expr(f"CASE WHEN size({at}) > 0 THEN CAST({placed} AS array<{PLACED}>) ELSE {none} END"))


def classify(docs: DataFrame, at: str = "candidates", to: str = "classified") -> DataFrame:
    """Dates and places by context; address parts of a line under an address phrase also make an ADDRESS, which takes in addresses it contains; duplicates merged; document order."""
    parts = f"filter({at}, c -> c.type IN {_list(ADDRESS_PARTS)})"
    block = _struct(
        "g[0]", type="'ADDRESS'", start="array_min(transform(g, c -> c.start))", end="array_max(transform(g, c -> c.end))", cstart="array_min(transform(g, c -> c.cstart))",
        cend="array_max(transform(g, c -> c.cend))", confidence="array_max(transform(g, c -> c.confidence))", sources=_union("transform(g, c -> c.sources)"),
    )
    by_line = _runs(_sorted(parts, "c.line", "c.start", "c.end", "c.type"), "p.line = q.line")
    blocks = f"transform(filter({by_line}, g -> {addressed(SPARK, 'g[0].left60')}), g -> {block})"
    retyped = f"filter(transform({at}, c -> {_struct('c', type=promoted_type(SPARK, 'c.type', 'c.left60'))}), c -> c.type IS NOT NULL)"
    kept = "filter(x.kept, c -> CASE WHEN c.type <> 'ADDRESS' THEN true ELSE NOT exists(x.blocks, b -> b.start <= c.start AND c.end <= b.end) END)"
    every = f"concat({kept}, x.blocks)"
    found = _let(f"named_struct('kept', {retyped}, 'blocks', {blocks})", "x", _let(every, "every", _unique("every")))
    return bound(docs, to, F.expr(f"CAST({found} AS array<{PLACED}>)"))


def _resolved(array: str) -> str:
    """Greedy choice without overlaps, best first; what a winner contains becomes its part, other overlaps go.

    Only candidates of one cluster (a run in document order without a place
    at which none of them goes on) can meet, so each cluster is settled by itself.
    """
    furthest = prefixes("transform(u, c -> c.end)", "-1L", lambda x, y: f"greatest({x}, {y})")
    first = _let(furthest, "m", "filter(transform(u, (c, i) -> i), i -> u[i].start >= m[i])")
    clusters = "transform(f, (b, k) -> slice(u, b + 1, (CASE WHEN k + 1 < size(f) THEN f[k + 1] ELSE size(u) END) - b))"
    tier = "CASE WHEN array_contains(c.sources, 'validator') THEN 3 WHEN array_contains(c.sources, 'regex') THEN 2 ELSE 1 END"
    order = _sorted("g", f"-({tier})", "-c.confidence", "c.start - c.end", "c.start", "c.end", "c.type")
    overlap, inside = "w.c.start < c.end AND c.start < w.c.end", "w.c.start <= c.start AND c.end <= w.c.end"
    new = f"CAST(named_struct('c', c, 'parts', CAST(array() AS array<{PLACED}>)) AS {_MERGED})"
    step = f"""CASE WHEN NOT exists(acc, w -> {overlap}) THEN concat(acc, array({new}))
        WHEN exists(acc, w -> {inside}) THEN transform(acc, w -> CASE WHEN {inside} THEN CAST(named_struct('c', w.c, 'parts', concat(w.parts, array(c))) AS {_MERGED}) ELSE w END) ELSE acc END"""
    won = f"aggregate({order}, CAST(array() AS array<{_MERGED}>), (acc, c) -> {step})"
    settled = f"transform(sort_array(transform({won}, w -> named_struct('s', w.c.start, 'e', w.c.end, 't', w.c.type, 'w', w))), k -> k.w)"
    alone = f"array(CAST(named_struct('c', g[0], 'parts', CAST(array() AS array<{PLACED}>)) AS {_MERGED}))"
    return _let(_unique(array), "u", _let(first, "f", f"flatten(transform({clusters}, g -> CASE WHEN size(g) = 1 THEN {alone} ELSE {settled} END))"))


def merge(docs: DataFrame, at: str = "classified", to: str = "merged") -> DataFrame:
    """Array of (c: winner, parts: contained candidates) in document order."""
    return bound(docs, to, F.expr(f"CAST({_resolved(at)} AS array<{_MERGED}>)"))


def _assessed(array: str, text: str, disabled: bool) -> str:
    """Owner, score and reasons of merged entities; ids number the lines of persons and of organisations."""
    value, after = _text("raw", "e.c.start", "e.c.end - e.c.start"), _text("raw", "e.c.end", str(_BEFORE))
    and_after = f"v || CASE WHEN contains(v, '\n') THEN '' ELSE left(substring_index({after}, '\n', 1), 60) END"
    low = f"lower(e.c.left60 || {_let(value, 'v', and_after)})"
    has = lambda kinds: f"(e.c.type IN {_list(kinds)} OR exists(e.parts, p -> p.type IN {_list(kinds)}))"
    seen = f"transform({array}, e -> named_struct('e', e, 'line', e.c.line, 'low', {low}, 'name', {has(NAME_TYPES)}, 'linked', {has(LINKED_TYPES)}, 'risk', e.c.type IN {_list(HIGH_RISK_TYPES)}))"
    linked = "(x.name AND h.linked) OR (x.linked AND h.name)"
    tests = {"client_context": present(SPARK, "x.low", CLIENT), "passport_context": present(SPARK, "x.low", (PASSPORT,)), "positive_context": present_not_negated(SPARK, "x.low", POSITIVE), "linked_entities": linked, "field_label": "x.risk"}
    reasons = "filter(array(" + ", ".join(f"CASE WHEN {t} THEN '{r}' END" for r, t in tests.items()) + "), r -> r IS NOT NULL)"
    kind = f"""CASE WHEN {present(SPARK, 'x.low', ORGANIZATION_INN)} THEN 'ORGANIZATION' WHEN NOT x.risk AND {present(SPARK, 'x.low', ORGANIZATION)} THEN 'ORGANIZATION'
        WHEN NOT x.risk AND {present(SPARK, 'x.low', PUBLIC)} THEN 'PUBLIC' END"""
    owner = "CASE WHEN y.kind IS NOT NULL THEN y.kind WHEN size(y.why) > 0 THEN 'PERSON' ELSE 'UNKNOWN' END"
    said = "CASE y.kind WHEN 'ORGANIZATION' THEN array('organization_context') WHEN 'PUBLIC' THEN array('public_context') ELSE CASE WHEN size(y.why) > 0 THEN y.why ELSE array('ambiguous_context') END END"
    decided = f"named_struct('kind', {kind}, 'why', {reasons})"
    in_line = f"transform(h.g, x -> {_let(decided, 'y', f"named_struct('e', x.e, 'owner', {owner}, 'why', {said})")})"
    line = _let("named_struct('g', g, 'name', exists(g, x -> x.name), 'linked', exists(g, x -> x.linked))", "h", in_line)
    by_line = f"transform({_runs(_let(f"encode({text}, 'UTF-8')", 'raw', seen), 'p.line = q.line')}, g -> {line})"
    # the lines of each kind of owner are numbered in order
    person, organization = "exists(g, x -> x.owner = 'PERSON')", "exists(g, x -> x.owner = 'ORGANIZATION')"
    counts = f"transform(l, g -> named_struct('p', CAST({person} AS INT), 'o', CAST({organization} AS INT)))"
    numbers = f"transform({prefixes(counts, "named_struct('p', 0, 'o', 0)", lambda x, y: f"named_struct('p', {x}.p + {y}.p, 'o', {x}.o + {y}.o)")}, x -> named_struct('p', x.p + 1, 'o', x.o + 1))"
    best = "array_max(transform(x.why, r -> CASE r " + " ".join(f"WHEN '{r}' THEN {s}D" for r, s in REASON_SCORES.items()) + " ELSE 0.0D END))"
    score = f"CASE x.owner WHEN 'PERSON' THEN {best} WHEN 'UNKNOWN' THEN 0.3D ELSE 0.9D END"
    ident = "CASE x.owner WHEN 'PERSON' THEN 'person-' || m[i].p WHEN 'ORGANIZATION' THEN 'organization-' || m[i].o ELSE '' END" if not disabled else "''"
    why = f"filter(array{_list(REASONS)}, r -> array_contains(x.why, r) OR r = 'type_disabled_by_policy')" if disabled else "x.why"
    fields = ", ".join(f"'{f}', x.e.c.{f}" for f in ("type", "start", "end", "cstart", "cend", "confidence", "sources"))
    out = f"""named_struct({fields}, 'parts', transform({_sorted('array_distinct(x.e.parts)', 'c.start', 'c.end', 'c.type')}, p -> p.type || ':' || p.start || '-' || p.end), 'personal', {'false' if disabled else "x.owner = 'PERSON'"}, 'owner_type', x.owner,
        'owner_id', {ident}, 'score', {score}, 'reasons', {why}, 'review', x.owner = 'UNKNOWN')"""
    return f"CAST({_let(by_line, 'l', _let(numbers, 'm', f'flatten(transform(l, (g, i) -> transform(g, x -> {out})))'))} AS array<{ENTITY}>)"


def assess(docs: DataFrame, text: str = "text", at: str = "merged", to: str = "entities") -> DataFrame:
    """Who owns each entity and why."""
    return bound(docs, to, F.expr(_assessed(at, text, False)))


def apply_policy(docs: DataFrame, allowed: tuple[str, ...], at: str = "entities") -> DataFrame:
    """Personal entities of other types are no longer personal and say why."""
    fields = [f.split(":")[0] for f in ENTITY.removeprefix("struct<").replace("array<string>", "a").split(",")]
    hit = f"e.personal AND e.type NOT IN {_list(allowed or ('',))}"
    other = {"personal": f"e.personal AND NOT ({hit})", "reasons": f"CASE WHEN {hit} THEN filter(array{_list(REASONS)}, r -> array_contains(e.reasons, r) OR r = 'type_disabled_by_policy') ELSE e.reasons END"}
    return bound(docs, at, F.expr(f"CAST(transform({at}, e -> named_struct({', '.join(f"'{f}', {other.get(f, f'e.{f}')}" for f in fields)})) AS array<{ENTITY}>)"))


def detect(docs: DataFrame, allowed: tuple[str, ...] | None = None, text: str = "text", models: str | None = None, to: str = "entities") -> DataFrame:
    """Rules (and an array column of model candidates) to entities.

    With ``allowed``, candidates of other types are resolved and assessed by
    themselves; their entities are reported as not personal unless they
    overlap one of an allowed type.
    """
    names = docs.columns
    found = with_candidates(docs, text=text)
    if models:
        found = found.withColumn("candidates", F.concat("candidates", F.coalesce(models, F.expr(f"CAST(array() AS array<{CANDIDATE}>)"))))
    found = classify(in_line(found, text))
    if allowed is None:
        return assess(merge(found), text, to=to).select(*names, to)
    split = found.withColumns({"_on": F.expr(f"filter(classified, c -> c.type IN {_list(allowed or ('',))})"), "_off": F.expr(f"filter(classified, c -> c.type NOT IN {_list(allowed or ('',))})")})
    split = merge(merge(split, "_on", "_on_won"), "_off", "_off_won")
    split = bound(bound(split, "_on", F.expr(_assessed("_on_won", text, False))), "_off", F.expr(_assessed("_off_won", text, True)))
    both = "concat(_on, filter(_off, d -> NOT exists(_on, a -> d.start < a.end AND a.start < d.end)))"
    return bound(split, to, F.expr(_sorted(both, "c.start", "c.end", "c.type"))).select(*names, to)


def masked(docs: DataFrame, which: str = "e.personal", by: str = "'<' || e.type || '>'", text: str = "text", at: str = "entities", to: str = "masked") -> DataFrame:
    """``text`` with the chosen entities replaced; entities do not overlap, so the stretches between them are joined in one pass. ``value`` in ``by`` is the entity's text."""
    gap = _text("raw", "CASE WHEN i = 0 THEN 0 ELSE c[i - 1].end END", "e.start - CASE WHEN i = 0 THEN 0 ELSE c[i - 1].end END")
    piece = f"{gap} || {_let(_text('raw', 'e.start', 'e.end - e.start'), 'value', by)}"
    tail = _text("raw", "CASE WHEN size(c) = 0 THEN 0 ELSE c[size(c) - 1].end END", f"octet_length({text})")
    joined = _let(_sorted(f"filter({at}, e -> {which})", "c.start"), "c", f"array_join(transform(c, (e, i) -> {piece}), '') || {tail}")
    return bound(docs, to, F.expr(_let(f"encode({text}, 'UTF-8')", "raw", joined)))


def rows(docs: DataFrame, at: str = "entities", *names: str) -> DataFrame:
    """A flat row per entity."""
    out = docs.select(*(names or ("doc_id",)), F.explode_outer(at).alias("e")).where("e is not null")
    return out.select(
        *(names or ("doc_id",)), "e.type", F.col("e.start").alias("start_byte"), F.col("e.end").alias("end_byte"), "e.confidence", F.array_join("e.sources", ",").alias("sources"), F.array_join("e.parts", ",").alias("parts"),
        "e.personal", "e.owner_type", "e.owner_id", "e.score", F.array_join("e.reasons", ",").alias("reasons"), "e.review",
    )
