"""DuckDB SQL of operators that take more than a few lines."""

from __future__ import annotations

#: The table of the CRC-32 polynomial, from its bits.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"


def crc32_of(text: str, table: str = "crc") -> str:
    """The unsigned crc32 of an ASCII string that is not empty; ``table`` names a column with ``CRC_TABLE``."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, {table}[CAST((xor(c, b) & 255) + 1 AS INTEGER)]), 4294967295), 4294967295)"


PERIODIC_RUNS = rf"""
    WITH t AS (SELECT {CRC_TABLE} AS crc),
    c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_of("CAST(doc_id AS VARCHAR)")} AS h FROM documents, t),
    g AS (SELECT *, len(w) AS n, h // 10 AS g FROM c),
    a AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM g),
    d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM a),
    u AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
    j AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
    s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM j),
    r AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY doc_id, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6),
    m AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY doc_id, start, length),
    b AS (
      SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM m GROUP BY doc_id),
    k AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = u.doc_id AND u.i >= m.start + m.period AND u.i < m.start + m.length) GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
           CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
    """


def _repair_step(state: int) -> str:
    """The best continuation before a row from a grammar state, inserts aside, as a list of structs; q0 to q3 are those behind the row."""
    names = {"u": "user", "a": "assistant"}
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    want = "a" if state == 2 else "u"

    def option(when: str, cost: str, letter: str, to: int, line: str | None) -> str:
        said = f"q{to}.t" if line is None else f"list_prepend({line}, q{to}.t)"
        return f"CASE WHEN {when} AND q{to} IS NOT NULL THEN struct_pack(c := q{to}.c + {cost}, a := '{letter}' || q{to}.a, t := {said}) END"

    options = [option("true", "2", "D", state, None), option("NOT gone", "1 + more", "R", after[want], f"'{names[want]}:' || text")]
    options += [option(f"NOT gone AND initial = '{x}'", "more", "K", to, "role || ':' || text") for x, to in after.items()]
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _with_insert(state: int) -> str:
    """The same with up to two inserts before the row."""
    to, name = (3, "assistant") if state == 2 else (2, "user")
    then, other = (2, "user") if to == 3 else (3, "assistant")
    once = f"CASE WHEN b{to} IS NOT NULL THEN struct_pack(c := b{to}.c + 5, a := 'I' || b{to}.a, t := list_prepend('{name}:', b{to}.t)) END"
    twice = f"CASE WHEN b{then} IS NOT NULL THEN struct_pack(c := b{then}.c + 10, a := 'II' || b{then}.a, t := list_prepend('{name}:', list_prepend('{other}:', b{then}.t))) END"
    return f"list_min(list_filter([b{state}, {once}, {twice}], lambda x: x IS NOT NULL))"


_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]))"
_DONE = "struct_pack(c := CAST(0 AS BIGINT), a := '', t := CAST([] AS VARCHAR[]))"
CHAT_REPAIR = rf"""
    WITH RECURSIVE t AS (SELECT {CRC_TABLE} AS crc),
    k AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {crc32_of("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
      FROM conversations, t),
    d AS (
      SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
      FROM k WHERE k <> 0),
    m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS tail FROM d),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM m),
    f AS (
      SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, substr(role, 1, 1) AS initial,
             lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
      FROM n),
    g AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f),
    s AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
      FROM g GROUP BY conv_id),
    r AS (
      SELECT conv_id, n AS i, {_DONE} AS b0, {_NONE} AS b1, {_NONE} AS b2, {_DONE} AS b3 FROM s
      UNION ALL
      SELECT conv_id, i, {_repair_step(0)}, {_repair_step(1)}, {_repair_step(2)}, {_repair_step(3)}
      FROM (
        SELECT r.conv_id, r.i - 1 AS i, g.role, g.text, g.initial, g.gone, g.more,
               {_with_insert(0)} AS q0, {_with_insert(1)} AS q1, {_with_insert(2)} AS q2, {_with_insert(3)} AS q3
        FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i)),
    b AS (SELECT conv_id, {_with_insert(0)} AS best FROM r WHERE i = 0)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
    """
