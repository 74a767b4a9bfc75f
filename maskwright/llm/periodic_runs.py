"""Periodic runs of words: a suffix automaton with link-cut access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import text_slices, tidy

LEAST = 6  # words of a run at least
TIMES = 4  # periods of a run at least
GRAM = 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ROUNDS = 8  # of the sieve; stopping early leaves more to the automaton, never less
_FAR = np.int64(1) << 62


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [first, last) of word numbers outside of which no run can lie, in rising order and apart.

    In a run [s, s + length) of period q, each 4-gram that starts in
    [s + q, s + length - 4] was seen at most q words before: these are
    length - q - 3 starts in a row, two at least and 3q - 3 at least. So of a
    row of m starts with an earlier copy, only those stay whose copy is at
    most (m + 3) / 3 words back, until nothing changes. A stretch is such a
    row, the longest period that it allows before it, and one word more on
    each side. Equal hashes of unlike 4-grams only add starts.
    """
    n = len(ids) - GRAM + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            key = (key + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if len(same) < 2:
        return []
    back = np.full(n, _FAR)
    back[order[same + 1]] = order[same + 1] - order[same]
    here = np.flatnonzero(back < _FAR)
    for _ in range(_ROUNDS):
        new = np.flatnonzero(np.diff(here, prepend=-2) > 1)
        size = np.diff(new, append=len(here))
        most = np.repeat(np.where(size >= 2, (size + GRAM - 1) // (TIMES - 1), 0), size)
        stay = back[here] <= most
        if stay.all():
            break
        here = here[stay]
        if not len(here):
            return []
    new = np.flatnonzero(np.diff(here, prepend=-2) > 1)
    size = np.diff(new, append=len(here))
    new, size = new[size >= 2], size[size >= 2]
    out: list[tuple[int, int]] = []
    for x, m in zip(here[new].tolist(), size.tolist(), strict=True):
        first, last = max(0, x - (m + GRAM - 1) // (TIMES - 1) - 1), min(len(ids), x + m + GRAM)
        while out and first < out[-1][1]:
            before = out.pop()
            first, last = min(first, before[0]), max(last, before[1])
        out.append((first, last))
    return out


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a word sequence as (suffix links, longest lengths, the state of each prefix); state 0 is the empty word."""
    link, longest, to, prefix = [-1], [0], [{}], []
    last = 0
    for word in ids:
        state = len(link)
        longest.append(longest[last] + 1)
        to.append({})
        at = last
        while at >= 0 and word not in to[at]:
            to[at][word] = state
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            found = to[at][word]
            if longest[found] == longest[at] + 1:
                link.append(found)
            else:  # the shorter words of that state end at more places from now on: a state of their own
                link.append(state + 1)
                link.append(link[found])
                longest.append(longest[at] + 1)
                to.append(dict(to[found]))
                link[found] = state + 1
                while at >= 0 and to[at].get(word) == found:
                    to[at][word] = state + 1
                    at = link[at]
        prefix.append(state)
        last = state
    return link, longest, prefix


def _heads(link: list[int], longest: list[int]) -> list[int]:
    """The topmost state of the heavy path that each state lies on, in the tree of suffix links."""
    order = np.argsort(np.asarray(longest), kind="stable").tolist()
    size, heavy, most = [1] * len(link), [-1] * len(link), [0] * len(link)
    for state in reversed(order[1:]):
        up, own = link[state], size[state]
        size[up] += own
        if own > most[up]:
            heavy[up], most[up] = state, own
    head = list(range(len(link)))
    for state in order[1:]:
        if heavy[link[state]] == state:
            head[state] = head[link[state]]
    return head


def runs_of(ids: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``times`` periods and ``least`` words, by start, then period.

    Reading word r accesses the path from its prefix's state to the root of
    the suffix-link tree, as a link-cut tree does: the path breaks into
    segments of states that were last accessed together, at an end c, and all
    of it takes the end r. A segment whose longest suffix has ``size`` words
    ended at c and ends at r: within ``size`` words, the distance r - c is a
    period (the smallest one, as c is the last end) of the words from
    c - size + 1 to r, and the suffix can't be longer to the left. Reading on
    extends the run until the access finds it no more. The automaton is built
    first, so that the tree keeps its shape: each heavy path holds its
    segments as a stack, shallow ones on top, and an access takes from it what
    it covers and puts one back. An access passes log2(n) heavy paths at most.
    """
    link, longest, prefix = automaton(ids)
    head = _heads(link, longest)
    stacks: list[list | None] = [None] * len(link)
    found: dict[tuple[int, int], int] = {}
    ratio = times - 1
    for r, state in enumerate(prefix):
        below = -1  # the end of the segment that reaches up into this path from the one below
        while state > 0:
            top, depth = head[state], longest[state]
            stack = stacks[top]
            if stack is None:
                stacks[top] = [(depth, r)]
            else:
                shallow = stack[-1][1]
                while stack:
                    size, c = stack[-1]
                    if size >= depth:
                        if c != below:
                            d = r - c
                            if depth >= ratio * d and depth + d >= least:
                                found[d, r + 1 - depth - d] = r
                        if size == depth:
                            stack.pop()
                        break
                    d = r - c
                    if size >= ratio * d and size + d >= least:
                        found[d, r + 1 - size - d] = r
                    stack.pop()
                stack.append((depth, r))
                below = shallow
            state = link[top]
    return sorted((start, last + 1 - start, period) for (period, start), last in found.items())


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    table = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) - len(table) < LEAST - 1:
        return []
    ids = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    found = [(first + start, length, period) for first, last in stretches(ids) for start, length, period in runs_of(ids[first:last].tolist())]
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one blank between, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    stays = np.ones(len(words), bool)
    for start, length, period in runs:
        stays[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])


def _find(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        for first, last in text_slices(texts):
            words = [(x or b"").split() for x in texts.slice(first, last - first).to_pylist()]  # bytes.split cuts at blank and tab to carriage return
            runs = [text_runs(x) for x in words]
            short = [collapsed(x, y) for x, y in zip(words, runs, strict=True)]
            columns = [c.slice(first, last - first) for c in batch.columns[:-1]]
            listed = pa.array([[dict(zip(("start", "length", "period"), y, strict=True)) for y in x] for x in runs], pa.list_(_RUN))
            yield pa.RecordBatch.from_arrays([*columns, listed, pa.array(short, pa.binary()).cast(pa.string())], names=[*batch.schema.names[:-1], "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are runs of characters other than blank and tab to carriage return,
    numbered from 0. A run is a stretch of words of smallest period q and of
    max(6, 4q) words at least that no neighbouring word extends; ``collapsed``
    leaves out each run's words after its first q. Nothing is shuffled, and
    rows of equal text or identifier are worked on apart. A null or empty text has no words, no runs and
    an empty ``collapsed``. Other columns are not read. Memory grows with the
    longest repetitive stretch of one text, by about 700 bytes a word.
    """
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_find), f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """A row per row of ``periodic_runs``: doc_id, n_runs, the longest run (ties: first start, then period; four nulls without runs) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text; where the last decimal digit of crc32(doc_id) is 0, with its words from a place on repeated periodically."""
    number = F.crc32(doc_id.cast("string"))
    g = F.floor(number / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    parts = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    turned = F.transform(F.array(parts), lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % s["p"]))), " "))
    return F.when((number % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(turned, F.lit(0))).otherwise(text)
