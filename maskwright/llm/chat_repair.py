"""Repair of conversations: least-cost edits by an automaton of shared suffixes."""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.llm.common import keep, tidy

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: The states of ``(s?(ua)+)?`` read so far: nothing, after s, after u, after a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5  # what edits cost, and an undeleted truncated row
_NEVER = 1 << 60
_LONGEST = (1 << 63) - 1
_CHUNK = 4 << 20  # bytes of texts in a batch of repaired rows


def wanted(state: int) -> str:
    """The only role initial of user and assistant that may follow in a state of the grammar."""
    return "a" if state == USER else "u"


def _relaxed(cost: list[int], pick: list[str]) -> tuple[tuple[int, ...], str]:
    """Inserts taken into account: one moves on in the grammar and stays before the same row."""
    for _ in STEP["u"] | STEP["a"]:
        for state in range(4):
            other = INSERT + cost[STEP[wanted(state)][state]]
            if (other, "I") < (cost[state], pick[state]):
                cost[state], pick[state] = other, "I"
    return tuple(cost), "".join(pick)


def end_node() -> tuple[tuple[int, ...], str]:
    """Cost-to-go and first edit by grammar state where no row is left; ``.`` ends."""
    return _relaxed([0, _NEVER, _NEVER, 0], [".", "~", "~", "."])


def node(symbol: str, below: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Cost-to-go and first edit by grammar state before a row, from those behind it.

    Symbols: ``-`` for a row that must go, else its role initial (``o`` for
    other ones), in upper case if the text is truncated. Edits of equal cost
    differ in their letters, so the least letter gives the least audit.
    """
    cost, pick = [], []
    for state in range(4):
        options = [(DELETE + below[state], "D")]
        if symbol != "-":
            more = CUT_OFF if symbol.isupper() else 0
            role = wanted(state)
            options.append((REROLE + more + below[STEP[role][state]], "R"))
            there = STEP.get(symbol.lower(), {}).get(state)
            if there is not None:
                options.append((more + below[there], "K"))
        best = min(options)
        cost.append(best[0])
        pick.append(best[1])
    return _relaxed(cost, pick)


class Suffixes:
    """The automaton of signatures that come in the order of their reversals: a node is a suffix, held while signatures end in it.

    Signatures in that order share a suffix only with their neighbours, so
    the nodes of one signature are all that is held. Nodes with equal
    differences of costs and equal symbols have equal edits; ``seen`` has those.
    """

    def __init__(self) -> None:
        self.cost, self.pick = [array("q", [x]) for x in end_node()[0]], [end_node()[1]]
        self.last, self.audit = "", None
        self.seen: dict[tuple[str, tuple[int, ...]], tuple[tuple[int, ...], str]] = {}

    def read(self, reversal: str) -> tuple[int, str]:
        """(cost, audit) of a signature by its reversal."""
        if self.audit is not None and reversal == self.last:
            return self.cost[NOTHING][-1], self.audit
        same = 0
        for x, y in zip(self.last, reversal, strict=False):
            if x != y:
                break
            same += 1
        for column in self.cost:
            del column[same + 1 :]
        del self.pick[same + 1 :]
        for symbol in reversal[same:]:
            below = tuple(column[-1] for column in self.cost)
            least = min(below)
            relative = tuple(x - least for x in below)
            found = self.seen.get((symbol, relative))
            if found is None:
                found = self.seen[symbol, relative] = node(symbol, relative)
            for column, x in zip(self.cost, found[0], strict=True):
                column.append(x + least)
            self.pick.append(found[1])
        self.last, self.audit = reversal, self._walk(reversal)
        return self.cost[NOTHING][-1], self.audit

    def _walk(self, reversal: str) -> str:
        out, state, at = [], NOTHING, len(reversal)
        while True:
            letter = self.pick[at][state]
            if letter == ".":
                return "".join(out)
            out.append(letter)
            if letter in "IR":
                state = STEP[wanted(state)][state]
            elif letter == "K":
                state = STEP[reversal[at - 1].lower()][state]
            if letter != "I":
                at -= 1


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults by crc32(conv_id:turn) % 20; nulls count as one blank."""
    key = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    found = rows.select("conv_id", "turn", F.when(key == 4, "user").otherwise(role).alias("role"), F.when(key == 1, "").when(key == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), key.alias("_key")).where("_key <> 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_key") == 3, 2).otherwise(1)))).drop("_key", "_copy")


def diagnosed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one blank), ``fault`` (blank, duplicate, truncated or null) and ``symbol`` of each row.

    A row is blank without a character other than blank and tab to carriage
    return, a duplicate if role and text stood in an earlier row of the
    conversation (by turn, nulls first, then role and text), truncated if its
    last such character is none of ``.!?``; the first of these counts. Blank
    rows are spread, for they need no earlier row: neither they nor one
    conversation's other rows need share a task.
    """
    solid = F.rtrim(F.col("text"), F.lit(SPACE))
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("_end", F.substring(solid, -1, 1))
    apart = F.when(F.col("_end") == "", F.xxhash64("conv_id", "turn"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", apart).orderBy("turn")) > 1
    fault = F.when(F.col("_end") == "", "blank").when(again, "duplicate").when(~F.col("_end").isin(*ENDS), "truncated")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    found = said.withColumn("fault", fault)
    return found.select("conv_id", "turn", "role", "text", "fault", F.when(F.col("fault") == "truncated", F.upper(initial)).when(F.col("fault").isNotNull(), "-").otherwise(initial).alias("symbol"))


def _runs(batches, names: int):
    """(conv_id, first of it, values) of rows that come conversation by conversation; values are the columns after conv_id."""
    last, begun = None, False
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns[:names]), strict=True):
            new = not begun or values[0] != last
            last, begun = values[0], True
            yield values[0], new, values[1:]


def _signed(batches):
    """One row a conversation: its signature and what is counted."""
    out: list[list] = []

    def flush():
        cols = list(zip(*((c, s.decode(), low, high, many, *counts) for c, s, low, high, many, *counts in ((r[0], bytes(r[1]), *r[2:9]) for r in out)), strict=True))
        gaps = [0 if low is None else min(high - low + 1 - many, _LONGEST) for low, high, many in zip(*cols[2:5], strict=True)]
        columns = [pa.array(cols[0], kind), pa.array(cols[1], pa.string()), pa.array(gaps, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[5:9])]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"])

    kind, current, before, turn_before = None, None, "", None
    faults = {"blank": 5, "duplicate": 6, "truncated": 7}

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    for conv, new, (turn, initial, fault, symbol) in _runs(typed(), 5):
        if new:
            if len(out) >= 4096:
                yield flush()
                out = []
            current = [conv, bytearray(), None, None, 0, 0, 0, 0, 0]
            out.append(current)
            turn_before = None
        elif before + initial not in ("su", "ua", "au"):
            current[8] += 1
        current[1] += symbol.encode()
        if fault:
            current[faults[fault]] += 1
        if turn is not None:
            if turn != turn_before:
                current[4] += 1
            current[2] = turn if current[2] is None else current[2]
            current[3] = turn_before = turn
        before = initial
    if out:
        yield flush()


def _again() -> Column:
    """Whether a row is a duplicate: of rows alike in all else, the first is none."""
    return F.coalesce(F.col("fault") == "duplicate", F.lit(False))


def signatures(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``diagnosed`` rows: ``signature`` (its symbols in order), gaps (turns left out between the least and the greatest, nulls aside), blank, duplicate, truncated, illegal (neighbours whose role initials are not su, ua or au)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    sorted_rows = rows.withColumn("_again", _again()).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "_again")
    said = sorted_rows.select("conv_id", F.col("turn").cast("long"), F.substring("role", 1, 1), "fault", "symbol")
    return said.mapInArrow(tidy(_signed), f"conv_id {kind}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def _priced(batches):
    automaton = Suffixes()
    for batch in batches:
        found = [automaton.read(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], names=[*batch.schema.names[:-1], "cost", "audit"])


def edits(signed: DataFrame) -> DataFrame:
    """``signatures`` rows with ``cost`` and ``audit`` of their cheapest edits.

    The rows are dealt in the order of their reversed signatures, so that
    equal suffixes meet: each task builds the part of the automaton that its
    range covers, a node once for all conversations that end in it. Many
    conversations of one signature are split among tasks by conv_id.
    """
    rows = signed.withColumn("_reversal", F.reverse("signature"))
    rows = rows.repartitionByRange("_reversal", "conv_id").sortWithinPartitions("_reversal")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signed.schema)
    return rows.select(*signed.columns, "_reversal").mapInArrow(tidy(_priced), f"{schema}, cost long, audit string")


def _applied(batches):
    kind, out, held = None, [], 0

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    def flush():
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "position", "role", "text", "edit"])

    audit, at, state, place, last = "", 0, NOTHING, 0, None
    for conv, new, (is_row, role, text) in _runs(typed(), 4):
        if new:
            for letter in audit[at:]:
                out.append((last, place, NAMES[wanted(state)], "", letter))
                state, place = STEP[wanted(state)][state], place + 1
            audit, at, state, place, last = text, 0, NOTHING, 0, conv
        if is_row:
            while audit[at] == "I":
                out.append((conv, place, NAMES[wanted(state)], "", "I"))
                state, place, at = STEP[wanted(state)][state], place + 1, at + 1
            letter = audit[at]
            at += 1
            if letter != "D":
                initial = role[:1] if letter == "K" else wanted(state)
                out.append((conv, place, role if letter == "K" else NAMES[initial], text, letter))
                state, place, held = STEP[initial][state], place + 1, held + len(text)
        if held > _CHUNK or len(out) > 8192:
            yield flush()
            out, held = [], 0
    for letter in audit[at:]:
        out.append((last, place, NAMES[wanted(state)], "", letter))
        state, place = STEP[wanted(state)][state], place + 1
    if out:
        yield flush()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations after their edits: conv_id, position, role, text, edit (I, K or R).

    ``rows`` are those of ``diagnosed``, ``found`` those of ``edits``. A
    conversation's rows come together and in order, and stream by its audit: no
    conversation is held in memory. One without rows left has none here.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    nothing = F.lit(None).cast(rows.schema["turn"].dataType)
    audits = found.select("conv_id", F.lit(0).alias("_is_row"), nothing.alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(False).alias("_again"))
    both = rows.select("conv_id", F.lit(1).alias("_is_row"), "turn", "role", "text", _again().alias("_again")).unionByName(audits)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "_is_row", "turn", "role", "text", "_again")
    return both.select("conv_id", "_is_row", "role", "text").mapInArrow(tidy(_applied), f"conv_id {kind}, position long, role string, text string, edit string")


def _hashed(batches):
    kind, names, digests, running = None, [], [], None

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    for conv, new, (_, role, text) in _runs(typed(), 4):
        if new:
            if running is not None:
                digests.append(running.hexdigest())
            if len(digests) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(digests)], names=["conv_id", "repaired_sha256"])
                names, digests = [], []
            names.append(conv)
            running = hashlib.sha256()
        else:
            running.update(b"\n")
        running.update(f"{role}:{text}".encode())
    if running is not None:
        digests.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(digests)], names=["conv_id", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines, from the rows of ``repaired`` as they come."""
    return turns.mapInArrow(tidy(_hashed), f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns): what is wrong with each conversation and its cheapest repair; the repaired conversations.

    ``rows`` has conv_id, turn, role, text; other columns are not read. Edits
    are Keep (no cost), Rerole to user or assistant (1), Delete (2; blank
    rows and duplicates must go) and Insert an empty user or assistant row
    (5); a truncated row that stays costs 5. They give role initials
    ``(s?(ua)+)?``; of the cheapest, those of least audit (initials of the
    edits, in order) are made. A null role or text is one blank; null
    turns come first and count in no gap; null conv_ids are one conversation;
    rows of equal turn come by role and text; a turn is a whole number. An
    empty table gives empty results. A conversation is one row of the report
    and is read as a stream: memory grows by 40 bytes a row of the longest one.
    """
    kept = keep(diagnosed(rows), "diagnosed")
    found = keep(edits(signatures(kept)), "edits")
    return found, repaired(kept, found)


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The report of ``repair`` with ``repaired_sha256``, a row for each conv_id of ``conversations`` (those of ``rows`` by default)."""
    found, turns = repair(rows)
    hashed = digests(turns).withColumnRenamed("conv_id", "_hashed")
    report = found.join(hashed, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left").drop("_hashed")
    if conversations is not None:
        every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
        report = every.join(report, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("_conv", "conv_id")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return report.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
