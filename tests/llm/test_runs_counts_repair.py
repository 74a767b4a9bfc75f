"""Periodic runs, token counts and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random

import pyarrow as pa
import pytest

from maskwright.llm import chat_repair, periodic_runs, token_counts
from maskwright.llm.queries import byte_bpe, piece_model

# --- periodic runs


def plain_runs(ids):
    """Every stretch of words that agree with the one q words on, for each q."""
    best = {}
    for q in range(1, len(ids) // 4 + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            if j - i >= 3 * q and j - i + q >= 6:
                best[i, j - i + q] = min(q, best.get((i, j - i + q), q))
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def made_words(rnd):
    kinds, ids = rnd.choice([1, 2, 3, 5, 9]), []
    while len(ids) < rnd.choice([0, 5, 12, 40, 120]):
        unit = [rnd.randrange(kinds) for _ in range(rnd.randrange(1, 8))]
        ids += (unit * 7)[: rnd.randrange(1, 7 * len(unit))] if rnd.random() < 0.5 else unit
    return ids


def test_runs_are_those_of_all_periods():
    rnd = random.Random(11)
    for _ in range(1500):
        ids = made_words(rnd)
        want = plain_runs(ids)
        assert sorted(periodic_runs.runs_of(ids)) == want, ids
        assert sorted(periodic_runs.text_runs([b"%d" % x for x in ids])) == want, ids  # with the sieve


def test_the_sieve_leaves_out_what_holds_no_run():
    rnd = random.Random(12)
    words = [b"%d" % rnd.randrange(50_000) for _ in range(5000)]
    words[2000:2040] = [b"a", b"b"] * 20
    ids = periodic_runs.np.unique(words, return_inverse=True)[1]
    assert sum(b - a for a, b in periodic_runs.stretches(ids)) < 100
    assert periodic_runs.text_runs(words) == [(2000, 40, 2)]


def test_run_rows(spark):
    rows = [(1, "a a a a a a", 0), (2, None, 0), (3, "", 0), (4, " \t\n", 0), (1, "x a b a b a b a b y", 0), (None, "q " * 9, 0), (5, "a b c d e f g h", 0), (6, ("x y z " * 6 + "w ") * 4, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = periodic_runs.periodic_runs(docs)
    got = sorted(((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=str)
    want = []
    for i, text, _ in rows:
        words = (text or "").split()
        runs = plain_runs(words)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i or -1, runs, " ".join(w for k, w in enumerate(words) if k not in drop)))
    assert got == sorted(want, key=str)
    digests = {(r.doc_id, r.start): r for r in periodic_runs.run_digests(found).collect()}
    six = digests[6, 0]
    assert (six.n_runs, six.length, six.period, six.exponent_milli) == (5, 76, 19, 4000)
    assert six.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in plain_runs(rows[7][1].split())).encode()).hexdigest()
    assert digests[2, None].runs_sha256 == digests[2, None].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_a_long_run_takes_linear_time():
    """One word 200 000 times, and the words of Fibonacci: steps a word stay few."""
    assert periodic_runs.text_runs([b"x"] * 200_000) == [(0, 200_000, 1)]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 50_000:
        a, b = b, b + a
    assert periodic_runs.text_runs(b) == []  # its exponents stay below 3.62


# --- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe())


PARTS = ["a", "Hello", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "!?", "é", "ß", "漢字", "　", "\xa0", "\x85", "\x1c", "\x1f", "0", "3.5", "😀", "naïve", " x", "привет", " ", "_", "<|endoftext|>", "\0", "a\0", "̈", "'LL", "'", " '", "\x7f", "ǅ", "w" * 70]


def test_counts_are_the_librarys(spark, library):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 14))) for _ in range(4000)]
    rows = [*enumerate(texts), (-1, None), (-2, ""), (7, texts[7]), (None, "x"), (-3, "word and more. " * 20_000)]
    docs = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, over_limit boolean").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, byte_bpe(), limit=20).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == sorted(((*x, x[2] > 20) for x in want), key=str)
    assert token_counts.token_counts(docs.limit(0), byte_bpe()).count() == 0


def test_counts_with_and_without_the_table(library):
    rnd = random.Random(5)
    texts = pa.array(["".join(rnd.choice(PARTS) for _ in range(12)).encode() for _ in range(500)], pa.binary())
    raw, _, start, size = token_counts._pieces(texts)
    pieces = {raw.tobytes()[i : i + n] for i, n in zip(start.tolist(), size.tolist(), strict=True) if n <= 16}
    lengths = {p: len(library.encode(p.decode(), add_special_tokens=False).ids) for p in pieces if b"<|endoftext|>" not in p}
    want = [len(library.encode(t.decode(), add_special_tokens=False).ids) for t in texts.to_pylist()]
    for table in (token_counts.build_table(lengths), token_counts.build_table({})):
        assert token_counts.TwoTier(byte_bpe(), table).counts(texts).tolist() == want
    full = token_counts.build_table(lengths)
    known = {p for p in lengths if 0 < len(p) <= 16 and not p.endswith(b"\0")}
    assert (full[2] > 0).sum() >= 0.99 * len(known)


def test_counts_of_a_sentencepiece_model(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = ["Hello there, Ödipus!", "", None, "  a\n\nb <s>", "漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, piece_model()).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


# --- conversation repair


def plain_repair(symbols):
    """Least (cost, audit) by Dijkstra's search over all edits."""
    step = chat_repair.STEP
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(symbols) and state in (0, 3):
            return cost, audit
        for role in "ua":
            if state in step[role]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, step[role][state]))
                if at < len(symbols) and symbols[at] != "-":
                    heapq.heappush(heap, (cost + 1 + 5 * symbols[at].isupper(), audit + "R", at + 1, step[role][state]))
        if at < len(symbols):
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            kept = step.get(symbols[at].lower(), {}).get(state)
            if kept is not None:
                heapq.heappush(heap, (cost + 5 * symbols[at].isupper(), audit + "K", at + 1, kept))
    raise AssertionError(symbols)


def test_audits_are_the_cheapest_and_least():
    rnd = random.Random(6)
    made = {"".join(rnd.choice("suaSUAoO-uaua") for _ in range(rnd.randrange(0, 12))) for _ in range(3000)}
    automaton = chat_repair.Suffixes()
    for reversal in sorted(x[::-1] for x in made):
        assert automaton.read(reversal) == plain_repair(reversal[::-1]), reversal
    assert len(automaton.seen) < 200  # nodes that differ in their cost-to-go are few


CHAT = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello!"),
    (2, 0, "assistant", "Oh."), (2, 2, "assistant", "cut off"), (2, 5, "user", "What?"),
    (3, 0, "user", " \t"), (3, 1, None, None),
    (4, None, "system", "Be kind."), (4, 1, "user", "Say."), (4, 1, "user", "Say."), (4, 2, "assistant", "Said."), (4, 2, "assistant", "Said."),
    (None, 7, "tool", "x."), (None, 9, "", "y."),
    (5, 0, "user", "Long " * 60_000 + "."), (5, 1, "assistant", "A."),
]


def test_repair_by_hand(spark):
    rows = spark.createDataFrame([(*x, "extra") for x in CHAT], "conv_id long, turn long, role string, text string, cost string").repartition(4)
    report, turns = chat_repair.repair(rows)
    got = {r.conv_id: (r.signature, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    assert got == {
        1: ("ua", 0, 0, 0, 0, 0, 0, "KK"),
        2: ("aAu", 3, 0, 0, 1, 1, *plain_repair("aAu")),
        3: ("--", 0, 2, 0, 0, 1, 4, "DD"),
        4: ("su-a-", 0, 0, 2, 0, 2, 4, "KKDKD"),
        None: ("oo", 1, 0, 0, 0, 1, 2, "RR"),
        5: ("ua", 0, 0, 0, 0, 0, 0, "KK"),
    }
    said = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position)):
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert said[4] == [("system", "Be kind."), ("user", "Say."), ("assistant", "Said.")]
    assert said[None] == [("user", "x."), ("assistant", "y.")] and 3 not in said
    full = {r.conv_id: r for r in chat_repair.repair_report(rows, rows.union(rows.limit(1).withColumn("conv_id", chat_repair.F.lit(99).cast("long")))).collect()}
    assert set(full) == {1, 2, 3, 4, 5, 99, None}
    assert (full[99].cost, full[99].audit, full[99].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert full[5].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said[5]).encode()).hexdigest()
    assert chat_repair.repair_report(rows.limit(0)).count() == 0


def test_inserts_fill_what_is_missing(spark):
    rows = spark.createDataFrame([(1, i, "user", f"q{i}　cut" if i == 1 else f"q{i}.") for i in range(3)], "conv_id long, turn long, role string, text string")
    report, turns = chat_repair.repair(rows)
    found = report.first()
    assert (found.cost, found.audit) == plain_repair("uUu")
    assert [r.edit for r in turns.orderBy("position").collect()] == [x for x in found.audit if x != "D"]
    only = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "Q.")], "conv_id long, turn long, role string, text string")
    assert chat_repair.repair(only)[0].first().audit == plain_repair("su")[1]


def test_one_long_conversation_streams(spark):
    rows = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text")
    report, turns = chat_repair.repair(rows)
    found = report.first()
    assert (found.cost, found.audit) == (0, "K" * 20_000)
    want = hashlib.sha256("\n".join(f"{('user', 'assistant')[i % 2]}:t{i}." for i in range(20_000)).encode()).hexdigest()
    assert chat_repair.digests(turns).first().repaired_sha256 == want
