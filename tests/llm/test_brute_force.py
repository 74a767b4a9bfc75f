"""Operators and stages that SQL cannot express, held against plain versions of themselves."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm.common import mix64
from maskwright.llm.language_id import DIMENSIONS, Space, identify, train
from maskwright.llm.mixing import mix
from maskwright.llm.queries import REPETITIONS, piece_model
from maskwright.llm.sentencepiece_sampling import SPACE, Vocabulary, lattice, sample_segmentations, sample_top_k, segmentations
from tests.llm.test_operators import brute_components

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


# --- op6 ---


def naive_bundle(text, space):
    """The sum of the bound vectors of all letter trigrams, one after the other."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip():
        return np.zeros(space.dimensions)
    said = f" {' '.join(letters.split())} "
    out = np.zeros(space.dimensions)
    for a, b, c in zip(said, said[1:], said[2:], strict=False):
        out += np.roll(space.letter(ord(a)), 2).astype(float) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))
    return out


def unit(x):
    return x / (np.linalg.norm(x) or 1)


def naive_language(rows, learn):
    """(prediction, score) of each (text, lang) row, with the rows where ``learn`` is true as examples."""
    space = Space()
    bundles = [naive_bundle(t, space) for t, _ in rows]
    names = sorted({lang for (t, lang), u in zip(rows, learn, strict=True) if u and t is not None and lang is not None})
    sums = {n: sum(unit(b) for b, (t, lang), u in zip(bundles, rows, learn, strict=True) if u and lang == n) for n in names}
    names = [n for n in names if np.linalg.norm(sums[n])]
    out = []
    for b in bundles:
        if not b.any() or not names:
            out.append(("und", 0.0))
            continue
        cosines = [float(unit(b) @ unit(sums[n])) for n in names]
        best = int(np.argmax(cosines))
        out.append((names[best], min(1.0, max(0.0, cosines[best]))))
    return out


def learned_from(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 != 1 if doc_id is not None else True


def test_language_id_against_a_naive_version(spark):
    texts = ["The cat sat on the mat, and the dog did not.", "Der Hund lief über die Straße und bellte.", "Le chat dort sur la chaise près du feu.", "ÀÉÎ œuvre Straße", "123 ... !", "", None, "a", "日本語のテキスト", "x" * 4000 + " the the the"]
    rows = [(i, texts[i % len(texts)], ("en", "de", "fr", None)[i % 4], "s", 7) for i in range(40)] + [(None, texts[0], "en", "s", 1), (5, texts[5 % len(texts)], "de", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int").repartition(3)
    learn = [learned_from(r[0]) for r in rows]
    profiles = train(docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))))
    got = identify(docs, profiles).select("doc_id", "text", "lang_pred", "score").collect()
    want = naive_language([(r[1], r[2]) for r in rows], learn)
    by_row = {(r[0], r[1]): w for r, w in zip(rows, want, strict=True)}
    assert len(got) == len(rows)
    for r in got:
        name, score = by_row[r.doc_id, r.text]
        assert r.lang_pred == name and abs(r.score - score) < 1e-5
    assert identify(docs.where("false"), profiles).count() == 0


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([("same words here", "b"), ("same words here", "a")], "text string, lang string")
    assert {r.lang_pred for r in identify(docs, train(docs)).collect()} == {"a"}


# --- op7 ---


def enumerated(v, text):
    """All segmentations of a text (edge lengths by letter) with their probabilities."""
    said = (" " + text if v.prefix and text else text).replace(SPACE, "\ue000").replace(" ", SPACE)
    pieces = {v.processor.id_to_piece(i): i for i in range(v.size) if not (v.processor.is_byte(i) or v.processor.is_control(i) or v.processor.is_unknown(i) or v.processor.is_unused(i))}
    found = []

    def go(at, ids, log_w):
        if at == len(said):
            found.append((tuple(ids), log_w))
            return
        for end in range(at + 1, len(said) + 1):
            if said[at:end] in pieces:
                i = pieces[said[at:end]]
                go(end, [*ids, i], log_w + v.weight[i])
        if said[at] not in pieces:
            raw = said[at].replace("\ue000", SPACE).encode()
            go(at + 1, [*ids, *(int(v.byte_id[b]) for b in raw)], log_w + v.least)

    go(0, [], 0.0)
    z = math.log(sum(math.exp(w) for _, w in found))
    return {ids: math.exp(w - z) for ids, w in found}


@pytest.mark.parametrize("text", ["hello", "a b", "né 漢a", "to\nbe", f"x{SPACE}y", "", "  a"])
def test_probabilities_against_enumeration(text):
    v = Vocabulary.of(piece_model(), 1.0)
    want = enumerated(v, text)
    k = min(len(want) + 2, 40)
    keys = mix64(np.arange(40, dtype=np.uint64))
    got = {}
    for t, s, ids, log_p, log_q in segmentations(v, [text] * 40, keys, k):
        got.setdefault(t, []).append((tuple(ids.tolist()), log_p, log_q))
    for rows in got.values():
        assert len(rows) == min(k, len(want)) == len({r[0] for r in rows})
        assert all(abs(math.exp(log_p) - want[ids]) < 1e-9 for ids, log_p, _ in rows)
        if len(want) <= k:
            assert all(log_q == 0 for *_, log_q in rows)  # all of them are in every such sample


def test_ordered_samples_against_theory():
    """First samples come with their probability, ordered pairs as draws without replacement do."""
    v, n = Vocabulary.of(piece_model(), 1.0), 20_000
    want = enumerated(v, "hello")
    drawn = {}
    for t, s, ids, *_ in segmentations(v, ["hello"] * n, mix64(np.arange(n, dtype=np.uint64)), 3):
        drawn.setdefault(t, []).append(tuple(ids.tolist()))
    first, pairs, triples = (Counter(tuple(x[:k]) for x in drawn.values()) for k in (1, 2, 3))
    for ids, p in want.items():
        assert abs(first[(ids,)] / n - p) < 0.012
    likely = sorted(want, key=want.get)[-5:]
    for a, b in itertools.permutations(likely, 2):
        assert abs(pairs[a, b] / n - want[a] * want[b] / (1 - want[a])) < 0.012
    for a, b, c in itertools.permutations(likely[-3:], 3):
        assert abs(triples[a, b, c] / n - want[a] * want[b] / (1 - want[a]) * want[c] / (1 - want[a] - want[b])) < 0.012


def test_values_and_inclusion_scores():
    """Perturbed values fall, the best one left out is below them, and the scores estimate sums over all segmentations without bias."""
    v, n = Vocabulary.of(piece_model(), 1.0), 6000
    keys = mix64(np.arange(n, dtype=np.uint64))
    samples, rest = sample_top_k(lattice(v, ["hello"] * n), keys, 4)
    values = np.stack([s.value for s in samples] + [rest])
    assert (np.diff(values, axis=0) < 0).all()
    assert abs(values[0].mean() - 0.5772) < 0.06  # the largest of all is a standard Gumbel number
    want = enumerated(v, "hello")
    lengths = sum(p * len(ids) for ids, p in want.items())
    total, length = np.zeros(n), np.zeros(n)
    for t, _, ids, log_p, log_q in segmentations(v, ["hello"] * n, keys, 4):
        total[t] += math.exp(log_p - log_q)
        length[t] += len(ids) * math.exp(log_p - log_q)
    assert abs(total.mean() - 1) < 0.03 and abs(length.mean() - lengths) < 0.15


def test_samples_of_a_further_pass_differ(spark):
    docs = spark.createDataFrame([(1, "some words that have many segmentations", p) for p in (1, 2)], "doc_id long, text string, pass int")
    got = {(r["pass"], r.sample): tuple(r.ids) for r in sample_segmentations(docs, piece_model(), k=2, pass_col="pass").collect()}
    assert len(got) == 4 and {got[1, 1], got[1, 2]} != {got[2, 1], got[2, 2]}


# --- op2 ---


def naive_mix(rows, epochs_of, block_tokens, seed=17):
    """(doc_id, epoch, block, position) of (doc_id, source, tokens) rows by loops over sources and blocks."""
    import hashlib

    key = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    out = []
    for source in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == source]
        tokens = sum(r[2] for r in mine)
        n_blocks = max(1, math.ceil(tokens / block_tokens))
        epochs = round(epochs_of(tokens), 6) if tokens else 1.0
        for block in range(n_blocks):
            held = [r for r in mine if int(key(seed, r[0])[:12], 16) % n_blocks == block]
            whole = math.floor(epochs)
            size = sum(r[2] for r in held)
            for epoch in range(1, whole + 2):
                order = sorted(held, key=lambda r: key(seed, epoch, r[0]))
                if epoch == whole + 1:
                    if epochs == whole:
                        continue
                    run, head = 0, []
                    for r in order:
                        run += r[2]
                        if 2 * run - r[2] <= 2 * (epochs - whole) * size:
                            head.append(r)
                    order = head
                out += [(r[0], epoch, block, i + 1) for i, r in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("budget, entropy, repetitions", [(None, None, 3.0), (1.5, None, 3.0), (0.5, None, 2.0), (1.2, 1.0, None), (9.0, None, 2.0)])
def test_mixing_against_loops(spark, budget, entropy, repetitions):
    rows = [(i, ("a", "b", "c", None)[min(3, i % 17 // 5)], "w " * (i * 7 % 23)) for i in range(600)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), entropy=entropy, repetitions=repetitions, budget=budget, block_tokens=500).collect()
    counted = [(i, s, len(t.split())) for i, s, t in rows]
    tokens = Counter()
    for _, s, n in counted:
        tokens[s] += n
    most, total = max(tokens.values()), sum(tokens.values())

    def shares(a):
        w = {s: (t / most) ** a for s, t in tokens.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def budgeted(a):
        return budget * total if budget else most * sum((t / most) ** a for t in tokens.values())

    def good(a):
        if entropy is not None:
            return -sum(p * math.log(p) for p in shares(a).values()) >= entropy
        return max(p * budgeted(a) / tokens[s] for s, p in shares(a).items()) <= repetitions

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if entropy is not None:
            low, high = (mid, high) if good(mid) else (low, mid)
        else:
            low, high = (low, mid) if good(mid) else (mid, high)
    alpha = round(high, 6) if repetitions is None or not good(0.0) else 0.0
    by_tokens = {t: shares(alpha)[s] * budgeted(alpha) / t for s, t in tokens.items()}
    assert sorted((r.doc_id, r.mix_epoch, r.mix_block, r.mix_position) for r in got) == naive_mix(counted, by_tokens.get, 500)
    if budget and budget < 9:
        size = {i: n for i, _, n in counted}
        assert abs(sum(size[r.doc_id] for r in got) / (budget * total) - 1) < 0.02


def test_mixing_of_odd_rows(spark):
    rows = [(None, "s", f"w {i} " * 20, 1) for i in range(300)] + [(1, "s", "again", 2)] * 3 + [(2, None, None, 3), (3, "t", "x " * 50_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_epoch int")
    got = mix(docs, repetitions=2.0, block_tokens=1000).collect()
    assert got[0].asDict().keys() >= {"mix_epoch", "mix_position"} and len(got[0]) == 7
    assert len({r.mix_block for r in got if r.doc_id is None}) > 3  # rows without an id are spread
    assert sum(r.doc_id == 1 for r in got) in (3, 4, 5, 6) and sum(r.doc_id == 2 for r in got) == 1
    assert mix(docs.where("false"), repetitions=2.0, budget=1.5).count() == 0


# --- the pipeline ---


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(90)
    odd = spark.createDataFrame([(9001, "123 456", "en", "src0", 7), (9002, None, "en", "src0", 0), (9003, "漢字仮名交文字列漢字仮名", None, "src1", 3), (9004, "the and of the in that", None, "src1", 9)], TABLE)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd).repartition(4)
    rows = docs.collect()
    stage = dict(corpus_pipeline.STAGES)

    # language: predictions of the naive version; a document goes if its best cosine is within two deviations of chance
    found = naive_language([(r.text, r.lang) for r in rows], [learned_from(r.doc_id) for r in rows])
    want = {r.doc_id: (r.text, r.lang or p) for r, (p, s) in zip(rows, found, strict=True) if p != "und" and s >= 2 / DIMENSIONS**0.5}
    told = spark.createDataFrame(stage["language_id"](spark, docs, "").collect(), TABLE)
    assert {r.doc_id: (r.text, r.lang) for r in told.collect()} == want and told.columns == docs.columns
    assert not {9001, 9002, 9003} & set(want) and 9004 in want

    # exact: of equal texts the largest id
    last = {}
    for i, (t, _) in want.items():
        last[t] = max(i, last.get(t, i))
    exact = spark.createDataFrame(stage["exact_dedup"](spark, told, "").collect(), TABLE)
    assert {r.doc_id for r in exact.collect()} == set(last.values())

    # near copies: of each component the smallest id
    kept = sorted((i, t) for t, i in last.items())
    low = brute_components([t for _, t in kept])
    near = spark.createDataFrame(stage["ngram_join"](spark, exact, "").collect(), TABLE)
    left = [i for k, (i, _) in enumerate(kept) if low[k][1] == k]
    assert sorted(r.doc_id for r in near.collect()) == left

    # mixing: each document as often as the loops say
    source = {r.doc_id: r.source for r in near.collect()}
    import re

    counted = [(i, source[i], len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in kept if i in source]
    tokens = Counter()
    for _, s, n in counted:
        tokens[s] += n
    most, least = max(tokens.values()), min(tokens.values())
    alpha = 0.0 if most / least <= REPETITIONS else 1 - math.log(REPETITIONS) / math.log(most / least)
    alpha = round(alpha + 5e-13, 6) if (least / most) ** (round(alpha, 6) - 1) <= REPETITIONS * (1 + 1e-5) else alpha
    mixed = stage["mixing"](spark, near, "").collect()
    times = Counter(r.doc_id for r in mixed)
    plain = Counter(x[0] for x in naive_mix(counted, lambda t: (t / most) ** (alpha - 1), 1 << 18))
    assert times == plain and all(n >= 1 for n in times.values()) and set(times) == set(left)

    # sampling: as the sampler does for each text by itself, another sample for each pass
    mixed = spark.createDataFrame(mixed, TABLE)
    final = stage["sentencepiece"](spark, mixed, "").collect()
    v = Vocabulary.of(piece_model(), 1.0)
    text = dict(kept)
    assert Counter((r.doc_id, r["pass"]) for r in final) == {(i, p): len({r.sample for r in final if r.doc_id == i and r["pass"] == p}) for i, n in times.items() for p in range(1, n + 1)}
    assert all(v.decode(r.ids) == text[r.doc_id] and r.exact for r in final)
    again = {}
    for r in final:
        again.setdefault(r.doc_id, {}).setdefault(r["pass"], []).append(r.ids_crc32)
    assert all(a[1] != a[2] for i, a in again.items() if len(a) > 1 and len(text[i]) > 100)


# --- op1 ---


@pytest.mark.parametrize("largest", [True, False])
def test_tree_merge_against_a_dictionary(spark, monkeypatch, largest):
    from maskwright.llm import exact_dedup as op1

    monkeypatch.setattr(op1, "CHUNK_ROWS", 16)
    monkeypatch.setattr(op1, "RUN_ROWS", 100)
    rng = np.random.default_rng(2)
    low, high = -(2**63), 2**63 - 1
    rows = [(int(rng.integers(-50, 5000)), f"t{int(rng.zipf(1.3)) % 700}", 1) for _ in range(4000)] + [(None, "t1", 1), (None, "only without an id", 1), (None, None, 1), (high, "edge", 1), (low, "edge", 1), (low, "lone", 1), (high, "lone too", 1), (7, None, 1), (8, "", 1), (None, "lone", 1), (None, "lone too", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(19)
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(t or "", []).append(i)
    want = {t: ((max if largest else min)([i for i in x if i is not None], default=None), len(x)) for t, x in ids.items()}
    for fan_in in (2, 4):
        got = op1.exact_dedup(docs, largest=largest, fan_in=fan_in).collect()
        assert len(got) == len(rows)
        for r in got:
            stays, size = want[r.text or ""]
            assert (r.keep_id, r.group_size, r.kept) == (stays, size, r.doc_id is not None and r.doc_id == stays)
    report = op1.dedup_report(docs, largest=largest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in report) == Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got)


def test_texts_of_one_digest_are_compared():
    from maskwright.llm.exact_dedup import DigestError, Run, merged

    one = lambda length: Run(np.array([[1, 2, 3, 4, length, 9]], np.uint64), np.array([5]), np.array([[1, 1]]))
    assert merged([one(7), one(7)], False).counts.tolist() == [[2, 2]]
    with pytest.raises(DigestError):
        merged([one(7), one(8)], False)


# --- op9 ---


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_links_against_all_pairs(spark, monkeypatch, kind):
    from maskwright.llm import embedding_dedup as op9

    monkeypatch.setattr(op9, "BLOCK", 8)
    monkeypatch.setattr(op9, "LEAF", 4)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 400)] + rng.normal(scale=0.09, size=(400, 24))
    x = x.astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
    label = [("north", "south", None)[i % 7 % 3] for i in range(400)]
    rows = [(i, v.tolist(), label[i], "old", 0) for i, v in enumerate(x)]
    rows += [(i, x[i].tolist(), label[i], "old", 0) for i in (0, 1)] + [(1000, x[3].tolist(), label[3], "old", 0)]
    schema = f"vec_id long, embedding array<{kind}>, label string, kept string, _own int"
    frame = spark.createDataFrame(rows, schema).withColumnRenamed("_own", "n_links")
    got = op9.near_dedup(frame.repartition(5)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"vec_id", "embedding", "label", "n_links", "component_id", "kept"}
    every = np.concatenate([x, x[[0, 1, 3]]])
    names, owner = [*label, label[0], label[1], label[3]], [*range(400), 0, 1, 1000]
    unit_ = every / np.linalg.norm(every, axis=1, keepdims=True)
    linked = (unit_ @ unit_.T >= 0.98) & np.array([[a is not None and a == b for b in names] for a in names])
    low = np.array(owner)
    while True:
        new = np.array([low[r].min() if r.any() else low[i] for i, r in enumerate(linked)])
        if (new == low).all():
            break
        low = new
    found = {}
    for r in got:
        found.setdefault(r.vec_id, set()).add((r.component_id, r.kept))
    for i, o in enumerate(owner):
        assert found[o] == {(int(low[i]), int(low[i]) == o)}
    links = {r.vec_id: r.n_links for r in got}
    for i in range(4, 400):
        assert links[i] == int(linked[i].sum()) - int(linked[i, i])
    assert op9.near_dedup(frame.where("false")).count() == 0


# --- op3, op5 ---


def test_damaged_text_is_no_turn(spark):
    from maskwright.llm.chat_format import parse

    rows = spark.createDataFrame([("### user: a\n</turn>\nnot a turn\n</turn>\n### nobody\n</turn>\n### : \n</turn>\nrest",), ("",)], "t string")
    got = [r.p for r in rows.select(parse(F.col("t")).alias("p")).collect()]
    assert [None if t is None else (t.role, t.text) for t in got[0]] == [("user", "a"), None, None, ("", "")] and got[1] == []


def test_a_failed_task_leaves_no_file(tmp_path):
    from maskwright.llm.storage import new_file

    with pytest.raises(RuntimeError):
        with new_file(str(tmp_path), "x", ".bin") as (sink, _):
            sink.write(b"1")
            raise RuntimeError
    assert list(tmp_path.iterdir()) == []
    with new_file(str(tmp_path), "x", ".bin") as (sink, uri):
        sink.write(b"2")
    assert [p.read_bytes() for p in tmp_path.iterdir()] == [b"2"] and uri.endswith(next(tmp_path.iterdir()).name)


def test_token_files_of_odd_ids(spark):
    from tokenizers import Tokenizer

    from maskwright.llm.queries import byte_bpe
    from maskwright.llm.token_binary import read_documents, write_tokens

    rows = [(5, "five"), (None, "none"), (2, "two two"), (5, "five again"), (2, "two two"), (-1, None), (7, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    plain = Tokenizer.from_file(byte_bpe())
    got = sorted(read_documents(write_tokens(docs, byte_bpe(), sequence=64)).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    sums = Counter((i, zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == sums


def test_ngram_join_of_odd_rows(spark):
    from maskwright.llm.ngram_join import jaccard_join

    rng = np.random.default_rng(11)
    long = " ".join(f"w{i}" for i in rng.integers(0, 9000, 40_000))
    rows = [(4, long, "a"), (9, long + " end", "b"), (9, long + " end", "b"), (None, long, "c"), (None, None, "d"), (3, "few words", "e"), (8, "Few WORDS", "f"), (6, "", "g"), (9, "another text of nine", "h")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, tag string, component_id int, code int").repartition(4)
    got = {r.tag: (r.component_id, r.code) for r in jaccard_join(docs).collect()}
    assert len(got) == len({r[2] for r in rows}) and got["a"] == (4, 2) and got["b"][0] == 4 and got["c"][0] is None and got["d"][0] is None
    assert got["e"][0] == got["f"][0] == 3 and got["g"][0] == 6
    assert jaccard_join(docs).count() == len(rows)
