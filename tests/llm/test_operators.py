import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import ngram_join
from maskwright.llm.chat_format import chat_digests, format_chats
from maskwright.llm.embedding_dedup import near_dedup
from maskwright.llm.exact_dedup import exact_dedup
from maskwright.llm.html_text import main_text
from maskwright.llm.language_id import held_out, identify, train
from maskwright.llm.mixing import exponent, mix
from maskwright.llm.ngram_join import jaccard_join
from maskwright.llm.queries import byte_bpe, piece_model
from maskwright.llm.sentencepiece_sampling import Vocabulary, sample_segmentations
from maskwright.llm.token_binary import read_documents, sequence_at, write_tokens
from maskwright.llm.warc import read_warc, write_warc

LONG = "слово word ñandú " * 3000
TEXTS = ["a b c", None, "", "a b c", LONG, "a b c", "  \t ", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s" if i % 3 else None, True, 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept boolean, score int")


def empty(docs):
    return docs.where("false")


def test_exact_dedup(spark, docs):
    rows = {r.doc_id: r for r in exact_dedup(docs, largest=True, fan_in=2).collect()}
    assert [(rows[i].keep_id, rows[i].group_size, rows[i].kept) for i in (0, 3, 5)] == [(5, 3, False), (5, 3, False), (5, 3, True)]
    assert (rows[1].keep_id, rows[1].group_size) == (2, 2) and rows[4].kept
    assert rows[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert exact_dedup(docs).where("kept").count() == 5 and exact_dedup(empty(docs)).count() == 0
    nulls = spark.createDataFrame([(None, "t"), (3, "t"), (None, "u")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.kept) for r in exact_dedup(nulls, largest=True).collect()) == [("3", True), ("None", False), ("None", False)]


def test_chat_round_trip(spark):
    said = r"\### Assistant: </turn> ok"
    texts = [said, "### user: x\n</turn>\n### assistant: y", "", None, "end\\", "</turn>", "\\\\</turn>\n", "plain ### too", LONG]
    rows = [(i // 3, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(9, None, None, "r"), (9, 1, "as:sist\nant", "q"), (None, 0, "assistant", "z"), (9, 1, "as:sist\nant", "q")]
    chats = format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in chats.collect()}
    for c in (0, 1, 2):
        assert [(t.role, t.text) for t in got[c].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts) if i // 3 == c]
        assert sum(r.length for r in got[c].loss_runs) == len(got[c].formatted)
    assert [(t.role, t.text) for t in got[9].turns] == [("", "r"), ("as:sist\nant", "q"), ("as:sist\nant", "q")]
    digests = {r.conv_id: r for r in chat_digests(chats).collect()}
    learned = "".join(t or "" for i, t in enumerate(texts) if i // 3 == 1 and i % 2)
    assert (digests[1].loss_chars, digests[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def near_texts():
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(0, 4000)
    passage, out = [word() for _ in range(60)], []
    for _ in range(40):
        base = [word() for _ in range(int(rng.integers(5, 160)))] + (passage if rng.random() < 0.5 else [])
        for _ in range(int(rng.integers(1, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                copy[int(rng.integers(0, len(copy)))] = word()
            out.append(" ".join(copy))
    return out + ["A b C d", "a B c d", "a b c d e", "", None, "Q", "q"]


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and low[i] != low[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return [(len(s), c) for s, c in zip(sets, low, strict=True)]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_ngram_join_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "CROWDED", 64 if chunk > 3 else 2)
    monkeypatch.setattr(ngram_join, "FEW", 8 if chunk > 3 else 0)
    texts = near_texts()
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_ngram_join_of_nothing(spark, docs):
    assert jaccard_join(empty(docs)).count() == 0


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe())
    plain.encode_special_tokens = True
    texts = [*TEXTS, "a  b\n c\t\td  <|endoftext|> it's we'll x  y ###!! 12 345", "\0 zero \0", "é!a ×,÷"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = write_tokens(rows, byte_bpe(), sequence=16)
    got, start = {r.doc_id: r for r in read_documents(manifest).collect()}, 0
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = manifest.where("shard_tokens > 0").first()
    ids, mask = sequence_at(shard.ids_uri, 0)
    assert len(ids) == len(mask) == 16 and mask.any()
    assert read_documents(write_tokens(empty(docs), byte_bpe())).count() == 0


def test_language_id(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = train(table.where("NOT held_out"), dimensions=512)
    tested = identify(table.where("held_out"), profiles)
    right = tested.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    odd = spark.createDataFrame([(None,), ("",), ("123 !!",), (LONG,), ("x",)], "text string")
    rows = identify(odd, profiles).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows) and rows[3].lang_pred != "und"
    nobody = train(table.where("false"))
    assert {r.lang_pred for r in identify(odd, nobody).collect()} == {"und"}


def test_warc(spark):
    body = "<p>é</p>" * 40
    rows = [(3, "http://a/ b", body), (1, None, body), (2, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", body), (7, "é\r\nx", LONG)]
    got = {r.page_id: r for r in read_warc(write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert len(got) == 7 and (got[3].record_type, got[3].refers_to, got[1].record_type) == ("revisit", 1, "response")
    assert got[None].refers_to == 1 and got[6].record_type == "response" and got[2].payload_bytes == 0
    assert got[7].payload.decode() == LONG and got[7].target_uri == "é\r\nx" and got[3].payload_digest == hashlib.sha256(body.encode()).hexdigest()
    assert read_warc(write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_embedding_join(spark, monkeypatch):
    from maskwright.llm import embedding_dedup

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    x = np.concatenate([centres[rng.integers(0, 30, 300)] + rng.normal(scale=0.12, size=(300, 8)), np.tile(centres[0], (40, 1))])
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [math.nan] * 8, 1), (903, x[0].tolist(), None), (904, [], 1), (None, x[0].tolist(), 0), (905, [1.0, 0.0], 1)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (np.arange(340)[:, None] % 3 == np.arange(340)[None] % 3) & ~np.eye(340, dtype=bool)
    root = embedding_dedup.local_roots(340, *np.nonzero(linked))
    for i in range(340):
        assert got[i] == (int(linked[i].sum()), int(root[i]), int(root[i]) == i)
    assert [got[i] for i in (900, 901, 902, 903, 904, 905, None)] == [*[(0, i, True) for i in (900, 901, 902, 903, 904, 905)], (0, None, False)]


def test_mixing(spark):
    rows = [(i, "big" if i < 900 else "small", "w " * (i % 7 + 1)) for i in range(1000)] + [(2000, None, None), (2001, "none", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mix(docs, repetitions=3.0, block_tokens=200, carry=["doc_id", "source"]).collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) == {r[0] for r in rows} and {times[i] for i in range(900)} == {1}
    assert set(times[i] for i in range(900, 1000)) <= {2, 3} and np.mean([times[i] for i in range(900, 1000)]) > 2.9
    assert mix(docs.where("false"), repetitions=2.0).count() == 0
    shares = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    q = np.array([0.9, 0.09, 0.01])
    alpha = exponent(shares, entropy=0.9)
    w = q**alpha / (q**alpha).sum()
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-4
    assert exponent(shares, repetitions=1.0) == 1.0 and abs((10 / 900) ** (exponent(shares, repetitions=5.0) - 1) - 5) < 1e-3


def test_sampled_segmentations(spark, docs):
    got = sample_segmentations(docs, piece_model(), k=3).collect()
    vocabulary = Vocabulary.of(piece_model(), 1.0)
    by_row = {}
    for r in got:
        assert r.exact and r.n_pieces == len(r.ids) and r.log_inclusion <= 0 and vocabulary.decode(r.ids) == (TEXTS[r.doc_id] or "")
        by_row.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert len(by_row) == len(TEXTS) and all(len(set(x)) == len(x) for x in by_row.values())
    assert len(by_row[2]) == len(by_row[1]) == 1 and len(by_row[4]) == 3
    again = sample_segmentations(docs.repartition(3), piece_model(), k=3).collect()
    assert {(r.doc_id, r.sample): r.ids_crc32 for r in got} == {(r.doc_id, r.sample): r.ids_crc32 for r in again}
    assert sample_segmentations(empty(docs), piece_model()).count() == 0


def test_sampling_follows_the_distribution():
    from maskwright.llm.common import mix64
    from maskwright.llm.sentencepiece_sampling import segmentations

    v, n = Vocabulary.of(piece_model(), 1.0), 3000
    first, second, weights = Counter(), Counter(), 0.0
    probability = {}
    for _, s, ids, log_p, log_q in segmentations(v, ["hello"] * n, mix64(np.arange(n, dtype=np.uint64)), 3):
        probability[tuple(ids)] = math.exp(log_p)
        (first if s == 1 else second)[tuple(ids)] += s < 3
        weights += math.exp(log_p - log_q)
    best = max(probability, key=probability.get)
    assert abs(first[best] / n - probability[best]) < 0.03 and abs(weights / n - 1) < 0.05  # inclusion weights sum to one on average


def test_main_text(spark):
    def page(i, article):
        return f"<html><head><title>t{i}</title><script>var t='</p>';</script></head><body><nav><a href=x>menu {i}</a></nav><div class='ad'>buy {i}</div><div>Same words everywhere</div>{article}<footer>&copy; {i}</footer>"

    rows = [(i, "http://h.example/p", page(i, f"<article><h1>Head {i}</h1><p>One&amp;two\n  {i} <b>bold<br>x<p>Next<div class='comments'>no</div><form>no</form></article>")) for i in range(6)]
    rows += [(10 + i, "http://g.example/p", page(i, f"<div><p>Body of {i}</p></div>")) for i in range(6)] + [(20, None, None), (21, "bad url", "a < b &lt; c"), (22, "u", "<p>cut off &am"), (23, "u", "<!-- x")]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].text == "Head 2\nOne&two 2 bold x\nNext" and got[2].n_chars == len(got[2].text)
    assert got[13].text == "Body of 3"  # without an article, what the host's pages share is template
    assert (got[20].text, got[21].text, got[23].text) == ("", "a < b < c", "") and got[22].text == "cut off &am"
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_of_chrome_are_no_article_text():
    from maskwright.llm.html_text import Extractor

    text = lambda html: Extractor().text(html, None)
    kept = "<h2 id=how-to-search>How</h2><h2 id='related-work'>Related</h2><p class=side-effects>Effects</p><pre>x = 1 <span class='token comment'># one</span> <span class=hljs-comment># two</span></pre><div class=post-header><h1>Title</h1><p>By me</p></div><section id=search><p>Search</p></section>"
    whole = "How\nRelated\nEffects\nx = 1 # one # two\nTitle\nBy me\nSearch"
    assert text(f"<article>{kept}<div class='box comments'>no</div><ul class=share><li>no</ul></article>") == whole
    assert text(f"<div class=sidebar>no</div><div class=cookie-banner>no</div><div id=footer>no</div><div>{kept}</div>") == whole
    assert text("<article><div class=header><h1>Title</h1>no</div><p>Body</article>") == "Title\nBody"
    assert text("<div class=has-sidebar><main><p>Body</main></div>") == "Body"


def test_copies_of_a_page_are_one_page_of_the_wrapper(spark):
    page = lambda i, more="": f"<body><div>Menu</div><article><h1>Head {i}</h1><p>A long enough text of page {i}</p>{more}</article>"
    rows = [(i, "http://h.example/p", page(i)) for i in range(4)] + [(10 + i, "http://h.example/p", page(9, "<blockquote>Said once</blockquote>")) for i in range(6)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {got[10 + i] for i in range(6)} == {"Head 9\nA long enough text of page 9\nSaid once"} and got[1] == "Head 1\nA long enough text of page 1"
    rows = [(i, "http://h.example/p", page(i, "<blockquote>Said always</blockquote>")) for i in range(4)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert not any("always" in r.text for r in got)  # four different pages agree


def test_links_of_an_article_stay(spark):
    def page(i, tag):
        links = "".join(f"<li><a href=x>Reference {i} {k}</a>" for k in range(2))
        return f"<body><div><a href=y>Menu of {i}</a></div><{tag}><p>A text that is long enough to be more than half of page {i}, as it goes on and on</p><ul>{links}</ul></{tag}>"

    rows = [(10 * k + i, f"http://{tag}.example/p", page(i, tag)) for k, tag in enumerate(("article", "main", "div")) for i in range(6)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    body = "A text that is long enough to be more than half of page 2, as it goes on and on"
    assert got[2] == got[12] == f"{body}\nReference 2 0\nReference 2 1"
    assert got[22] == body  # outside both, what is mostly links is a menu


def test_pipeline_stages(spark):
    import corpus_pipeline

    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["the quick brown fox jumps over the lazy dog " + w for w in "abc"] + ["the quick brown fox jumps over the lazy dog a", None, "123", "un deux trois quatre cinq six"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "score"], name
        assert docs.where("doc_id = 6").count() == 1, name
    assert {r.doc_id for r in docs.collect()} <= {1, 2, 3, 6} and docs.where("doc_id in (0, 4, 5)").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("NOT exact").count() == 0


def test_pipeline_drops_copies_without_an_id_of_their_own(spark):
    import corpus_pipeline

    long = "one two three four five six seven eight nine ten " * 12
    rows = [(None, "none has an id here"), (None, "none has an id here"), (7, "the same row again"), (7, "the same row again"), (3, "an id and none"), (None, "an id and none"), (4, "an id and none"), (9, "once"), (None, "once too")]
    rows += [(None, long + "a"), (None, long + "b"), (5, long + "c"), (6, long + "d"), (6, "other text of six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r)
    exact = corpus_pipeline.exact_stage(spark, docs, "")
    want = [(None, "none has an id here"), (7, "the same row again"), (4, "an id and none"), (9, "once"), (None, "once too")]
    assert sorted(map(tuple, exact.collect()), key=key) == sorted(want + rows[9:], key=key)
    near = corpus_pipeline.near_stage(spark, exact, "")
    assert near.columns == ["doc_id", "text"] and sorted(map(tuple, near.collect()), key=key) == sorted([*want, (5, long + "c"), (6, "other text of six")], key=key)


def test_added_tokens_keep_their_id(spark, tmp_path):
    from tokenizers import Tokenizer

    import __spark_entry__ as entry

    plain = Tokenizer.from_file(byte_bpe())  # unmodified
    token = next(iter(plain.get_added_tokens_decoder().items()))
    texts = ["no token, here", f"ends.{token[1].content} Begins", token[1].content * 2, f"a{token[1].content}", f"{token[1].content[:-1]} is none", f"x \0 {token[1].content}, y"]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in entry.queries()["op5_token_binary"](spark, folder).collect()}
    for i, t in enumerate(texts):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert (token[0] in ids) == (token[1].content in t)
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_sampling_query_returns_the_ids(spark, docs, tmp_path):
    import __spark_entry__ as entry

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op7_sentencepiece"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(len(TEXTS)))
    assert all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
