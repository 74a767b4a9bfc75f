import json

import pytest

from maskwright.operators.windows import byte_windows, global_offsets, split_windows
from maskwright.sources.corpus import load, problems


@pytest.mark.parametrize("text", ["", "abc", "яблоко и груша 🙂🙂 конец", "🙂", "a" * 50])
@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (5, 2), (8, 20), (64, 8)])
def test_windows_cover_whole_characters(text, size, overlap):
    raw, end, last = text.encode(), 0, -1
    for a, b in byte_windows(raw, size, overlap):
        assert last < a <= end and b > a
        raw[a:b].decode()
        end, last = b, a
    assert end == len(raw)


def test_offsets_come_back(spark):
    docs = spark.createDataFrame([(1, "ж" * 20), (2, None)], "doc_id long, text string")
    windows = split_windows(docs, 16, 4)
    assert [(r.start_byte, r.end_byte) for r in windows.orderBy("window").collect()] == [(0, 16), (12, 28), (24, 40)]
    found = spark.createDataFrame([(1, 1, "X", 2, 6, 0.5, "m"), (1, 2, "X", 0, 99, 0.5, "m")], "doc_id long, window int, label string, start long, end long, confidence double, model string")
    assert [(r.start_byte, r.end_byte) for r in global_offsets(found, windows).collect()] == [(14, 18)]


def test_corpus_checks(spark, tmp_path):
    span = {"type": "PHONE", "start": 4, "end": 6, "value": "я", "personal": True, "mask_token": "<PHONE>"}
    case = {"id": "a", "input": "тя я", "expected_mask": "тя<PHONE>", "spans": [span | {"start": 5, "end": 7}]}
    bad = [
        {"id": "b", "input": "я", "expected_mask": "", "spans": [span]}, {"id": "c", "input": "яя", "expected_mask": "<PHONE>", "spans": [span | {"start": 0, "end": 2}, span | {"start": 0, "end": 2}]},
        {"id": "d", "input": "x", "expected_mask": "x", "spans": []}, {"id": "d", "input": "x", "expected_mask": "x", "spans": []},
    ]
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"version": "1", "offset_unit": "utf8_byte", "cases": [case, *bad]}, ensure_ascii=False))
    found = {(r.id, r.problem) for r in problems(load(spark, str(path))).collect()}
    assert found == {("b", "bounds"), ("b", "mask_token"), ("c", "overlap"), ("d", "id")}


def test_expired_mappings_start_anew(spark):
    from datetime import datetime, timedelta

    from maskwright.operators import vault

    start, ttl = datetime(2024, 1, 1), 10
    rows = [(i, f"s{i % 2}", f"t{i % 3}", "abc"[i * i % 7 % 3], start + timedelta(seconds=(i * 37 % 101) + i / 1000)) for i in range(200)]
    rows += [(1000 + i, "s", "hand", v, start + timedelta(seconds=t)) for i, (t, v) in enumerate([(0, "a"), (9, "b"), (10, "b"), (11, "b"), (12, "a"), (19, "b"), (20, "a"), (21, "a"), (22, "b")])]
    live, want = {}, {}
    for i, scope, token, original, at in sorted(rows, key=lambda r: (r[4], r[3])):
        first, stored = live.get((scope, token), (None, None))
        if first is None or at >= first + timedelta(seconds=ttl):
            want[i], live[scope, token] = "stored" if first is None else "replaced", (at, original)
        else:
            want[i] = "same" if stored == original else "conflict"
    got = vault.save(spark.createDataFrame(rows, "id long, scope string, token string, original string, at timestamp").repartition(5), ttl).collect()
    assert {r.id: r.outcome for r in got} == want and len(got) == len(rows)
    hand = [r for r in sorted(got, key=lambda r: r.at) if r.token == "hand"]
    assert [r.outcome for r in hand] == ["stored", "conflict", "replaced", "same", "conflict", "same", "replaced", "same", "conflict"]
    assert hand[4].stored == "b" and hand[4].first_at == start + timedelta(seconds=10)


class Noted:
    """Notes in a file each text that it counts or is asked about."""

    model, capacity = "noted", 4

    def __init__(self, path):
        self.path = path

    def note(self, what):
        with open(self.path, "a") as f:
            f.write(what + "\n")

    def tokens(self, text):
        if len(text) == 7:
            self.note("counted")
        return [(i, i + 1) for i in range(len(text))]

    def infer(self, texts):
        for _ in texts:
            self.note("asked")
        return [[("X", 0, 1, 0.5)] for _ in texts]


def test_each_window_is_asked_about_once(spark, tmp_path):
    from maskwright.operators import inference

    path = tmp_path / "noted"
    docs = spark.createDataFrame([(i, "abcdefg") for i in range(3)], "doc_id long, text string")
    found, errors = inference.infer_bounded(docs, Noted(str(path)), 1)
    assert found.count() == 6 and errors.count() == 0  # two windows a text
    said = path.read_text().split()
    assert said.count("asked") == 6 and said.count("counted") == 3
