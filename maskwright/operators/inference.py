"""Models behind a hook: token counts, window plans, inference by windows, offsets back in the text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.windows import plan_is_valid
from maskwright.sources.shared import kept
from maskwright.sources.tables import spread

TOKEN_LIMIT = 100_000
_WINDOWS = "doc_id long, i int, start int, end int, tokens int"
_ENTITIES = "label string, start_cp int, end_cp int, confidence double, model string"


class Predictor(Protocol):
    """What a model brings; an instance is pickled to the workers, where it may load its weights at first use."""

    model: str
    capacity: int

    def tokens(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each token in code points."""

    def infer(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Per text (label, start, end, confidence) in code points. After an exception the texts are asked for one by one; one that still raises fails its document."""


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """The texts of a batch one after the other; null counts as empty."""
    return (t.as_py() or "" for t in batch.column(1))


def token_windows(text: str, tokens: Callable[[str], list[tuple[int, int]]], capacity: int, overlap: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(tokens of the text, windows (start, end, tokens)).

    Windows end where a token ends, the last one with the text, and begin
    ``overlap`` tokens before the end of the one before. A window's own text
    may have more tokens than the same stretch of the whole; it then ends at
    the last token for which it fits.
    """
    if not 0 <= overlap < capacity:
        raise ValueError("the overlap is below the capacity and not negative")
    ends = [e for _, e in tokens(text)]
    if not ends:
        return 0, []
    size = lambda a, b: len(tokens(text[a:b]))
    out: list[tuple[int, int, int]] = []
    start = first = 0
    while start < len(text):
        first = bisect_right(ends, start, first)
        if first == len(ends):  # what is left has no token of the text: it goes with the last window
            a, _, _ = out.pop()
            out.append((a, len(text), size(a, len(text))))
            break
        last = min(first + capacity, len(ends)) - 1
        end = len(text) if last == len(ends) - 1 else ends[last]
        if size(start, end) > capacity:
            last = first + bisect_right(range(first, last + 1), capacity, key=lambda k: size(start, ends[k])) - 1
            if last < first:
                raise ValueError("one token is beyond the capacity")
            end = ends[last]
        inner = tokens(text[start:end])
        out.append((start, end, len(inner)))
        if end == len(text):
            break
        back = start + inner[max(0, len(inner) - overlap)][0] if overlap and inner else end
        start = max(back, start + 1)
    if any(not 1 <= n <= capacity for *_, n in out):
        raise ValueError("a window is beyond the capacity")
    return len(ends), out


def token_counts(docs: DataFrame, predictor: Predictor) -> DataFrame:
    """(doc_id, n_tokens); a null text has none."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(predictor.tokens(t)) for t in _texts(batch)], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def limit_error(n_tokens: Column, limit: int = TOKEN_LIMIT) -> Column:
    """``invalid`` for a negative or unknown number of tokens, ``token_limit`` beyond the limit, else null."""
    return F.when(n_tokens.isNull() | (n_tokens < 0), "invalid").when(n_tokens > limit, "token_limit")


def plan_windows(docs: DataFrame, predictor: Predictor, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(plans (doc_id, n_chars, total, capacity), windows (doc_id, i, start, end, tokens)) in code points; a text that cannot be planned has a total of -1 and no windows."""

    def planned(text: str) -> tuple[int, int, list[dict]]:
        try:
            total, found = token_windows(text, predictor.tokens, predictor.capacity, overlap)
        except ValueError:
            total, found = -1, []
        return len(text), total, [{"i": i, "start": a, "end": b, "tokens": n} for i, (a, b, n) in enumerate(found)]

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([(n, pa.int32()) for n in ("i", "start", "end", "tokens")])))
        for batch in batches:
            rows = [planned(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_chars", "total", "windows"])

    made = spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, n_chars long, total long, windows array<struct<i:int,start:int,end:int,tokens:int>>")
    made = kept(made, "plans")  # of no text, and read more than once
    return made.select("doc_id", "n_chars", "total", F.lit(predictor.capacity).alias("capacity")), made.select("doc_id", F.inline("windows"))


def infer_windows(windows: DataFrame, predictor: Predictor, parallel: int | None = None, batch: int = 32) -> DataFrame:
    """Windows (doc_id, i, text) with ``found``: array of (label, start_cp, end_cp, confidence, model), null where the model failed; at most ``parallel`` tasks ask it at once."""

    def asked(texts: list[str]) -> list[list[dict] | None]:
        try:
            return [[{"label": x, "start_cp": s, "end_cp": e, "confidence": c, "model": predictor.model} for x, s, e, c in a] for a in predictor.infer(texts)]
        except Exception:  # noqa: BLE001  what a model raises is its own; its documents fail, not the job
            return [None] if len(texts) == 1 else [asked([t])[0] for t in texts]

    def run(batches):
        kind = pa.list_(pa.struct([("label", pa.string()), ("start_cp", pa.int32()), ("end_cp", pa.int32()), ("confidence", pa.float64()), ("model", pa.string())]))
        for b in batches:
            for k in range(0, b.num_rows, batch):
                some = b.slice(k, batch)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("i"), pa.array(asked(some.column("text").to_pylist()), kind)], names=["doc_id", "i", "found"])

    rows = windows.select("doc_id", "i", "text")
    rows = rows.repartition(parallel) if parallel else rows
    return rows.mapInArrow(run, f"doc_id long, i int, found array<struct<{_ENTITIES.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double')}>>")


def infer_bounded(docs: DataFrame, predictor: Predictor, overlap: int = 64, parallel: int | None = None, limit: int = TOKEN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(entities, errors) of documents with distinct ids.

    Each text is planned, checked against the token limit, asked for window by
    window, and its entities are put back at their place: (doc_id, label,
    start_cp, end_cp, confidence, model), those from overlaps as often as they
    come. Rows out of their window are left out. A document with an error
    (invalid_text, invalid, token_limit, invalid_plan, model) has no entities.
    """
    plans, windows = plan_windows(docs.where(F.is_valid_utf8("text")), predictor, overlap)
    errors = docs.where(~F.coalesce(F.is_valid_utf8("text"), F.lit(True))).select("doc_id", F.lit("invalid_text").alias("error"))
    valid = plan_is_valid(plans.where(limit_error(F.col("total"), limit).isNull()), windows, overlap)
    errors = errors.unionByName(plans.select("doc_id", limit_error(F.col("total"), limit).alias("error")).where("error is not null")).unionByName(valid.where("not valid").select("doc_id", F.lit("invalid_plan").alias("error")))
    good = windows.join(valid.where("valid").select("doc_id"), "doc_id", "left_semi")
    # a text meets the list of its windows once and is cut inside its row, so that no window carries a whole text
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text"))
    listed = good.groupBy("doc_id").agg(F.collect_list(F.struct("i", "start", "end")).alias("_windows")).join(texts, "doc_id")
    piece = lambda w: F.struct(w["i"].alias("i"), F.substring("_text", w["start"] + 1, w["end"] - w["start"]).alias("text"))
    cut = listed.select("doc_id", F.inline(F.transform("_windows", piece)))
    asked = kept(infer_windows(cut, predictor, parallel), "asked")  # the model is asked once for each window
    failed = asked.groupBy("doc_id").agg(F.max(F.col("found").isNull()).alias("failed")).where("failed").select("doc_id", F.lit("model").alias("error"))
    rows = asked.select("doc_id", "i", F.inline("found")).join(good, ["doc_id", "i"]).where("start_cp >= 0 AND end_cp > start_cp AND end_cp <= end - start AND confidence BETWEEN 0 AND 1")
    rows = rows.join(failed, "doc_id", "left_anti")
    return rows.select("doc_id", "label", (F.col("start_cp") + F.col("start")).alias("start_cp"), (F.col("end_cp") + F.col("start")).alias("end_cp"), "confidence", "model"), errors.unionByName(failed)


def in_model_order(entities: DataFrame) -> DataFrame:
    """Entities by document, start, end, label, model and confidence."""
    return entities.orderBy("doc_id", "start_cp", "end_cp", "label", "model", "confidence")


def once_per_text(docs: DataFrame, infer: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """``infer`` over each distinct text once; its entities and errors come back for every document that has the text."""
    rows = docs.select(F.col("doc_id").alias("_doc"), F.sha2("text", 256).alias("_text"), "text")
    firsts = rows.where("_text is not null").groupBy("_text").agg(F.min("_doc").alias("doc_id"), F.first("text").alias("text"))
    entities, errors = infer(firsts.select("doc_id", "text"))
    of = rows.select("_doc", "_text").join(firsts.select("_text", "doc_id"), "_text").select("_doc", "doc_id")
    back = lambda found: of.join(found, "doc_id").drop("doc_id").withColumnRenamed("_doc", "doc_id").select(found.columns)
    return back(entities), back(errors)


def concat(*found: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The entities of several predictors together, without those of documents that any of them failed on."""
    errors = found[0][1]
    for _, e in found[1:]:
        errors = errors.unionByName(e)
    entities = found[0][0]
    for x, _ in found[1:]:
        entities = entities.unionByName(x)
    return entities.join(errors.select("doc_id").distinct(), "doc_id", "left_anti"), errors
