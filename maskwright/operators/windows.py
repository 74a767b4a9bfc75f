"""Text windows for bounded models: byte windows, checks of a window plan, offsets back in the text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def byte_windows(raw: bytes, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of at most ``size`` bytes that share ``overlap`` bytes; both ends lie between characters and every window is further on."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    start = 0
    while start < len(raw):
        end = min(start + size, len(raw))
        while end > start and inside(end):
            end -= 1
        if end == start:  # one character is longer than the window
            end += 1
            while inside(end):
                end += 1
        yield start, end
        if end == len(raw):
            return
        start = end - overlap if end - overlap > start else end
        while inside(start):
            start += 1


def split_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, window, start_byte, end_byte); an empty or null text has none."""
    if size <= 0 or overlap < 0:
        raise ValueError("a window has a positive size and no negative overlap")

    def run(batches):
        for batch in batches:
            ids, numbers, starts, ends = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, (a, b) in enumerate(byte_windows((text.as_py() or "").encode(), size, overlap)):
                    ids.append(doc_id)
                    numbers.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "window", "start_byte", "end_byte"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, window int, start_byte long, end_byte long")


def plan_is_valid(plans: DataFrame, windows: DataFrame, overlap: int) -> DataFrame:
    """(doc_id, valid) of plans (doc_id, n_chars, total, capacity) with windows (doc_id, i, start, end, tokens) in code points.

    The capacity exceeds the overlap; windows start at 0, go on strictly at
    both ends, overlap their neighbour (or leave no gap where the overlap is
    0), hold 1 to capacity tokens and reach the text's end. An empty text has
    an empty plan; a total of 0 goes with no windows and only with that.
    """
    order = Window.partitionBy("doc_id").orderBy("i")
    last_start, last_end = F.lag("start").over(order), F.lag("end").over(order)
    joined = F.col("start") < last_end if overlap > 0 else F.col("start") <= last_end
    ok = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("tokens") > 0) & F.when(last_end.isNull(), F.col("start") == 0).otherwise((F.col("start") > last_start) & (F.col("end") > last_end) & joined)
    per_doc = windows.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("doc_id").agg(F.min("ok").alias("ok"), F.max("tokens").alias("most"), F.max("end").alias("reach"), F.count("*").alias("k"))
    rows = plans.join(per_doc, "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    head = (F.col("total") >= 0) & (F.col("capacity") > 0) & (F.col("capacity") > overlap)
    body = F.when(F.col("k") == 0, F.col("total") == 0).otherwise((F.col("n_chars") > 0) & (F.col("total") > 0) & F.col("ok") & (F.col("most") <= F.col("capacity")) & (F.col("reach") == F.col("n_chars")))
    return rows.select("doc_id", F.coalesce(head & body, F.lit(False)).alias("valid"))


def global_offsets(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Entities of windows (doc_id, window, label, start, end, confidence, model; bytes) at their place in the text; those out of their window go, repeats from overlaps stay."""
    rows = found.join(windows, ["doc_id", "window"]).where("start >= 0 AND end > start AND end <= end_byte - start_byte")
    return rows.select("doc_id", "label", (F.col("start") + F.col("start_byte")).alias("start_byte"), (F.col("end") + F.col("start_byte")).alias("end_byte"), "confidence", "model")
