"""Ratios over sliding windows of a stream, with state that is dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.alerts import WINDOWS

STEP = 300  # seconds of the tumbling windows that events are counted in first
SLIDES = {n: max(STEP, s // 24 // STEP * STEP) for n, s in WINDOWS.items()}


def counted(events: DataFrame, counts: dict[str, Column], late: str, id_col: str = "event_id", step: int = STEP) -> DataFrame:
    """Events of a stream as counts per step (start, counts): each event once within the watermark, steps given out when it has passed them, later rows (behind the watermark that the batch before began with) dropped and counted by Spark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([id_col])
    sums = [F.sum(c.cast("bigint")).alias(n) for n, c in counts.items()]
    return rows.groupBy(F.window("ts", f"{step} seconds").alias("w")).agg(*sums).select(F.col("w.start").alias("start"), *counts)


def sliding_ratios(steps: DataFrame, part: str = "errors", whole: str = "requests") -> DataFrame:
    """A stream of ``counted`` steps as (range, t, part, whole, ratio) over all of the alerts' windows; ``t`` is the window's end.

    Windows sum steps, not events, so an event is dealt to no more than one
    row however many windows cover it. State holds the windows that the
    watermark has not passed.
    """
    rows = steps.withWatermark("start", "0 seconds")

    def over(name: str, seconds: int) -> DataFrame:
        found = rows.groupBy(F.window("start", f"{seconds} seconds", f"{SLIDES[name]} seconds").alias("w")).agg(F.sum(part).alias(part), F.sum(whole).alias(whole))
        return found.select(F.lit(name).alias("range"), F.col("w.end").alias("t"), part, whole, F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).alias("ratio"))

    return reduce(lambda a, b: a.unionByName(b), [over(n, s) for n, s in WINDOWS.items()])


def dropped(query) -> int:
    """How many rows came too late for a finished query's first operator with state."""
    return sum(p.stateOperators[-1].numRowsDroppedByWatermark for p in query.recentProgress if p.stateOperators)
