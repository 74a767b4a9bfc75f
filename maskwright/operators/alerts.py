"""Sliding ratios, burn rates, growth, and alerts that hold for a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of the ratio windows, and the burn alerts: name -> (long window, short window, factor, seconds to hold).
WINDOWS = {"5m": 300, "30m": 1800, "1h": 3600, "2h": 7200, "6h": 21600, "1d": 86400}
BURNS = {"fast": ("1h", "5m", 14.4, 120), "slow": ("6h", "30m", 6.0, 900), "ticket": ("1d", "2h", 3.0, 3600)}
BUDGET = 0.005
# Name -> (numerator, denominator (none: a rate a second), threshold, seconds to hold), over 5 minutes.
THRESHOLDS = {
    "model_errors": ("model_failed", "model_calls", 0.05, 300), "llm_errors": ("llm_failed", "llm_calls", 0.1, 600), "overloaded": ("rejected", "requests", 0.01, 600), "auth_failures": ("unauthorized", None, 1.0, 600),
}
STEP = 60  # seconds between two looks


DAY = 86400


def grid(rows: DataFrame, counts: dict[str, Column], step: int = STEP, at: str = "ts", since: int | None = None, until: int | None = None) -> DataFrame:
    """(t, counts): a row for every step from the first to the last, also where nothing happened; sums are taken before the shuffle. ``t`` is the step's end in seconds; a row at its end belongs to it.

    ``since`` and ``until`` bound the steps: rows of steps outside count in
    none (``outside`` finds them), so one stray time can't stretch the grid.
    Days are dealt out first and filled with steps where they are.
    """
    second = F.unix_micros(F.col(at).cast("timestamp"))
    bucket = (F.ceil(second / F.lit(step * 1_000_000)) * F.lit(step)).cast("bigint")
    found = rows.where(F.col(at).isNotNull()).groupBy(bucket.alias("t")).agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in counts.items()]).where(within(since, until))
    span = found.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a is not null")
    stride = F.lit(step * max(1, DAY // step)).cast("bigint")
    days = span.select("b", F.explode(F.sequence("a", "b", stride)).alias("d")).repartition("d")
    steps = days.select(F.explode(F.sequence("d", F.least("b", F.col("d") + stride - F.lit(step)), F.lit(step).cast("bigint"))).alias("t"))
    return steps.join(found, "t", "left").select("t", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in counts])


def within(since: int | None, until: int | None) -> Column:
    """Whether a step ``t`` is at ``since`` or later and at ``until`` or before."""
    return (F.lit(True) if since is None else F.col("t") >= since) & (F.lit(True) if until is None else F.col("t") <= until)


def outside(rows: DataFrame, since: int | None, until: int | None, step: int = STEP, at: str = "ts") -> DataFrame:
    """The rows that ``grid`` counts in no step: without a time, or of a step outside the bounds."""
    bucket = (F.ceil(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(step * 1_000_000)) * F.lit(step)).cast("bigint")
    return rows.withColumn("t", bucket).where(F.col("t").isNull() | ~within(since, until)).drop("t")


def over(seconds: int) -> object:
    """The frame of the last ``seconds`` up to each step; the rows are steps, so its size is bounded by the time covered."""
    return Window.orderBy("t").rangeBetween(1 - seconds, 0)


def ratio(part: str, whole: str, seconds: int) -> Column:
    """A sum over another one in a window; null where the window has none."""
    total = F.sum(whole).over(over(seconds))
    return F.when(total > 0, F.sum(part).over(over(seconds)) / total)


def ratios(steps: DataFrame, part: str = "errors", whole: str = "requests") -> DataFrame:
    """``steps`` with a ratio column for each of the windows."""
    return steps.withColumns({f"ratio_{n}": ratio(part, whole, s) for n, s in WINDOWS.items()})


def holding(steps: DataFrame, test: Column, seconds: int, to: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``steps`` (of each ``by``) with whether ``test`` has held at every step for ``seconds``."""
    rows = steps.withColumn("_good", F.coalesce(test, F.lit(False)))
    rows = rows.withColumn("_run", F.sum((~F.col("_good")).cast("int")).over(Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    begun = F.min(F.when(F.col("_good"), F.col("t"))).over(Window.partitionBy(*by, "_run"))
    return rows.withColumn(to, F.col("_good") & (F.col("t") - begun >= seconds)).drop("_good", "_run")


def burn_alerts(steps: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``ratios`` with burn_<name>: both windows of the alert burn the error budget faster than its factor, for as long as it must hold."""
    rows = ratios(steps)
    for name, (long, short, factor, hold) in BURNS.items():
        limit = F.lit(factor * budget)
        rows = holding(rows, (F.col(f"ratio_{long}") > limit) & (F.col(f"ratio_{short}") > limit), hold, f"burn_{name}")
    return rows


def threshold_alerts(steps: DataFrame, seconds: int = 300) -> DataFrame:
    """``steps`` with a column for each threshold alert, and ``down``: no request for two minutes."""
    rows = steps
    for name, (part, whole, limit, hold) in THRESHOLDS.items():
        value = ratio(part, whole, seconds) if whole else F.sum(part).over(over(seconds)) / F.lit(seconds)
        rows = holding(rows.withColumn("_value", value), F.col("_value") > limit, hold, f"alert_{name}").drop("_value")
    return holding(rows, F.col("requests") == 0, 120, "alert_down")


def liveness(samples: DataFrame, span: tuple[int, int, int], look_back: int = 300, down: int = 120, absent: int = 300) -> DataFrame:
    """(t, n_up, n_down, alert_down, alert_absent) at each step of ``span`` (first, last and step in seconds) of samples (series, t in microseconds, up).

    A step sees a series' last sample if it is less than ``look_back``
    seconds old; of samples at one time the greatest counts. ``n_up`` is the
    number of series seen with a value other than 0, ``n_down`` of those that
    have been at 0 for ``down`` seconds, the alert that there is one; a series
    that isn't seen is not down. ``alert_absent``: no series has been seen for
    ``absent`` seconds. Samples without a series, a time or a value count for
    nothing. Samples combine by series and step before the shuffle, so what is
    kept in order is a row a step and series, however many samples there are.
    """
    first, last, step = span
    us = 1_000_000
    sound = samples.where("series IS NOT NULL AND t IS NOT NULL AND up IS NOT NULL").where((F.col("t") > (first - look_back) * us) & (F.col("t") <= last * us))
    at = F.greatest(F.lit(first), F.lit(first) + F.ceil((F.col("t") - first * us) / F.lit(step * us)) * step).cast("bigint")
    seen = sound.groupBy("series", at.alias("s")).agg(F.max(F.struct("t", F.col("up").cast("double").alias("up"))).alias("sample")).where(F.col("s") <= last)
    # a sample shows at its own step and at those that follow while it is young enough
    steps = F.sequence("s", F.least(F.lit(last).cast("bigint"), F.col("s") + F.lit(look_back // step * step)), F.lit(step).cast("bigint"))
    shown = seen.select("series", "sample", F.explode(steps).alias("s")).where(F.col("sample.t") > (F.col("s") - look_back) * us)
    looked = shown.groupBy("series", F.col("s").alias("t")).agg(F.max("sample")["up"].alias("up"))
    # a series that isn't seen at a step breaks its run at 0: runs are of steps in a row
    row = F.row_number().over(Window.partitionBy("series", "_zero").orderBy("t"))
    zeros = looked.withColumn("_zero", F.col("up") == 0).withColumn("_run", F.col("t") - row * step)
    since = F.min("t").over(Window.partitionBy("series", "_zero", "_run"))
    held = zeros.withColumn("_down", F.col("_zero") & (F.col("t") - since >= down))
    counts = held.groupBy("t").agg(F.count_if(~F.col("_zero")).alias("n_up"), F.count_if("_down").alias("n_down"), F.lit(True).alias("_any"))
    every = samples.sparkSession.range(first, last + 1, step).withColumnRenamed("id", "t").join(counts, "t", "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in ("n_up", "n_down")})
    return holding(every, F.col("_any").isNull(), absent, "alert_absent").select("t", "n_up", "n_down", (F.col("n_down") > 0).alias("alert_down"), "alert_absent")


def quantile(p: float, total: str, counts: list[str], bounds: tuple[float, ...]) -> Column:
    """The p quantile of cumulative buckets (columns ``counts`` with the upper bounds ``bounds``), linear within a bucket; beyond the last bucket its bound, null where ``total`` is 0."""
    rank = F.lit(p) * F.col(total)
    value = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        low, below = (F.lit(float(bounds[i - 1])), F.col(counts[i - 1])) if i else (F.lit(0.0), F.lit(0))
        value = F.when(F.col(counts[i]) >= rank, low + (F.lit(float(bounds[i])) - low) * (rank - below) / (F.col(counts[i]) - below)).otherwise(value)
    return F.when(F.col(total) > 0, value)


def growing(samples: DataFrame, slope_seconds: int = 1800, for_seconds: int = 7200, hold: int = 900) -> DataFrame:
    """Samples (series, t, value) with slope, least and growing: the slope of a line through the last ``slope_seconds``, its least over ``for_seconds``, and whether that has been above 0 for ``hold``."""
    frame = lambda s: Window.partitionBy("series").orderBy("t").rangeBetween(-s, 0)
    rows = samples.withColumn("slope", F.regr_slope(F.col("value"), F.col("t").cast("double")).over(frame(slope_seconds)))
    rows = rows.withColumn("least", F.min("slope").over(frame(for_seconds)))
    ok = F.coalesce(F.col("least") > 0, F.lit(False))
    bad = F.max(F.when(~ok, F.col("t"))).over(frame(hold))
    begun = F.min("t").over(Window.partitionBy("series"))
    return rows.withColumn("growing", ok & bad.isNull() & (F.col("t") - begun >= hold))
