"""Rates of counters and slopes of gauges over sliding windows, from samples at any times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.running import running

SECOND = 1_000_000  # times are microseconds


def _sampled(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One sample a series and time (the greatest of several), without nulls."""
    return samples.where("t IS NOT NULL AND value IS NOT NULL").groupBy(*keys, "t").agg(F.max("value").cast("double").alias("value"))


Grid = tuple[int, int, int]  # the first and last time to look at and the step between, in seconds


def _times(grid: Grid) -> Column:
    since, until, step = (F.lit(x * SECOND).cast("bigint") for x in grid)
    return F.sequence(since, until, step)


def _looks(samples: DataFrame, keys: list[str], grid: Grid, ranges: dict[str, int]) -> DataFrame:
    """(keys, t, range, since): the looks at every series, one for each time of the grid and each range."""
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.lit(s * SECOND).cast("bigint").alias("seconds")) for n, s in ranges.items()])).alias("x")
    looks = samples.select(*keys).distinct().select(*keys, every).select(*keys, "x.range", "x.seconds", F.explode(_times(grid)).alias("t"))
    return looks.select(*keys, "t", "range", (F.col("t") - F.col("seconds")).alias("since"))


def _ends(samples: DataFrame, looks: DataFrame, keys: list[str], sums: dict[str, Column], sample: Column) -> DataFrame:
    """``looks`` with ``a_`` and ``b_`` sums over the samples up to the window's start and end, its ``first`` and its ``last`` sample.

    A look stands in the series' order twice, behind the samples of its end
    and of its start, and takes what has run up to there; so a window costs the same whatever its length.
    """
    kind = samples.select(sample.alias("s")).schema[0].dataType
    named, zero = dict(sums), {f.name: F.lit(0).cast(f.dataType) for f in samples.select(*[c.alias(n) for n, c in sums.items()]).schema}
    marks = samples.select(*keys, F.col("t").alias("_at"), F.lit(0).alias("_turn"), F.lit(None).cast("string").alias("range"), F.lit(None).cast("bigint").alias("_t"), sample.alias("_s"), *[c.alias(f"_{n}") for n, c in named.items()])
    nothing = [F.lit(None).cast(kind).alias("_s"), *[F.when(F.lit(False), zero[n]).alias(f"_{n}") for n in named]]
    ends = looks.select(*keys, F.col("t").alias("_at"), F.lit(2).alias("_turn"), "range", F.col("t").alias("_t"), *nothing)
    starts = looks.select(*keys, F.col("since").alias("_at"), F.lit(1).alias("_turn"), "range", F.col("t").alias("_t"), *nothing)
    order = [F.col("_at"), F.col("_turn"), F.col("range"), F.col("_t")]
    up = running(marks.unionByName(ends).unionByName(starts), keys, order, {"last": ("last", F.col("_s"))} | {f"s_{n}": ("sum", F.col(f"_{n}")) for n in named}, "looks")
    back = [-F.col("_at"), -F.col("_turn"), F.col("range"), F.col("_t")]
    down = running(marks.select(*keys, "_at", "_turn", "range", "_t", "_s").unionByName(starts.select(*keys, "_at", "_turn", "range", "_t", "_s")), keys, back, {"first": ("last", F.col("_s"))}, "looks")
    sides = up.where("_t IS NOT NULL").groupBy(*keys, F.col("_t").alias("t"), "range").agg(
        F.max(F.when(F.col("_turn") == 2, F.col("last"))).alias("last"),
        *[F.coalesce(F.max(F.when(F.col("_turn") == 1, F.col(f"s_{n}"))), zero[n]).alias(f"a_{n}") for n in named], *[F.coalesce(F.max(F.when(F.col("_turn") == 2, F.col(f"s_{n}"))), zero[n]).alias(f"b_{n}") for n in named],
    )
    firsts = down.where("_t IS NOT NULL").select(*keys, F.col("_t").alias("t"), "range", "first")
    return looks.join(sides, [*keys, "t", "range"]).join(firsts, [*keys, "t", "range"])


def rates(samples: DataFrame, grid: Grid, ranges: dict[str, int], keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, t, range, increase, rate): what a counter grew in (t - range, t], and a second of it.

    ``samples`` has keys, t (microseconds) and value. Where a value falls the counter was reset and began at zero. A window
    needs two samples; what it grew between the first and the last of them is
    extended to its ends, by half the mean distance of samples where the end
    lies farther than 1.1 of that, and at the start not beyond where the
    counter was zero. Keys must not be null; null times and values count not.
    """
    names = list(keys)
    told = running(_sampled(samples, names), names, [F.col("t")], {"_before": ("before", F.col("value"))}, "samples")
    told = told.withColumn("drop", F.when(F.col("value") < F.col("_before"), F.col("_before")).otherwise(0.0))
    looks = _looks(told, names, grid, ranges)
    found = _ends(told, looks, names, {"n": F.lit(1), "drop": F.col("drop")}, F.struct("t", "value", "drop"))
    n = F.col("b_n") - F.col("a_n")
    grown = F.col("last.value") - F.col("first.value") + F.col("b_drop") - F.col("a_drop") - F.col("first.drop")
    found = found.where(n >= 2).withColumns({"increase": grown, "sampled": (F.col("last.t") - F.col("first.t")).cast("double"), "mean": (F.col("last.t") - F.col("first.t")) / (n - 1)})
    reach = lambda c: F.when(c >= F.col("mean") * 1.1, F.col("mean") / 2).otherwise(c)
    start, end = reach((F.col("first.t") - F.col("since")).cast("double")), reach((F.col("t") - F.col("last.t")).cast("double"))
    zero = F.when((F.col("increase") > 0) & (F.col("first.value") >= 0), F.col("sampled") * (F.col("first.value") / F.col("increase")))
    found = found.withColumn("increase", F.col("increase") * ((F.col("sampled") + F.least(start, zero) + end) / F.col("sampled")))
    return found.select(*names, "t", "range", "increase", (F.col("increase") / ((F.col("t") - F.col("since")) / SECOND)).alias("rate"))


def slopes(samples: DataFrame, grid: Grid, seconds: int, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, t, slope): the slope a second of the line through the samples in (t - seconds, t], two at least, from running sums.

    Sums of times and of their squares are decimals, so that what a window
    adds to them does not drown in what came before it.
    """
    names = list(keys)
    clean = _sampled(samples, names)
    zero = clean.agg(F.min("t")).first()[0] or 0
    x = ((F.col("t") - F.lit(zero)) / SECOND).cast("decimal(18,6)")
    sums = {"n": F.lit(1), "x": x, "y": F.col("value"), "xy": x.cast("double") * F.col("value"), "xx": (x * x).cast("decimal(28,8)")}
    found = _ends(clean, _looks(clean, names, grid, {"all": seconds}), names, sums, F.struct("t", "value"))
    found = found.select(*names, "t", ((F.col("since") - F.lit(zero)) / SECOND).cast("decimal(18,6)").alias("o"), *[(F.col(f"b_{n}") - F.col(f"a_{n}")).alias(n) for n in sums]).where("n >= 2")
    from_start = {"n": "n", "x": "CAST(x - n * o AS DOUBLE)", "xx": "CAST(xx - 2 * o * x + n * o * o AS DOUBLE)", "xy": "xy - CAST(o AS DOUBLE) * y", "y": "y"}
    own = found.select(*names, "t", *[F.expr(e).alias(n) for n, e in from_start.items()])
    return own.select(*names, "t", F.expr("(n * xy - x * y) / (n * xx - x * x)").alias("slope"))


def steadily_rising(samples: DataFrame, grid: Grid, seconds: int = 1800, over: int = 7200, step: int = 300, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """(keys, t, least, rising): the least of the slopes at the multiples of ``step`` in (t - over, t], and whether it is above 0.

    The slopes are taken at the multiples, each over ``seconds``, not at the
    samples; multiples without one are passed over, times without any left out.
    """
    since, until, apart = grid
    found = slopes(samples, ((since - over) // step * step, until // step * step, step), seconds, keys).withColumn("k", F.floor(F.col("t") / (step * SECOND)))
    # a slope at k counts for the times whose last multiple is in [k, k + over / step)
    later = found.select(*keys, "slope", F.explode(F.sequence("k", F.col("k") + over // step - 1)).alias("k"))
    least = later.groupBy(*keys, "k").agg(F.min("slope").alias("least"))
    first = lambda k: F.ceil((k * step - since) / apart)  # noqa: E731  of the grid's times, by number, at a multiple or later
    low, high = F.greatest(first(F.col("k")), F.lit(0)), F.least(first(F.col("k") + 1) - 1, F.lit((until - since) // apart))
    asked = least.where(low <= high).select(*keys, "least", F.explode(F.sequence(low, high)).alias("i"))
    return asked.select(*keys, ((F.col("i") * apart + since) * SECOND).alias("t"), "least", (F.col("least") > 0).alias("rising"))
