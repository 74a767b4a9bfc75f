"""Running aggregates over keys of any size: hot keys are split among tasks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.sources.shared import kept

_AGGREGATE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True), "before": lambda c: F.last(c, ignorenulls=True)}


def _joined(kind: str, earlier: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(earlier.isNull(), here).when(here.isNull(), earlier).otherwise(earlier + here)
    return {"max": F.greatest, "min": F.least}.get(kind, lambda a, b: F.coalesce(b, a))(earlier, here)


def same(keys: list[str], prefix: str) -> Column:
    """Whether keys are those with a prefix, nulls equal."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def running(rows: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column]], what: str = "running") -> DataFrame:
    """``rows`` with aggregates over each key's rows up to the one at hand, in an order.

    ``order``: rising, nulls first; no two rows of a key are equal in it where
    the kind is last or before. ``values``: name -> (kind, column); kinds are sum, max, min, last (the last
    non-null) and ``before`` (the last non-null of the rows before). Rows are
    dealt by ranges of key and order and written once; a window runs inside each
    key's share of a range. What a key brings into a range comes from the shares
    before it: only keys that reach over a border have such, one at most for
    each border, so that table has two rows a partition at most and is
    broadcast. No task gets more than its range of a key.
    """
    inputs = {f"_v{i}": c for i, (_, c) in enumerate(values.values())}
    kinds = {n: kind for n, (kind, _) in values.items()}
    of = dict(zip(values, inputs, strict=True))
    rows = rows.withColumns(inputs)
    dealt = kept(rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()), what)
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    out = dealt.withColumns({f"_h{n}": _AGGREGATE[k](F.col(of[n])).over(within.rowsBetween(Window.unboundedPreceding, -1 if k == "before" else 0)) for n, k in kinds.items()})
    wide = dealt.groupBy(*keys).agg(F.min("_block").alias("_first"), F.max("_block").alias("_last")).where("_first < _last").select(*[F.col(k).alias(f"_w{k}") for k in keys])
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order)))
    totals = [(latest(of[n]) if k in ("last", "before") else _AGGREGATE[k](F.col(of[n]))).alias(f"_t{n}") for n, k in kinds.items()]
    shares = dealt.join(F.broadcast(wide), same(keys, "_w"), "left_semi").groupBy(*keys, "_block").agg(*totals)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = shares.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("_block").alias("_cblock"), *[_AGGREGATE[k](F.col(f"_t{n}")).over(earlier).alias(f"_e{n}") for n, k in kinds.items()])
    out = out.join(F.broadcast(carried), same(keys, "_c") & (F.col("_block") == F.col("_cblock")), "left")
    out = out.withColumns({n: _joined(k, F.col(f"_e{n}"), F.col(f"_h{n}")) for n, k in kinds.items()})
    return out.select(*[c for c in rows.columns if c not in inputs and c not in values], *values)

