"""Exact ranks without a task that sees all values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 2000


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Per group n and, for each name and share p, the value at rank ceil(p n) in rising order.

    A sketch of bounded size gives values around each rank; a second pass
    counts what lies below them and sorts only what lies between, about
    4 n / ``accuracy`` rows and ties, which are counted before they move. Null
    values do not count; a group with none has null ranks.
    """
    live = rows.where(F.col(value).isNotNull())
    slack = 2 / accuracy
    around = [x for p in shares.values() for x in (max(0.0, p - slack), min(1.0, p + slack))]
    bounds = live.groupBy(F.col(group).alias("_g")).agg(F.percentile_approx(value, around, accuracy).alias("_q"), F.count("*").alias("_n"))
    low, high = (lambda i: F.col("_q")[2 * i]), (lambda i: F.col("_q")[2 * i + 1])
    joined = live.select(F.col(group).alias("_v_g"), F.col(value).alias("_v")).join(bounds, F.col("_v_g").eqNullSafe(F.col("_g")))
    below = joined.groupBy("_g").agg(*[F.count_if(F.col("_v") < low(i)).alias(f"_below{i}") for i in range(len(shares))])
    cells = F.array(*[F.when((F.col("_v") >= low(i)) & (F.col("_v") <= high(i)), F.lit(i)) for i in range(len(shares))])
    counted = joined.select("_g", "_n", "_v", F.explode(F.array_compact(cells)).alias("_i")).groupBy("_g", "_n", "_i", "_v").agg(F.count("*").alias("_k"))
    running = F.sum("_k").over(Window.partitionBy("_g", "_i").orderBy("_v"))
    ranked = counted.withColumn("_to", running).join(below.withColumnRenamed("_g", "_b"), F.col("_g").eqNullSafe(F.col("_b")))
    picks = []
    for i, (name, p) in enumerate(shares.items()):
        rank = F.ceil(F.col("_n") * F.lit(p) - 1e-9)
        to = F.col("_to") + F.col(f"_below{i}")
        picks.append(F.min(F.when((F.col("_i") == i) & (to >= rank), F.col("_v"))).alias(name))
    found = ranked.groupBy("_g", "_n").agg(*picks)
    every = rows.select(F.col(group).alias(group)).distinct()
    return every.join(found, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"), *shares)
