"""Joins of spans by place: overlap, containment and equality of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.running import running

HOT = 1000  # a bin is hot where it holds more than a thousandth of all spans, so there are this many hot bins at most


def _valid() -> Column:
    return F.coalesce(F.col("start") < F.col("end"), F.lit(False))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], width: int, least: int = 4096) -> DataFrame:
    """Pairs of spans (keys, start, end, ...) of two tables that share a place: keys, l (left row), r (right row), each pair once.

    A span is dealt to every bin of ``width`` places that it touches, and a
    pair counts in the bin in which it begins to overlap. Bins of more than
    ``least`` left spans and a thousandth of all are split: their left spans
    go to one of several parts, their right spans to all of them. Spans without
    a place (null or end <= start) and null keys overlap with nothing.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    dealt = [d.where(_valid()).select(*keys, F.struct(*d.columns).alias(n), bins.alias("_bin")) for d, n in ((left, "l"), (right, "r"))]
    n = dealt[0].groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n")).first()[0] or 0
    limit = max(least, total // HOT)
    hot = n.where(F.col("_n") > limit).select(*keys, "_bin", F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))  # HOT rows at most
    on = [*keys, "_bin"]
    a = dealt[0].join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64("l"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    b = dealt[1].join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1))).drop("_parts")
    pairs = a.join(b, [*on, "_part"]).where("l.start < r.end AND r.start < l.end").where(F.floor(F.greatest("l.start", "r.start") / width) == F.col("_bin"))
    return pairs.select(*keys, "l", "r")


def matches(left: DataFrame, right: DataFrame, keys: list[str], how: str = "overlap", to: str = "matched") -> DataFrame:
    """``left`` with whether some right span of the same keys overlaps it, covers it (``inside``), lies in it (``covers``) or is equal.

    No pairs are made: among the spans in order of their place, the greatest
    end so far (or the least one to come) tells, also where a key holds a
    third of all spans (``running``). A left span without a place or with a
    null key matches nothing.
    """
    if how == "equal":
        found = right.where(_valid()).select(*keys, "start", "end").distinct().withColumn("_m", F.lit(True))
        return left.join(found, [*keys, "start", "end"], "left").select(*left.columns, F.coalesce("_m", F.lit(False)).alias(to))
    place = {"overlap": F.col("end"), "inside": F.col("start"), "covers": -F.col("start")}[how]
    marks = right.where(_valid()).select(*keys, F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), place_of(how).alias("_at"), F.lit(0).alias("_turn"), F.col("end").alias("_end"))
    asks = left.select(*keys, F.struct(*left.columns).alias("_left"), place.alias("_at"), F.lit(-1 if how == "overlap" else 1).alias("_turn"), F.lit(None).cast("bigint").alias("_end"))
    both = marks.unionByName(asks)
    found = running(both, keys, [F.col("_at"), F.col("_turn")], {"_best": ("min" if how == "covers" else "max", F.col("_end").cast("bigint"))}, "spans")
    test = {"overlap": F.col("_best") > F.col("_left.start"), "inside": F.col("_best") >= F.col("_left.end"), "covers": F.col("_best") <= F.col("_left.end")}[how]
    sound = F.col("_left.start") < F.col("_left.end")
    for k in keys:
        sound &= F.col(k).isNotNull()
    return found.where("_left is not null").select("_left.*", F.coalesce(test & sound, F.lit(False)).alias(to))


def place_of(how: str) -> Column:
    """Where a right span stands among the left ones: at its start, from the other end where it is to lie inside."""
    return -F.col("start") if how == "covers" else F.col("start")


def semi(left: DataFrame, right: DataFrame, keys: list[str], how: str = "overlap") -> DataFrame:
    """The left spans that match."""
    return matches(left, right, keys, how, "_matched").where("_matched").drop("_matched")


def anti(left: DataFrame, right: DataFrame, keys: list[str], how: str = "overlap") -> DataFrame:
    """The left spans that do not match."""
    return matches(left, right, keys, how, "_matched").where("NOT _matched").drop("_matched")


def overlap_totals(left: DataFrame, right: DataFrame, keys: list[str], sums: list[str] | None = None) -> DataFrame:
    """Totals over the pairs of ``overlap_pairs``, by the left spans' place (keys, start, end), without making a pair.

    ``spans``: left spans of that place; ``pairs``: their pairs; ``shared``:
    places that the two of a pair share, over all pairs; and each of ``sums``,
    whole-number columns of ``right``, over all pairs. Left spans that overlap
    nothing have zeros. Ends stand before starts of the same place, so that the
    spans begun before a left span's end, less those ended up to its start,
    are the ones it meets; either number is a running sum over ends of spans
    (``running``), of which each span has two. Sums are of 64 bits.
    """
    of = sums or []
    place = [*keys, "start", "end"]
    sound = F.coalesce(F.col("start") < F.col("end"), F.lit(False))
    for k in keys:
        sound &= F.col(k).isNotNull()
    none = F.lit(None).cast("bigint")
    marks = right.where(sound).select(*keys, none.alias("start"), none.alias("end"), *[F.col(c).cast("bigint").alias(f"_of{i}") for i, c in enumerate(of)], F.inline(_sides()))
    asks = left.where(sound).select(*keys, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), *[none.alias(f"_of{i}") for i in range(len(of))], F.inline(_sides()))
    mark, begins = F.col("start").isNull(), F.col("_turn") == 1
    count = lambda test, value: F.when(mark & test, value)
    values = {"_begun": ("sum", count(begins, F.lit(1).cast("bigint"))), "_ended": ("sum", count(~begins, F.lit(1).cast("bigint"))), "_at_begun": ("sum", count(F.lit(True), F.when(begins, F.col("_at")).otherwise(-F.col("_at"))))}
    for i in range(len(of)):
        values |= {f"_begun{i}": ("sum", count(begins, F.col(f"_of{i}"))), f"_ended{i}": ("sum", count(~begins, F.col(f"_of{i}")))}
    found = running(asks.unionByName(marks), keys, [F.col("_at"), F.col("_turn")], values, "totals").where("start is not null").fillna(0, list(values))
    met = lambda n: F.when(begins, -F.col(f"_ended{n}")).otherwise(F.col(f"_begun{n}"))
    before = F.col("_at") * (F.col("_begun") - F.col("_ended")) - F.col("_at_begun")
    totals = {"spans": begins.cast("bigint"), "pairs": met(""), "shared": F.when(begins, -before).otherwise(before)} | {c: met(i) for i, c in enumerate(of)}
    lone = left.where(~sound).select(*keys, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), *[F.lit(int(n == "spans")).cast("bigint").alias(f"_t_{n}") for n in totals])
    each = found.select(*place, *[c.alias(f"_t_{n}") for n, c in totals.items()]).unionByName(lone)
    return each.groupBy(*place).agg(*[F.sum(f"_t_{n}").alias(n) for n in totals])


def _sides() -> Column:
    """Where a span begins and ends, each a row: (_at, _turn), the end's turn before the beginning's."""
    side = lambda c, turn: F.struct(F.col(c).cast("bigint").alias("_at"), F.lit(turn).alias("_turn"))
    return F.array(side("start", 1), side("end", 0))


def full(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``overlap_pairs`` and, with a null on the other side, the spans of either table that overlap none."""
    pairs = overlap_pairs(left, right, keys, width)
    lone = lambda a, b, n, m: anti(a, b, keys).select(*keys, F.struct(*a.columns).alias(n)).withColumn(m, F.lit(None).cast(pairs.schema[m].dataType))
    return pairs.unionByName(lone(left, right, "l", "r")).unionByName(lone(right, left, "r", "l"))
