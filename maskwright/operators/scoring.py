"""Detection quality, masking quality, idempotent requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.process import answers


def detection_metrics(truth: DataFrame, predicted: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """Per type over distinct (case_id, type, start, end): support and predicted (spans in the truth and found), tp, fp, fn, fp_on_hard_negative, precision, recall, f1 and whether each is defined.

    A type that only ``negatives`` has comes with zeros. The spans meet in
    one aggregate that combines before its shuffle; nulls are values.
    """
    keys = ["case_id", "type", "start", "end"]
    tagged = [df.select(*keys, *[F.lit(tag == own).alias(tag) for tag in "tpn"]) for own, df in (("t", truth), ("p", predicted), ("n", negatives)) if df is not None]
    spans = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(*[F.bool_or(tag).alias(tag) for tag in "tpn"])
    counts = spans.groupBy("type").agg(
        F.count_if("t").alias("support"), F.count_if("p").alias("predicted"), F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"),
        F.count_if(~F.col("t") & F.col("p") & F.col("n")).alias("fp_on_hard_negative"),
    )
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")), "precision_defined": F.col("tp") + F.col("fp") > 0, "recall_defined": F.col("tp") + F.col("fn") > 0})
    return out.withColumns({"f1_defined": F.col("precision_defined") & F.col("recall_defined"), "f1": F.round(safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6), "precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def macro_average(metrics: DataFrame) -> DataFrame:
    """Each metric averaged over the types for which it is defined, and how many these are."""
    names = ("precision", "recall", "f1")
    return metrics.agg(*[F.round(F.avg(F.when(F.col(f"{m}_defined"), F.col(m))), 6).alias(f"macro_{m}") for m in names], *[F.count_if(f"{m}_defined").alias(f"{m}_types") for m in names], F.count("*").alias("n_types"))


def corpus_quality(cases: DataFrame) -> DataFrame:
    """Over cases (masked, expected_mask, input, restored): how many, their mean masking quality, and the share that came back exactly; a case that was not restored counts as not exact."""
    exact = F.coalesce(F.col("restored") == F.col("input"), F.lit(False))
    return cases.agg(F.count("*").alias("n_cases"), F.round(F.avg(masking_quality(F.col("masked"), F.col("expected_mask"))), 6).alias("masking_quality"), F.round(F.avg(exact.cast("int")), 6).alias("restoration_exact_rate"))


def masking_quality(got: Column, wanted: Column) -> Column:
    """1 minus edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(got), F.length(wanted))
    return F.when(longest == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(got, wanted) / longest))


def idempotent(requests: DataFrame, mask: Column) -> DataFrame:
    """Requests (payload_id, seq, payload) with outcome and reply, as ``process.answers`` where masking always works."""
    return answers(requests.withColumn("model_status", F.lit("ok")), mask).select("payload_id", "seq", "outcome", "reply")
