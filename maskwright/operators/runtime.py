"""Text through a model that must not see it: protect, transform, check, restore."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.tokens import tokens_match

Step = Callable[[DataFrame], DataFrame]


def run(docs: DataFrame, protect: Step, transform: Step, restore: Step) -> DataFrame:
    """``docs`` (doc_id, scope, text) with result and failed.

    ``protect`` adds ``tokenized``; ``transform`` adds ``answer`` from it and
    sees nothing else of the text; ``restore`` takes (doc_id, scope, answer),
    each such row once and with a key of its own in place of the id, and gives
    (doc_id, restored, n_unresolved). Rows that share an id, or have none, come
    back one by one. A null at any step, an answer
    whose tokens are not those of ``tokenized`` in number and order, and a
    token that does not come back fail the row: its result is null and
    ``failed`` names the step.
    """
    safe = protect(docs).drop("text")
    answered = transform(safe.select("doc_id", "scope", "tokenized"))
    checked = answered.withColumn("failed", F.when(F.col("tokenized").isNull(), "protect").when(F.col("answer").isNull() | ~tokens_match(F.col("tokenized"), F.col("answer")), "transform"))
    key = F.sha2(F.to_json(F.struct("doc_id", "scope", "answer"), {"ignoreNullFields": "false"}), 256)
    checked = checked.withColumn("_key", key)
    asked = checked.where("failed is null").select(F.col("_key").alias("doc_id"), "scope", "answer").distinct()
    back = restore(asked).select(F.col("doc_id").alias("_key"), "restored", "n_unresolved")
    out = checked.join(back, "_key", "left").withColumn("failed", F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("restored").isNull() | (F.col("n_unresolved") > 0), "restore"))
    return out.select("doc_id", F.when(F.col("failed").isNull(), F.col("restored")).alias("result"), "failed")
