"""Idempotent requests as a state machine, in aggregates that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the masking of a request can end in; only the first two are no failure.
STATUSES = ("ok", "degraded", "unavailable", "vault", "review", "error")
FAILURES = {"unavailable": "model_unavailable", "vault": "vault_unavailable", "review": "review_required", "error": "masking_failed"}


def _failure(status: Column) -> Column:
    out = F.lit("masking_failed")
    for name, said in FAILURES.items():
        out = F.when(status == name, said).otherwise(out)
    return out


def with_fallback(requests: DataFrame, allowed: bool, rules_status: Column | None = None, status: str = "model_status") -> DataFrame:
    """``requests`` with ``model_status`` after one try by rules alone where the model was unavailable: ``degraded`` where that is allowed and worked, else the failure of the last try; other failures stay."""
    tried = F.coalesce(rules_status, F.lit("error")) if rules_status is not None else F.lit("ok")
    final = F.when((F.col(status) == "unavailable") & F.lit(allowed), F.when(tried == "ok", "degraded").otherwise(tried)).otherwise(F.coalesce(F.col(status), F.lit("error")))
    return requests.withColumn(status, final)


def answers(requests: DataFrame, mask: Column, status: str = "model_status", rules_only: Column | None = None) -> DataFrame:
    """Requests (payload_id, seq, payload, model_status) with outcome, reply and the state after them.

    In order of ``seq``, which no two requests of an id share: the first
    request claims the id. If masking works, the record is ready: its payload
    again gives the stored mask (``stored``), the mask gives the payload back
    (``restored``), anything else is a ``conflict``. If the model is
    unavailable the claim has failed, and only its own payload may try again;
    another failure stays for good and its payload gets it again; any other
    payload is a conflict.

    Only requests with the first payload move the state, and the first of
    them that does not end in ``unavailable`` decides it. So per id two
    minima are enough, taken before the shuffle; an id that a third of all
    requests share costs no more than others.
    """
    first = requests.groupBy("payload_id").agg(F.min_by(F.struct("payload"), "seq").alias("first")).select(F.col("payload_id").alias("_id"), F.col("first.payload").alias("original"))
    rows = requests.join(first, F.col("payload_id").eqNullSafe(F.col("_id"))).drop("_id")
    own = rows.where(F.col("payload").eqNullSafe(F.col("original")) & (F.coalesce(F.col(status), F.lit("error")) != "unavailable"))
    decisive = own.groupBy("payload_id").agg(F.min("seq").alias("decided"), F.min_by(F.coalesce(F.col(status), F.lit("error")), "seq").alias("ended"), F.min_by(F.when(F.col(status) == "degraded", rules_only if rules_only is not None else mask).otherwise(mask), "seq").alias("result"))
    rows = rows.join(decisive.withColumnRenamed("payload_id", "_id"), F.col("payload_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    same = F.col("payload").eqNullSafe(F.col("original"))
    ready = F.col("ended").isin("ok", "degraded")
    before, at = F.col("decided").isNull() | (F.col("seq") < F.col("decided")), F.col("seq") == F.col("decided")
    outcome = (
        F.when(before & same, "model_unavailable").when(before, "conflict")
        .when(at & ready, F.when(F.col("ended") == "degraded", "degraded").otherwise("masked")).when(~ready & same, _failure(F.col("ended"))).when(~ready, "conflict")
        .when(same, "stored").when(F.col("payload").eqNullSafe(F.col("result")), "restored").otherwise("conflict")
    )
    rows = rows.withColumn("outcome", outcome)
    reply = F.when(F.col("outcome").isin("masked", "degraded", "stored"), F.col("result")).when(F.col("outcome") == "restored", F.col("original"))
    state = F.when(before, "failed:model_unavailable").when(ready, "ready").otherwise(F.concat(F.lit("failed:"), _failure(F.col("ended"))))
    return rows.select("payload_id", "seq", "outcome", reply.alias("reply"), state.alias("state"))


def final_states(answered: DataFrame) -> DataFrame:
    """Per id the state after its last request, and how its requests ended."""
    return answered.groupBy("payload_id").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("n"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"))
