"""Idempotent requests as keyed streaming state.

Handing a group to Python costs some milliseconds, so the key of a group is a
part of the ids, not one id; the records of a part are one value of its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "payload_id long, seq long, outcome string, reply string"
STATE = "ids array<long>, originals array<string>, results array<string>, failures array<string>, ends array<long>"
PARTS = 1024  # of the ids; a part's requests in a micro-batch and its records are in memory at once
FAILED = {"unavailable": "model_unavailable", "vault": "vault_unavailable", "review": "review_required"}


def step(held: tuple | None, payload: str, status: str, mask: Callable[[str], str], rules_only: Callable[[str], str] | None = None) -> tuple[tuple, str, str | None]:
    """(state, outcome, reply) of one request of an id; the state is (original, result, failure)."""
    original, result, failure = held or (payload, None, None)
    if held is None or failure == "model_unavailable" and payload == original:
        if status == "ok":
            return (payload, mask(payload), None), "masked", mask(payload)
        if status == "unavailable" and rules_only is not None:
            return (payload, rules_only(payload), None), "degraded", rules_only(payload)
        failure = FAILED.get(status, "masking_failed")
        return (payload, None, failure), failure, None
    if payload == original:
        return held, failure or "stored", result
    if failure is None and payload == result:
        return held, "restored", original
    return held, "conflict", None


def process_stream(requests: DataFrame, mask: Callable[[str], str], ttl_ms: int | None = None, rules_only: Callable[[str], str] | None = None, parts: int = PARTS) -> DataFrame:
    """Requests (payload_id, seq, payload [, model_status]) of a stream, answered in order of ``seq`` within a micro-batch.

    The states of an id are claimed, ready and failed, as in
    ``operators.process.answers``: the first request is masked and claims it;
    its payload again gives the stored mask, the mask gives the payload back,
    anything else conflicts. Where ``model_status`` is ``unavailable``,
    ``rules_only`` masks once if given, else the claim fails and its payload
    may try again; other failures stay. With ``ttl_ms``, an id that long
    without requests is forgotten. ``parts`` is fixed by the first run of a
    checkpoint.
    """
    status = "model_status" in requests.columns

    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        records = {i: (*record, end) for i, *record, end in zip(*state.get, strict=True)} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if ttl_ms is not None else 0
        if ttl_ms is not None:
            records = {i: r for i, r in records.items() if r[3] > now}
        out: tuple[list, list, list, list] = ([], [], [], [])
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["_last", "_seq"], kind="stable")
            statuses = rows["model_status"] if status else ["ok"] * len(rows)
            for none, i, last, seq, payload, ended in zip(rows["_none"].tolist(), rows["_id"].tolist(), rows["_last"].tolist(), rows["_seq"].tolist(), rows["payload"], statuses, strict=True):
                i = None if none else i
                held = records.get(i)
                held, outcome, reply = step(held and held[:3], payload, ended, mask, rules_only)
                records[i] = (*held, None if ttl_ms is None else now + ttl_ms)
                for column, value in zip(out, (i, None if last else seq, outcome, reply), strict=True):
                    column.append(value)
        if not records:
            state.remove()
        else:
            state.update((list(records), *map(list, zip(*records.values(), strict=True))))
            if ttl_ms is not None:
                state.setTimeoutDuration(max(1, min(r[3] for r in records.values()) - now))
        yield pd.DataFrame({"payload_id": pd.array(out[0], "Int64"), "seq": pd.array(out[1], "Int64"), "outcome": out[2], "reply": out[3]})

    # whole numbers with nulls would become floats in pandas
    whole = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
    rows = requests.select(
        F.pmod(F.xxhash64("payload_id"), F.lit(parts)).cast("int").alias("_part"), F.col("payload_id").isNull().alias("_none"), whole("payload_id").alias("_id"), F.col("seq").isNull().alias("_last"), whole("seq").alias("_seq"),
        F.col("payload").cast("string").alias("payload"), *(["model_status"] if status else []),
    )
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms is not None else GroupStateTimeout.NoTimeout
    return rows.groupBy("_part").applyInPandasWithState(answer, OUTPUT, STATE, "append", timeout)
