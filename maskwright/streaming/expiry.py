"""Keyed state with a life time: request records and token slots that expire one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright.streaming.process import step

BUCKETS = 64  # parts of a scope: one that a third of all requests share is spread over so many keys
_MICRO = 1_000_000


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order, kind="stable")


class Records(StatefulProcessor):
    """The record of an id in value state. It lives a time from the request that claimed it; a later request finds none and claims anew."""

    def __init__(self, mask: Callable[[str], str], rules_only: Callable[[str], str] | None, ttl_seconds: int, by_event: bool) -> None:
        self.mask, self.rules_only, self.ttl, self.by_event = mask, rules_only, ttl_seconds, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "original string, result string, failure string, ends long"
        self.record = handle.getValueState("record", schema) if self.by_event else handle.getValueState("record", schema, self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, ["at", "seq"])
        held = self.record.get() if self.record.exists() else None
        state, ends = (tuple(held[:3]), held[3]) if held else (None, None)
        old, out = ends, []
        statuses = batch["model_status"] if "model_status" in batch else ["ok"] * len(batch)
        for seq, payload, status, at in zip(batch["seq"], batch["payload"], statuses, _micros(batch["at"]), strict=True):
            if self.by_event and ends is not None and at >= ends:
                state = None
            if state is None:
                ends = at + self.ttl * _MICRO
            state, outcome, reply = step(state, payload, status, self.mask, self.rules_only)
            out.append((key[0], seq, outcome, reply))
        if self.by_event or held is None or tuple(held[:3]) != state:  # with a life by the clock, only a change begins it anew
            self.record.update((*state, ends))
        if self.by_event and ends != old:
            if old is not None:
                self.handle.deleteTimer(old // 1000 + 1)
            self.handle.registerTimer(ends // 1000 + 1)
        yield pd.DataFrame(out, columns=["payload_id", "seq", "outcome", "reply"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.record.clear()
        yield from ()

    def close(self) -> None:
        pass


def expiring_process(requests: DataFrame, mask: Callable[[str], str], ttl_seconds: int, rules_only: Callable[[str], str] | None = None, late: str = "1 hour", clock: str = "event") -> DataFrame:
    """A stream of requests (payload_id, seq, payload, at [, model_status]) answered as by ``process_stream``, from records that live ``ttl_seconds``.

    By the ``event`` clock a request at or after the end of its id's record
    claims it anew, whatever batch it comes in, and timers take the record away
    when the watermark (``late`` behind) has passed its end. By the
    ``processing`` clock the state store itself forgets records (TTL), a time
    after their last change.
    """
    by_event = clock == "event"
    rows = requests.withColumn("at", F.col("at").cast("timestamp"))
    rows = rows.withWatermark("at", late) if by_event else rows
    processor = Records(mask, rules_only, ttl_seconds, by_event)
    return rows.groupBy("payload_id").transformWithStateInPandas(processor, "payload_id long, seq long, outcome string, reply string", "Append", "EventTime" if by_event else "ProcessingTime")


class Slots(StatefulProcessor):
    """The slots of a part of a scope, (type, value) and when each began and ends, as one value: asking the store for one slot costs more than carrying it along. A slot goes when the watermark has passed its end; the part's only timer is at the first end."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * _MICRO

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", "types array<string>, values array<string>, begun array<long>, due long")

    def _held(self) -> tuple[dict[tuple, int], int | None]:
        """When each slot began, and the time of the timer."""
        if not self.slots.exists():
            return {}, None
        types, values, begun, due = self.slots.get()
        return dict(zip(zip(types, values, strict=True), begun, strict=True)), due

    def _keep(self, held: dict[tuple, int], old: int | None) -> None:
        """Write the slots; their timer is at the first millisecond after the first end."""
        due = (min(held.values()) + self.ttl) // 1000 + 1 if held else None
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
        if held:
            self.slots.update(([t for t, _ in held], [v for _, v in held], list(held.values()), due))
        else:
            self.slots.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, ["at", "request_id"])
        held, due = self._held()
        starts = []
        for kind, value, at in zip(batch["type"], batch["value"], _micros(batch["at"]), strict=True):
            slot = (kind, value)
            begun = held.get(slot)
            if begun is None or at >= begun + self.ttl:
                held[slot] = begun = at
            starts.append(begun)
        self._keep(held, due)
        yield pd.DataFrame({"request_id": batch["request_id"].tolist(), "slot_at": pd.to_datetime(pd.Series(starts, dtype="int64"), unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        alive = {slot: at for slot, at in self._held()[0].items() if (at + self.ttl) // 1000 + 1 > passed}
        self._keep(alive, None)  # the timer goes with this call
        yield from ()

    def close(self) -> None:
        pass


def token_slots(requests: DataFrame, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """A stream of requests (request_id, scope, type, value, at) with slot_at, the first request of the slot that each one falls into: ``operators.tokens.slots`` with state that does not grow beyond the slots alive."""
    rows = requests.withColumns({"at": F.col("at").cast("timestamp"), "_part": F.pmod(F.xxhash64("type", "value"), F.lit(BUCKETS)).cast("int")}).withWatermark("at", late)
    kind = requests.schema["request_id"].dataType.simpleString()
    return rows.groupBy("scope", "_part").transformWithStateInPandas(Slots(ttl_seconds), f"request_id {kind}, slot_at timestamp", "Append", "EventTime")
