"""Path-dependent counters: a sliding-window rate limiter and a feedback state machine.

Both are folds over a key's events in order.  In batch they run over rows sorted by key and
time inside hash partitions, holding the state of one key at a time; as streams they keep the
same state per key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

WINDOW_S, LIMIT = 60.0, 3
#: Uses and acceptance from which a gray item is promoted, and bad cases that deprecate it.
PROMOTE_USES, PROMOTE_RATE, BAD_CASES = 3, 0.8, 3


def admit(seen: deque, at: float, window: float, limit: int) -> bool:
    """Whether an event is admitted; only admitted events count later."""
    while seen and seen[0] <= at - window:
        seen.popleft()
    if len(seen) >= limit:
        return False
    seen.append(at)
    return True


def _sorted(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order)


def _with_allowed(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("allowed", BooleanType())])


def rate_limit(events: DataFrame, window: float = WINDOW_S, limit: int = LIMIT) -> DataFrame:
    """(event_id, key, at seconds) with ``allowed``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen = object(), deque()
        for frame in frames:
            allowed = []
            for key, at in zip(frame["key"], frame["at"], strict=True):
                if key != now:
                    now, seen = key, deque()
                allowed.append(admit(seen, at, window, limit))
            yield frame.assign(allowed=allowed)

    rows = events.select("event_id", "key", "at")
    return _sorted(rows, "key", ["at", "event_id"]).mapInPandas(run, _with_allowed(rows))


def rate_limit_stream(events: DataFrame, window: float = WINDOW_S, limit: int = LIMIT) -> DataFrame:
    """The limiter as a stream; the state of a key is at most ``limit`` instants."""

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seen = deque(held.get[0]) if held.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        rows["allowed"] = [admit(seen, at, window, limit) for at in rows["at"]]
        held.update((list(seen),))
        yield rows

    rows = events.select("event_id", "key", "at")
    return rows.groupBy("key").applyInPandasWithState(
        run, _with_allowed(rows), "seen array<double>", "append", GroupStateTimeout.NoTimeout
    )


def next_status(status: str, uses: int, accepted: int, bad: int) -> str:
    """A gray item is promoted on a high rate, any is deprecated on bad cases."""
    if status == "gray" and uses >= PROMOTE_USES and accepted / uses >= PROMOTE_RATE:
        return "promoted"
    return "deprecated" if bad >= BAD_CASES else status


def feedback_fold(feedback: DataFrame) -> DataFrame:
    """(key, uses, accepted, bad, status, changes) of (key, seq, ok): the last state of each key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out = []
            for key, ok in zip(frame["key"], frame["ok"], strict=True):
                if state is None or key != now:
                    if state is not None:
                        out.append((now, *state))
                    now, state = key, [0, 0, 0, "gray", 0]
                state[0] += 1
                state[1] += bool(ok)
                state[2] += not ok
                after = next_status(state[3], *state[:3])
                state[4] += after != state[3]
                state[3] = after
            yield pd.DataFrame(out, columns=COLUMNS)
        if state is not None:
            yield pd.DataFrame([(now, *state)], columns=COLUMNS)

    return _sorted(feedback.select("key", "seq", "ok").where(F.col("key").isNotNull()), "key", ["seq"]).mapInPandas(
        run, "key bigint, uses bigint, accepted bigint, bad bigint, status string, changes bigint"
    )


COLUMNS = ["key", "uses", "accepted", "bad", "status", "changes"]
