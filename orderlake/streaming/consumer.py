"""An effect consumer on a stream: one event of a key at a time, retries, dead letters.

State is the last acknowledged sequence of a key. An event that is not the next
one is reported and left to a replay of the source; a handled one is tried until
it succeeds, fails for good, or has used up its attempts or its time. Tries run
in logical time, so a replay from the checkpoint settles every event alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Given key, sequence and attempt (from 1): success, retryable, permanent or panic.
Handler = Callable[[int, int, int], str]


@dataclass(frozen=True)
class Retry:
    """Times in milliseconds; the defaults are fixed values."""

    max_attempts: int = 8
    base: int = 250
    cap: int = 60_000
    deadline: int = 3_600_000

    def delay(self, attempt: int) -> int:
        return min(self.base << min(attempt - 1, 40), self.cap)


def settle(handler: Handler, retry: Retry, key: int, sequence: int, at: int) -> tuple[str, int, int]:
    """(result, attempts, time) of one event."""
    now, attempt = at, 1
    while True:
        outcome = handler(key, sequence, attempt)
        if outcome == "success":
            return "Acked", attempt, now
        if outcome in ("permanent", "panic"):
            return "DeadLettered:" + ("Panic" if outcome == "panic" else "PermanentFailure"), attempt, now
        if now - at >= retry.deadline:
            return "DeadLettered:RetryTimeExhausted", attempt, now
        if attempt >= retry.max_attempts:
            return "DeadLettered:RetryBudgetExhausted", attempt, now
        now += retry.delay(attempt)
        attempt += 1


def consume(feed: DataFrame, handler: Handler, retry: Retry = Retry()) -> DataFrame:
    """key, sequence, result, attempts, at of events (key, sequence, at)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (acked,) = state.get if state.exists else (0,)
        out = []
        # events of one key in one trigger, whose size the source bounds
        for sequence, at in sorted(pd.concat(list(batches))[["sequence", "at"]].itertuples(index=False, name=None)):
            if sequence <= acked:
                out.append((key[0], sequence, "Duplicate", 0, at))
            elif sequence > acked + 1:
                out.append((key[0], sequence, "SequenceGap", 0, at))
            else:
                out.append((key[0], sequence, *settle(handler, retry, key[0], sequence, at)))
                acked = sequence
        state.update((int(acked),))
        yield pd.DataFrame(out, columns=["key", "sequence", "result", "attempts", "at"])

    return feed.select("key", "sequence", "at").groupBy("key").applyInPandasWithState(run, "key long, sequence long, result string, attempts long, at long", "acked long", "append", GroupStateTimeout.NoTimeout)
