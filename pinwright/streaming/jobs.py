"""Job log streams: folding to the current status, and expiry after creation."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import lookups as L

TERMINAL = ["complete", "error"]
#: How long after a job's last event its expired mark is kept: 30 days.
MARK_SECONDS = 30 * 86_400


def fold_jobs(events: DataFrame) -> DataFrame:
    """Latest event, first terminal event and message count per job.

    Works on a batch table and, in update mode, on a stream: all three are
    aggregates with map-side combine.
    """
    at = F.struct("ts", "event_id")
    ends = F.col("event").isin(TERMINAL)
    return events.groupBy("job_id").agg(
        F.max_by("event", at).alias("last_event"),
        F.min_by("event", F.when(ends, at)).alias("outcome"),
        F.count_if(F.col("event") == "status").alias("messages"),
        F.count(F.lit(1)).alias("events"),
    )


class _Expiry(StatefulProcessor):
    """Keeps a job's creation time, its last event and one timer; its age decides, not activity.

    A job expires once: afterwards a mark stays, and later events of the job only keep the mark alive.
    The mark ends when the watermark is ``keep_ms`` past the job's last event; what comes
    after that is a new job. An event that far behind the last one starts a new job by its own time too, whether
    or not a timer has come first, so results don't depend on how the stream is cut into batches.
    """

    def __init__(self, life_ms: int, keep_ms: int) -> None:
        self.life_ms, self.keep_ms = life_ms, max(life_ms, keep_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "created_ms bigint, last_ms bigint, expired boolean")

    def _ends(self, created: int, last: int, expired: bool) -> int:
        return last + self.keep_ms if expired else created + self.life_ms

    def _row(self, key, created: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "created_ms": [created], "expired_ms": [created + self.life_ms]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.job.get() if self.job.exists() else None
        state = known
        for at in sorted(int(t.value // 1_000_000) for frame in rows for t in frame["ts"]):
            if state is None:
                state = (at, at, False)
            elif at - state[1] > self.keep_ms:
                if not state[2]:
                    yield self._row(key, state[0])
                state = (at, at, False)
            else:
                created, last, expired = state
                state = (created if expired else min(created, at), max(last, at), expired)
        if state is not None and state != known:
            if known is not None:
                self.handle.deleteTimer(self._ends(*known))
            self.job.update(state)
            self.handle.registerTimer(self._ends(*state))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, last, expired = self.job.get()
        if expired:
            self.job.clear()
            yield pd.DataFrame()
            return
        self.job.update((created, last, True))
        self.handle.registerTimer(last + self.keep_ms)
        yield self._row(key, created)

    def close(self) -> None:
        pass


def expired_jobs(events: DataFrame, delay: str = "0 seconds", keep_seconds: int = MARK_SECONDS) -> DataFrame:
    """Stream of jobs whose lifetime passed, by event-time timers.

    State is held for jobs with an event in the last ``keep_seconds`` (no less than a lifetime), not for all jobs ever seen.
    """
    return (
        events.select("job_id", "ts").withWatermark("ts", delay).groupBy("job_id")
        .transformWithStateInPandas(
            statefulProcessor=_Expiry(L.JOB_SECONDS * 1000, keep_seconds * 1000),
            outputStructType="job_id bigint, created_ms bigint, expired_ms bigint",
            outputMode="append", timeMode="EventTime")
    )


# The state store starts Python processes of its own, which do not get shipped packages:
# the processor travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
