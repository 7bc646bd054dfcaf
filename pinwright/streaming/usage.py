"""Usage streams: single-use tokens, free quota, device binding, customers.

Each rule is a processor with Spark's keyed state: what it must know of a key is one small
value (of tokens: of a bucket of them, which live for minutes). The rows of a key are judged in the order of their time inside a batch, and on arrival between
batches: a row that comes late is judged by what is known then, as a decision that has been
given cannot be taken back.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import lookups as L
from ..functions import rules as R
from ..operators import ordered


#: Buckets of ids of the single-use tokens. A stream keeps the number that it was started with.
BUCKETS = 4096


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key in a batch by time; a batch is bounded by the stream's admission limits."""
    frame = pd.concat(list(rows), ignore_index=True)
    return frame.assign(at=_micros(frame["ts"])).sort_values(["at", "event_id"])


class _SingleUse(StatefulProcessor):
    """The first use of an id is accepted, and uses within its life are refused.

    A key is a bucket of ids, so that a batch costs a call per bucket and not one per id. The state are the ids of the
    bucket and the times of their accepted uses. Those whose life the watermark has passed are dropped at the bucket's next
    rows: a use that still comes is later than their end, and so a first one again, whether they are known or not.
    """

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ids array<string>, at array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows)
        first = dict(zip(*self.held.get())) if self.held.exists() else {}
        over = timerValues.getCurrentWatermarkInMs() * 1000 - self.life
        verdicts, ids = [], [None if pd.isna(i) else i for i in frame["generation_id"]]
        for i, at in zip(ids, frame["at"].tolist()):
            known = first.get(i)
            accepted = known is None or abs(at - known) > self.life
            verdicts.append("accepted" if accepted else "already_used")
            if known is None or accepted and at > known:
                first[i] = at
        held = {i: at for i, at in first.items() if at >= over}
        self.held.update((list(held), list(held.values())))
        yield pd.DataFrame({"event_id": frame["event_id"].tolist(), "generation_id": ids, "verdict": verdicts})

    def close(self) -> None:
        pass


class _Creation(StatefulProcessor):
    """The first sign-up of a customer creates, repeats within a day are replayed, later ones find the customer.

    The state is the time of creation, one number per customer there is.
    """

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows)
        fresh = not self.first.exists()
        first = int(frame["at"].iloc[0]) if fresh else self.first.get()[0]
        if fresh:
            self.first.update((first,))
        verdicts = (frame["at"] - first <= self.life).map({True: "replayed", False: "found"}).tolist()
        if fresh:
            verdicts[0] = "created"
        yield pd.DataFrame({"event_id": frame["event_id"], "customer_key": key[0], "verdict": verdicts})

    def close(self) -> None:
        pass


class _Quota(StatefulProcessor):
    """The first ``limit`` requests of a customer are allowed; the state is how many have been.

    Of a batch only the earliest rows that may still be allowed are held.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        held = None
        for frame in rows:
            frame = pd.concat([f for f in (held, frame.assign(at=_micros(frame["ts"]))) if f is not None]).sort_values(["at", "event_id"])
            held, rest = frame.iloc[:self.limit - used], frame.iloc[self.limit - used:]
            yield self._rows(key, rest, False, [self.limit] * len(rest))
        if held is not None and len(held):
            yield self._rows(key, held, True, range(used + 1, used + 1 + len(held)))
            self.used.update((used + len(held),))

    @staticmethod
    def _rows(key, frame: pd.DataFrame, allowed: bool, used) -> pd.DataFrame:
        return pd.DataFrame({"event_id": frame["event_id"], "email": key[0], "allowed": allowed,
                             "generations_used": pd.Series(list(used), index=frame.index, dtype="int32")})

    def close(self) -> None:
        pass


class _Device(StatefulProcessor):
    """The first device of a customer is bound, others are refused; a ``clear`` event opens a new epoch.

    The state is the epoch and its device.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bound = handle.getValueState("bound", "epoch bigint, machine_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        epoch, machine = self.bound.get() if self.bound.exists() else (0, None)
        frame, out = _in_order(rows), []
        for event_id, kind, asks in zip(frame["event_id"], frame["kind"], frame["machine_id"]):
            if kind == "clear":
                epoch, machine = epoch + 1, None
                continue
            machine = asks if machine is None else machine
            out.append((event_id, key[0], epoch, machine, "ok" if asks == machine else "device_mismatch"))
        self.bound.update((epoch, machine))
        yield pd.DataFrame(out, columns=["event_id", "email", "epoch", "bound_machine", "verdict"])

    def close(self) -> None:
        pass


def single_use_tokens(events: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Stream of (event_id, generation_id, verdict); a token lives five minutes of event time.

    The ids go to ``buckets`` by their hash; a bucket holds its ids of the last minutes, and its rows of a batch are one call.
    """
    return (
        events.select("generation_id", "event_id", "ts").withWatermark("ts", delay)
        .withColumn("bucket", F.pmod(F.xxhash64("generation_id"), F.lit(buckets))).groupBy("bucket")
        .transformWithStateInPandas(_SingleUse(L.TOKEN_SECONDS * 1_000_000), "event_id bigint, generation_id string, verdict string",
                                    "append", "EventTime")
    )


def customer_creation(events: DataFrame) -> DataFrame:
    """Stream of (event_id, customer_key, verdict): repeated sign-ups fold into one customer per hashed email."""
    return (
        events.select("customer_key", "event_id", "ts").groupBy("customer_key")
        .transformWithStateInPandas(_Creation(86_400_000_000), "event_id bigint, customer_key string, verdict string", "append", "None")
    )


def quota(events: DataFrame) -> DataFrame:
    """Stream of (event_id, email, allowed, generations_used) for consuming requests."""
    return (
        events.filter("mode = 'consume'").select("email", "event_id", "ts").groupBy("email")
        .transformWithStateInPandas(_Quota(L.FREE_QUOTA), "event_id bigint, email string, allowed boolean, generations_used int",
                                    "append", "None")
    )


def device_binding(events: DataFrame) -> DataFrame:
    """Stream of (event_id, email, epoch, bound_machine, verdict) for the requests of devices."""
    return (
        events.select("email", "event_id", "ts", "kind", "machine_id").groupBy("email")
        .transformWithStateInPandas(_Device(), "event_id bigint, email string, epoch bigint, bound_machine string, verdict string",
                                    "append", "None")
    )


def licensed_customers(customers: DataFrame, subscriptions: DataFrame, looked_at: int = 5) -> DataFrame:
    """Customers with an active status among their latest subscriptions.

    ``subscriptions(customer_id, sub_id, created, status)``.
    """
    latest = ordered.top_per_key(subscriptions, ["customer_id"],
                                 [F.desc("created"), F.desc("sub_id")], looked_at)
    active = latest.filter(F.col("status").isin(L.LICENSED_STATUSES)).select("customer_id")
    return customers.join(active, "customer_id", "left_semi")


def unique_creations(stream: DataFrame) -> DataFrame:
    """One row per hashed email within a day, by the built-in watermark operator."""
    return (
        stream.select(R.email_key(F.col("email")).alias("customer_key"), "ts")
        .withWatermark("ts", "24 hours").dropDuplicatesWithinWatermark(["customer_key"])
        .select("customer_key")
    )


# The state store starts Python processes of its own, which do not get shipped packages:
# the processors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
