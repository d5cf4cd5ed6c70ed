"""Deferred messages and leases with due times: as folds over a log, and as streams that keep them as state with event-time timers.

Time is the log's own, in whole milliseconds. Sweeps happen at multiples of a period and
emit the messages that are due, earliest first, ten at most for each queue; a message that
is left waits for the next sweep. An attempt isn't used up by waiting. A lease lapses where
neither heartbeat nor acknowledgement comes within its time; the message is then claimed
again, with a lease of its own. Both streams give what the folds give, however the log is
cut into batches, as long as no event is late: each is after the watermark that earlier batches have set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SWEEP = 10
DEFERRED = "queue string, message_id string, attempt int, due_at bigint, sweep_at bigint"
RECLAIMED = "message_id string, owner string, reclaimed_at bigint"


def swept(messages: DataFrame, period_ms: int, sweep: int = SWEEP) -> DataFrame:
    """Deferred messages (queue, message_id, attempt, due_at) with ``sweep_at``, the sweep that emits them.

    In order of due times, every tenth message of a queue shares a lane, and a lane gives one message a sweep: so a message's
    sweep is the first one due, or one after its lane's last, and the latter is a running greatest along the lane.
    """
    place = F.row_number().over(Window.partitionBy("queue").orderBy("due_at", "message_id")) - 1
    rows = messages.withColumn("_place", place)
    first = F.ceil(F.col("due_at") / period_ms)
    nth = F.floor(F.col("_place") / sweep)
    lane = Window.partitionBy("queue", F.col("_place") % sweep).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("sweep_at", ((F.max(first - nth).over(lane) + nth) * period_ms).cast("long")).drop("_place")


def reclaims(log: DataFrame, lease_ms: int, now_ms: int) -> DataFrame:
    """(message_id, owner, reclaimed_at): each time up to ``now_ms`` that a message's lease has lapsed.

    The log has message_id, kind (claim, heartbeat or ack), owner and at; nothing after the first acknowledgement counts, and an
    event at the last moment of a lease still holds it.
    """
    order = Window.partitionBy("message_id").orderBy("at", F.col("kind") == "ack")
    acked = F.max((F.col("kind") == "ack").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = log.withColumns({"_acked": acked, "_next": F.lead("at").over(order)}).where(F.coalesce("_acked", F.lit(0)) == 0).where("kind <> 'ack'")
    until = F.least(F.coalesce(F.col("_next") - 1, F.lit(now_ms)), F.lit(now_ms))
    lapses = F.floor((until - F.col("at")) / lease_ms)
    return live.where(lapses >= 1).select("message_id", "owner", F.explode(F.sequence(F.lit(1).cast("long"), lapses)).alias("_n"), "at").select("message_id", "owner", (F.col("at") + F.col("_n") * lease_ms).alias("reclaimed_at"))


class DeferredQueue(StatefulProcessor):
    """Holds a queue's deferred messages and emits those due at each sweep's timer."""

    def __init__(self, period_ms: int, sweep: int = SWEEP):
        self.period, self.sweep = period_ms, sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "message_id string", "due_at bigint, attempt int")
        self.swept = handle.getValueState("swept", "at bigint")

    def _next(self, due_at: int) -> int:
        """The first sweep at which a message can go that is due then: none that has been."""
        last = self.swept.get()[0] if self.swept.exists() else None
        at = -(-due_at // self.period) * self.period
        return at if last is None else max(at, last + self.period)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for message, due_at, attempt in zip(batch["message_id"], batch["due_at"], batch["attempt"]):
                self.waiting.updateValue((message,), (int(due_at), int(attempt)))
                self.handle.registerTimer(self._next(int(due_at)))
        yield pd.DataFrame(columns=[c.split()[0] for c in DEFERRED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted((value[0], name[0], value[1]) for name, value in self.waiting.iterator())
        due = [w for w in waiting if w[0] <= at][: self.sweep]
        for _, name, _ in due:
            self.waiting.removeKey((name,))
        self.swept.update((at,))
        if len(waiting) > len(due):
            self.handle.registerTimer(self._next(waiting[len(due)][0]))
        yield pd.DataFrame([(key[0], name, attempt, due_at, at) for due_at, name, attempt in due], columns=[c.split()[0] for c in DEFERRED.split(", ")])

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """Holds a message's owner and the end of its lease; claims it again whenever that passes."""

    def __init__(self, lease_ms: int):
        self.lease = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "owner string, until bigint, done boolean")

    def _lapsed(self, name: str, owner: str, until: int, before: int) -> tuple[list[tuple], int]:
        out = []
        while until < before:
            out.append((name, owner, until))
            until += self.lease
        return out, until

    def _show(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RECLAIMED.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((at, kind == "ack", owner) for batch in rows for at, kind, owner in zip(batch["at_ms"], batch["kind"], batch["owner"]))
        out: list[tuple] = []
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        owner, until, done = self.held.get() if self.held.exists() else (None, None, False)
        for at, acked, by in events:
            if done:
                break
            if until is not None:
                missed, until = self._lapsed(key[0], owner, until, int(at))
                out += missed
            owner, until, done = by, int(at) + self.lease, bool(acked)
        if until is not None:
            self.held.update((owner, until, done))
            if not done:
                self.handle.registerTimer(until)
        yield self._show(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        owner, until, done = self.held.get()
        lapsed, until = self._lapsed(key[0], owner, until, timerValues.getCurrentWatermarkInMs() + 1)
        self.held.update((owner, until, done))
        self.handle.registerTimer(until)
        yield self._show(lapsed)

    def close(self) -> None:
        pass


def swept_stream(stream: DataFrame, period_ms: int, sweep: int = SWEEP, within: str = "0 seconds") -> DataFrame:
    """Messages as their sweeps come. The stream has queue, message_id, attempt, due_at and the event time ``at``; a queue is a task, so deal a large one to several names."""
    return stream.withWatermark("at", within).groupBy("queue").transformWithStateInPandas(DeferredQueue(period_ms, sweep), outputStructType=DEFERRED, outputMode="append", timeMode="eventTime")


def reclaimed_stream(stream: DataFrame, lease_ms: int, within: str = "0 seconds") -> DataFrame:
    """Reclaims as leases lapse. The stream has message_id, kind, owner and the event time ``at``."""
    rows = stream.withWatermark("at", within).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("message_id").transformWithStateInPandas(Leases(lease_ms), outputStructType=RECLAIMED, outputMode="append", timeMode="eventTime")
