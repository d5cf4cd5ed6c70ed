"""At-least-once delivery as streams: idempotent intake, attempts, retries with due times, deferral and dead letters.

Each function has a batch form over a log, which gives the state that a stream
would have reached, and a stream form where Spark keeps the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ENVELOPE = "message_id STRING, attempt INT, payload STRING, submitted_at DOUBLE"
MAX_ATTEMPTS = 3
# Task stages in order.
STAGES = [
    "QUEUED", "RESOLVING_REVISION", "CHECKING_CACHE", "DOWNLOADING_ARCHIVE", "VALIDATING_ARCHIVE", "PREPARING_WORKSPACE", "BUILD_AGENT_PREPARATION", "INVENTORY", "DATAFLOW_ANALYSIS", "AST_ANALYSIS", "SAST_ANALYSIS",
    "PLATFORM_ANALYSIS", "SEMANTIC_TRIAGE", "FINALIZING", "COMPLETED",
]


def envelopes(tasks: DataFrame) -> DataFrame:
    """Messages for tasks (task_id, payload, submitted_at): the id is the task's, else a fresh one, so that equal payloads stay messages of their own.

    Fresh ids differ each time the frame is computed: store the result before it is used twice.
    """
    key = F.coalesce("task_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return tasks.select(key.alias("message_id"), F.lit(1).alias("attempt"), "payload", F.col("submitted_at").cast("double").alias("submitted_at"))


def accepted(deliveries: DataFrame) -> DataFrame:
    """The first delivery of each id. Deliveries: delivery_id, payload, seq."""
    return deliveries.groupBy("delivery_id").agg(F.min_by(F.struct("payload", "seq"), "seq").alias("x")).select("delivery_id", "x.*")


def conflicts(deliveries: DataFrame) -> DataFrame:
    """Ids that came with different payloads."""
    return deliveries.groupBy("delivery_id").agg(F.count_distinct(F.sha2("payload", 256)).alias("payloads")).where("payloads > 1")


def deduplicated(stream: DataFrame, event_time: str, within: str = "1 day", key: str = "delivery_id") -> DataFrame:
    """A stream without repeats of an id. State is bounded by the watermark: a repeat later than that passes again."""
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])


def backoff_seconds(attempt: Column, most: int = 10) -> Column:
    """1, 2, 4, ... seconds, ``most`` at the most."""
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(float(most)))


def route_failures(failed: DataFrame, attempts: int = MAX_ATTEMPTS, delayed: bool = True) -> DataFrame:
    """Failed messages with ``route`` (retry or dead), the next attempt and its due time. Failed: message_id, attempt, permanent, failed_at, error."""
    dead = F.col("permanent") | (F.col("attempt") >= attempts)
    wait = backoff_seconds(F.col("attempt")) if delayed else F.lit(0.0)
    return failed.withColumns({
        "route": F.when(dead, "dead").otherwise("retry"), "next_attempt": F.when(~dead, F.col("attempt") + 1), "due_at": F.when(~dead, F.col("failed_at") + wait), "error": F.substring("error", 1, 2000),
    })


def deferred(messages: DataFrame, now: Column, sweep: int = 10) -> DataFrame:
    """The next due deferred messages (message_id, attempt, due_at), earliest first; deferral doesn't use up an attempt."""
    return messages.where(F.col("due_at") <= now).orderBy("due_at", "message_id").limit(sweep)


def dead_letters(dead: DataFrame, limit: int = 100) -> DataFrame:
    """Newest dead letters, 1 to 500 of them."""
    return dead.orderBy(F.desc("failed_at"), "message_id").limit(max(1, min(500, limit)))


def replayed(dead: DataFrame, ids: DataFrame) -> DataFrame:
    """Dead letters chosen by id as new first attempts."""
    return dead.join(ids.select("message_id").distinct(), "message_id", "left_semi").select("message_id", F.lit(1).alias("attempt"), "payload", F.col("failed_at").alias("submitted_at"))


def undispatched(outbox: DataFrame, dispatched: DataFrame, limit: int = 100) -> DataFrame:
    """Outbox rows not yet dispatched, by delivery id."""
    return outbox.join(dispatched.select("delivery_id").distinct(), "delivery_id", "left_anti").orderBy("delivery_id").limit(limit)


def stage_progress(events: DataFrame) -> DataFrame:
    """Last stage of each task with its place; a task whose last stage isn't known raises. Events: task_id, stage, seq."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(STAGES, 1) for x in (s, i)])
    last = events.groupBy("task_id").agg(F.max_by("stage", "seq").alias("stage"))
    at = place[F.col("stage")]
    return last.withColumn("place", F.when(at.isNull(), F.raise_error(F.concat(F.lit("unknown stage "), "stage"))).otherwise(at))


def stale(leases: DataFrame, now: Column, lease_seconds: float) -> DataFrame:
    """Unacknowledged messages idle for a lease or longer, to be claimed again. Leases: message_id, renewed_at, acknowledged."""
    return leases.where(~F.col("acknowledged") & (now - F.col("renewed_at") >= lease_seconds))


class AttemptCounter(StatefulProcessor):
    """Counts failures of each message; emits a retry until the attempts are used up, then a dead letter, once."""

    def __init__(self, attempts: int = MAX_ATTEMPTS):
        self.attempts = attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("attempt", "attempt int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self.count.get()[0] if self.count.exists() else 0
        out = []
        for batch in rows:
            for permanent in batch["permanent"]:
                if used >= self.attempts:
                    continue
                used = self.attempts if permanent else used + 1
                out.append((key[0], used, "dead" if used >= self.attempts else "retry"))
        self.count.update((used,))
        yield pd.DataFrame(out, columns=["message_id", "attempt", "route"])

    def close(self) -> None:
        pass


def attempts(stream: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Routes for a stream of failures (message_id, permanent), with the attempt counts as state."""
    return stream.groupBy("message_id").transformWithStateInPandas(AttemptCounter(most), outputStructType="message_id string, attempt int, route string", outputMode="append", timeMode="none")


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain what is there through an idempotent batch writer, acknowledging a batch only after it is written."""
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_once(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that puts every batch into its own folder, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
