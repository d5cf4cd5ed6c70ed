"""Streams with timers under a moving clock give what the folds over the whole log give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strata.streaming import delivery, timers

START = 1_700_000_000_000


@pytest.fixture()
def moved(spark, tmp_path):
    """Feeds batches one after the other into a stream and gives all it emitted."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(batches, schema, build):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
            delivery.run_to_end(build(stream), delivery.write_once(str(tmp_path / f"out{n}")), str(tmp_path / "cp"))
        return [tuple(r) for n in range(len(batches)) for r in spark.read.schema(build(stream).schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / f"out{n}")).collect()]

    return run


def test_deferred_stream(spark, moved):
    rng = random.Random(1)
    messages = [(f"q{i % 2}", f"m{i:03}", 1 + i % 3, START + rng.choice([1000, 1500, 2500, 9000, rng.randrange(12_000)]), START) for i in range(70)]
    clock = [[("clock", f"c{n}", 0, START + 10**9, START + n)] for n in (1200, 2600, 3100, 9000, 30_000, 60_000)]
    schema = "queue string, message_id string, attempt int, due_at long, at long"
    got = moved([messages, *clock], schema, lambda s: timers.swept_stream(s, 1000))
    want = timers.swept(spark.createDataFrame(messages, schema), 1000).select("queue", "message_id", "attempt", "due_at", "sweep_at").collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(got) == 70
    sweeps = [(r[0], r[4]) for r in got]
    assert max(sweeps.count(s) for s in sweeps) == 10 and all(r[3] <= r[4] for r in got)
    assert [r[4] for r in got if r[0] == "q0"] == sorted(r[4] for r in got if r[0] == "q0")


def test_lease_stream(spark, moved):
    rng = random.Random(2)
    log = []
    for m in range(12):
        at = START
        log.append((f"m{m}", "claim", "w0", at))
        for _ in range(rng.randrange(6)):
            at += rng.choice([100, 900, 1000, 1001, 2500, 3000])
            log.append((f"m{m}", "heartbeat", f"w{rng.randrange(3)}", at))
        if m % 3:
            log.append((f"m{m}", "ack", "w0", at + rng.choice([0, 500, 1000, 1700])))
    log.sort(key=lambda r: r[3])
    now = START + 20_000
    cuts = [0, START + 950, START + 2600, now]  # an event at the watermark would be late
    batches = [*[[r for r in log if a < r[3] <= b] for a, b in zip(cuts, cuts[1:])], *[[("clock", "ack", "", t)] for t in (START + 18_000, now, now)]]
    schema = "message_id string, kind string, owner string, at long"
    got = moved(batches, schema, lambda s: timers.reclaimed_stream(s, 1000))
    want = timers.reclaims(spark.createDataFrame(log, schema), 1000, now).collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(got) > 60
