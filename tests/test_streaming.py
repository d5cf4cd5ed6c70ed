"""Streams give what the batch folds give."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.streaming import delivery


def test_deduplicated_stream(spark, tmp_path):
    data = [(f"d{i % 7}", "p", f"2024-01-01 00:00:{i:02d}") for i in range(20)]
    spark.createDataFrame(data, "delivery_id string, payload string, at string").select("delivery_id", "payload", F.to_timestamp("at").alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("delivery_id string, payload string, at timestamp").parquet(str(tmp_path / "in"))
    delivery.run_to_end(delivery.deduplicated(stream, "at"), delivery.write_once(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert sorted(r["delivery_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"d{i}" for i in range(7)]


def test_attempts_stream(spark, tmp_path):
    data = [("a", False), ("a", False), ("a", False), ("a", False), ("b", True), ("c", False)]
    spark.createDataFrame(data, "message_id string, permanent boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("message_id string, permanent boolean").parquet(str(tmp_path / "in"))
    delivery.run_to_end(delivery.attempts(stream), delivery.write_once(str(tmp_path / "out")), str(tmp_path / "cp"))
    got = sorted((r["message_id"], r["attempt"], r["route"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, "retry"), ("a", 2, "retry"), ("a", 3, "dead"), ("b", 3, "dead"), ("c", 1, "retry")]


def test_routes_and_backoff(spark):
    df = spark.createDataFrame([("a", 1, False, 10.0, "e"), ("b", 3, False, 10.0, "e"), ("c", 1, True, 10.0, "e"), ("d", 2, False, 10.0, "e")], "message_id string, attempt int, permanent boolean, failed_at double, error string")
    got = {r["message_id"]: (r["route"], r["due_at"]) for r in delivery.route_failures(df).collect()}
    assert got == {"a": ("retry", 11.0), "b": ("dead", None), "c": ("dead", None), "d": ("retry", 12.0)}


def test_unknown_stage_raises(spark):
    import pytest

    with pytest.raises(Exception, match="unknown stage"):
        delivery.stage_progress(spark.createDataFrame([("t", "nowhere", 1)], "task_id string, stage string, seq long")).collect()
