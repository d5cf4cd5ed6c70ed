"""Transactional sinks: what a failed task or a repeated commit leaves."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from strata.sources import ledger


def events(spark, names, parts=3):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, event string").repartitionByRange(parts, "i").sortWithinPartitions("i").select("event")


def test_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert ledger.read_events(spark, folder).count() == 0
    ledger.append_events(events(spark, ["a", "b\nc", "é", "d"]), folder, "one")
    ledger.append_events(events(spark, ["again"]), folder, "one")
    ledger.append_events(events(spark, ["e", "f"]), folder)
    want = list(enumerate(["a", "b\nc", "é", "d", "e", "f"]))
    assert sorted(map(tuple, ledger.read_events(spark, folder).collect())) == want
    failing = events(spark, list("uvwxyz")).select(F.when(F.col("event") == "y", F.raise_error(F.lit("boom"))).otherwise(F.col("event")).alias("event"))
    with pytest.raises(Exception, match="boom"):
        ledger.append_events(failing, folder, "bad")
    assert sorted(map(tuple, ledger.read_events(spark, folder).collect())) == want
    assert not any(f.startswith("one") and "again" in open(f"{folder}/files/{f}").read() for f in os.listdir(f"{folder}/files"))
    with pytest.raises(Exception, match="only appended"):
        events(spark, ["x"]).write.format("strata_log").mode("overwrite").option("path", folder).save()


def test_documents_are_replaced_whole(spark, tmp_path):
    folder = str(tmp_path / "docs")
    put = lambda rows: ledger.replace_documents(spark.createDataFrame(rows, "name string, content string").repartition(3), folder)
    put([("a.json", "{}"), ("b.json", "old"), ("empty", None)])
    put([("b.json", "new")])
    read = lambda: {f: open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder))}
    assert read() == {"a.json": "{}", "b.json": "new", "empty": ""}
    for rows in ([("b.json", "1"), ("../x", "2")], [("b.json", "1"), ("b.json", "2")]):
        with pytest.raises(Exception, match="document"):
            put(rows)
        assert {f: c for f, c in read().items() if not f.startswith(".staged")} == {"a.json": "{}", "b.json": "new", "empty": ""}


def test_cache_heals(spark, tmp_path):
    folder = str(tmp_path / "cache")
    frame = lambda rows: spark.createDataFrame(rows, "cache_key string, payload string")
    ledger.put_results(frame([("k1", '{"a": 1}'), ("k2", '{"b": [2]}')]), folder)
    ledger.append_events(spark.createDataFrame([('{"cache_key": "k2", "payload": "[broken"}',), ("no json",), ('{"cache_key": "k3", "payload": "[1]"}',)], "event string"), folder)
    wanted = frame([("k1", None), ("k2", None), ("k3", None), ("k4", None), ("k1", None)])
    got = lambda: {r["cache_key"]: (r["payload"], r["hit"]) for r in ledger.get_results(wanted, folder).collect()}
    assert got() == {"k1": ('{"a":1}', True), "k2": (None, False), "k3": (None, False), "k4": (None, False)}
    ledger.put_results(frame([("k2", '{"b":3}')]), folder, "t")
    ledger.put_results(frame([("k2", '{"b":4}')]), folder, "t")
    assert got()["k2"] == ('{"b":3}', True)
    with pytest.raises(Exception, match="JSON object"):
        ledger.put_results(frame([("k9", "[1]")]), folder)
