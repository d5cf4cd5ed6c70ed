from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strata.operators import lookups
from strata.plans import cases  # noqa: F401
from strata.plans.catalog import ORACLES, QUERIES


def test_search_tells_of_more(spark):
    df = spark.createDataFrame([("b", i, f"Key {i}") for i in range(4)] + [("a", 9, "key")], "path string, line int, content string")
    assert [tuple(r) for r in lookups.search(df, "Key", 3).collect()] == [("b", 0, "Key 0", True), ("b", 1, "Key 1", True), ("b", 2, "Key 2", True)]
    assert {r["truncated"] for r in lookups.search(df, "Key", 4).collect()} == {False}
    assert lookups.search(df, "none", 4).count() == 0
    with pytest.raises(ValueError):
        lookups.search(df, "x", 51)


def test_must_find(spark):
    rows, known = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", 1), ("b", None)], "id string, v int")
    assert sorted((r["id"], r["v"]) for r in lookups.must_find(rows, known, "id", "v").collect()) == [("a", 1), ("b", None)]
    with pytest.raises(Exception, match="unknown id: b"):
        lookups.must_find(rows, known.where("id = 'a'"), "id", "v").collect()


def test_agreement(spark):
    values = [("e", "n", "p1", "1", 1), ("e", "n", "p2", "1.0", 2), ("e", "b", "p1", "true", 1), ("e", "b", "p2", "1", 2), ("e", "s", "p2", '"x"', 2), ("e", "z", "p1", "-0.0", 1), ("e", "z", "p2", "0", 2), ("e", "u", "p1", "null", 1)]
    df = spark.createDataFrame(values, "entity string, field string, pointer string, value string, priority int")
    assert [(r["field"], r["n"]) for r in lookups.conflicting_fields(df).collect()] == [("b", 2)]
    wanted = spark.createDataFrame([("e", f) for f in ("n", "s", "m", "u")], "entity string, field string")
    got = {r["field"]: (r["value"], r["sources"], r["note"]) for r in lookups.projected_fields(df, wanted).collect()}
    assert got == {"n": ("1", ["p1", "p2"], None), "s": ('"x"', ["p2"], None), "m": (None, [], "not stated"), "u": ("null", ["p1"], "stated as null")}


def test_rows_of_one_pointer(spark):
    df = spark.createDataFrame([("e", "f", "p", str(v), 1, nth) for nth, v in ((3, 1), (1, 9), (2, 5))] + [("e", "f", "p0", "7", 2, 0)], "entity string, field string, pointer string, value string, priority int, nth int")
    wanted = spark.createDataFrame([("e", "f")], "entity string, field string")
    for rows in (df, df.orderBy("nth"), df.orderBy(F.desc("nth"))):
        assert lookups.projected_fields(rows.coalesce(1), wanted, tie="nth").first()["value"] == "9"


def test_fields_of_rows_with_nulls(spark):
    rows = [("e", "a", None, "p1", 1), ("e", "a", "5", "p2", 2), ("e", "b", "6", None, 1), ("e", "b", "7", "p3", 1), ("e", "c", "8", "p4", None), ("e", "c", "9", "p5", 3), ("e", "d", None, None, 1)]
    df = spark.createDataFrame(rows, "entity string, field string, value string, pointer string, priority int")
    wanted = spark.createDataFrame([("e", f) for f in "abcdz"], "entity string, field string")
    got = {r["field"]: (r["value"], r["sources"], r["note"]) for r in lookups.projected_fields(df, wanted).collect()}
    assert got == {"a": ("5", ["p1", "p2"], None), "b": ("7", ["p3"], None), "c": ("9", ["p5", "p4"], None), "d": (None, [], None), "z": (None, [], "not stated")}


def test_projected_lines_with_nulls(spark, tmp_path):
    lines = [(1, 1, 1, 10, "A"), (1, 2, 1, None, "A"), (1, 3, None, 11, "A"), (1, None, 1, 12, "A"), (1, 5, 3, 13, None), (2, None, None, 14, "A"), (3, 1, 1, None, "R"), (None, 4, 2, 15, "A")]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1, 5).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect(config={"threads": 1})
    for name in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(ORACLES["projected_fields"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in QUERIES["projected_fields"](spark, str(tmp_path)).collect())


def test_clipping(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé漢𝔘") for _ in range(12)) for _ in range(40)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in (0, 1, 5, 17):
        want = [None if t is None else t.encode()[:limit].decode(errors="ignore") for t in texts]
        assert [r[0] for r in df.select(lookups.clipped(F.col("t"), limit)).collect()] == want
