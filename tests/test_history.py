"""Line alignment, line origins and witness paths."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strata.operators import graph, history


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_longest():
    rng = random.Random(2)
    for _ in range(400):
        old, new = ([rng.choice("abcdef") for _ in range(rng.randrange(14))] for _ in range(2))
        got = history.aligned(old, new)
        assert len(got) == lcs_length(old, new) and all(new[i] == old[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))


def test_origins_in_a_long_history(spark):
    """Forty commits that each append a line and drop the third: every line comes from the commit that appended it."""
    texts, lines = [], []
    for n in range(40):
        lines = [*lines[:2], *lines[3:], f"line {n}"]
        texts.append(("r", "f", f"c{n:02}", "\n".join(lines)))
    commits = spark.createDataFrame([("r", f"c{n:02}", f"c{n - 1:02}" if n else None, 0) for n in range(40)], "repo string, commit string, parent string, nth int")
    versions = spark.createDataFrame([*texts, ("r", "new", "c39", "x\ny"), ("r", "empty", "c39", "")], "repo string, path string, commit string, text string")
    found = history.introduced(commits, versions).where("commit = 'c39'").collect()
    assert {(r["path"], r["line"], r["introduced"]) for r in found} == {("f", i + 1, "c" + f"{int(x.split()[1]):02}") for i, x in enumerate(lines)} | {("new", 1, "c39"), ("new", 2, "c39")}


def test_globs(spark):
    names = spark.createDataFrame([("v1",), ("V2",), ("release-1",), ("v\n",), ("xv1",)], "name string")
    assert {r[0] for r in names.where(history.matches_glob("name", "v*")).collect()} == {"v1", "v\n"}
    assert {r[0] for r in names.where(history.matches_glob("name", "[!v]*-?")).collect()} == {"release-1"}


def test_witness_of_a_start_and_of_nothing(spark):
    edges = spark.createDataFrame([("s", 1, 2, "a"), ("s", 2, 3, "b"), ("s", 3, 1, "c"), ("s", 1, 3, "d")], "scope string, src int, dst int, edge string")
    starts = spark.createDataFrame([("s", 1)], "scope string, node int")
    reached = graph.reach_back(starts, edges, ["scope"])
    targets = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("s", 9)], "scope string, node int")
    assert {r["node"]: r["path"] for r in graph.witnesses(reached, targets).collect()} == {1: [], 2: ["a"], 3: ["d"]}


def test_exploded_sides_are_not_broadcast(spark, tmp_path):
    """Rows exploded from few count as few to Spark, so their sides are merged."""
    spark.range(100).write.parquet(f"{tmp_path}/r")
    versions = spark.read.parquet(f"{tmp_path}/r").select(F.col("id").alias("repo"), F.lit("a").alias("path"), F.explode(F.lit(["c1", "c2"])).alias("commit"), F.lit("x\ny").alias("text"))
    commits = spark.read.parquet(f"{tmp_path}/r").select(F.col("id").alias("repo"), F.lit("c2").alias("commit"), F.lit("c1").alias("parent"), F.lit(0).alias("nth"))
    found = history.parent_lines(commits, versions)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 200
