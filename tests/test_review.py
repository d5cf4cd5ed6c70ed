from __future__ import annotations

from strata.operators import review


def test_verification(spark):
    rows = [("a", 0.5, 0.08, True, [], True, "use a parser"), ("b", 0.9, -0.35, True, [], True, "ignore error here"), ("c", 0.99, 0.08, False, ["no line"], False, "fix"), ("d", 0.5, None, True, [], True, None)]
    df = spark.createDataFrame(rows, "id string, confidence double, adjustment double, accepted boolean, objections array<string>, reproducible boolean, fix string")
    got = {r["id"]: (round(r["confidence"], 4), r["approved"], r["reasons"]) for r in review.verify(df).collect()}
    assert got == {"a": (0.58, True, []), "b": (0.55, False, ["fix not ready"]), "c": (1.0, False, ["no line", "not reproducible"]), "d": (0.5, False, ["fix not ready", "low confidence"])}


def test_provenance(spark):
    candidates = spark.createDataFrame([(c,) for c in "abcde"], "candidate_id string")
    evidence = spark.createDataFrame([("a", "supports", "r1"), ("b", "supports", "r2"), ("c", "refutes", "r1"), ("d", "refutes", "r1")], "candidate_id string, polarity string, run_id string")
    runs = spark.createDataFrame([("r1", "completed"), ("r2", "failed")], "run_id string, status string")
    statuses = spark.createDataFrame([("c", "REFUTED"), ("d", "SATISFIED")], "candidate_id string, status string")
    got = {r["candidate_id"]: (r["verdict"], r["gap"]) for r in review.provenance_verdicts(candidates, evidence, runs, statuses).collect()}
    assert got == {"a": ("support", None), "b": ("no-evidence", "provenance-incomplete"), "c": ("contradict", None), "d": ("no-evidence", None), "e": ("no-evidence", None)}


def test_packet(spark):
    rows = [("g", 1, "x", "p1", "f", False, False), ("g", 2, "y", "p2", "f", True, False), ("g", 3, "x", "p3", "f", True, True), ("g", 4, "y", "p4", "f", True, False), ("g", 5, "x", "p1", "f", False, False), ("h", 1, "x", "p", "a", False, False), ("h", 2, "x", "p", "b", False, False)]
    df = spark.createDataFrame(rows, "g string, rank int, category string, path string, qualname string, anchor boolean, risk boolean")
    got = [(r["g"], r["rank"]) for r in review.evidence_packet(df, ["g"], 4).orderBy("g", "position").collect()]
    assert got == [("g", 3), ("g", 2), ("g", 4), ("g", 1), ("h", 1), ("h", 2)]


def test_inventories_and_dossiers(spark):
    one = spark.createDataFrame([("p", "f", 1), ("p", "f", 9)], "path string, symbol string, line int")
    got = review.weighted_inventories({"command": one, "unresolved-edge": one.limit(1)})
    assert sorted((r["kind"], r["weight"], r["ordinal"]) for r in got.collect()) == [("command", 80, 0), ("command", 80, 1), ("unresolved-edge", 30, 0)]
    df = spark.createDataFrame([("1", "A `b`\nc", "R", "high", "CWE-1", "x.py", 3, "why")], "finding_id string, title string, rule_id string, severity string, cwe string, path string, line int, explanation string")
    assert review.dossiers(df).first()["body"].splitlines()[0] == "# A 'b' c"
