"""Analyzer reports read as a data source."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strata.sources import datasets, reports


def semgrep(**change):
    extra = {"metadata": {"cwe": "CWE-416", "candidate": True}, "lines": "free(p);", "message": "m", "metavars": {"$FUNC": {"abstract_content": " f "}}} | change.pop("extra", {})
    return {"check_id": "cxx.source.use-after-free.x", "path": "src/a.c", "start": {"line": 3}, "extra": extra} | change


def test_both_forms(spark, tmp_path):
    bandit = [
        {"filename": "/w/src/a.py", "line_number": 0, "test_id": "B307", "issue_severity": "low", "issue_confidence": "HIGH", "issue_cwe": {"id": 78}, "issue_text": "t" * 200, "code": " a \n  b "},
        {"filename": "src/b.py", "test_id": "B1", "issue_severity": "odd", "issue_confidence": "UNDEFINED", "issue_cwe": {"id": 22}}, {"filename": "/elsewhere/c.py"}, {"filename": "../d.py"},
    ]
    texts = {
        "bandit/1.json": json.dumps({"results": bandit}), "bandit/2.json": "{", "bandit/3.json": "", "bandit/4.json": "[1]", "semgrep/1.json": json.dumps({"results": [semgrep(), semgrep(path="lib/b.HPP", check_id="cxx.source.use-after-free")], "errors": []}),
        "semgrep/2.json": json.dumps({"results": [semgrep()], "errors": [{"type": ["PartialParsing", []], "message": "m"}]}), "semgrep/3.json": json.dumps({"results": [], "errors": [{"type": "x", "message": "m"}] * 65}), "semgrep/4.json": json.dumps({"results": []}), "other/1.json": "{}",
    }
    bad = [semgrep(path="../a.c"), semgrep(path="a.py"), semgrep(start={"line": True}), semgrep(check_id="cxx.source.double-free"), semgrep(extra={"lines": "requires login"}), semgrep(extra={"metadata": {"cwe": "CWE-416"}}), 7]
    texts |= {f"semgrep/bad{i}.json": json.dumps({"results": [semgrep(), b], "errors": []}) for i, b in enumerate(bad)}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = reports.read_reports(spark, str(tmp_path), "/w").collect()
    found = {tuple(r[n] for n in ("tool", "report", "path", "line", "rule_id", "severity", "confidence", "cwe", "evidence", "symbol")) for r in rows if r["status"] == "finding"}
    assert found == {
        ("bandit", "1.json", "src/a.py", 1, "BANDIT-B307", "low", 0.9, "CWE-95", "a b", None), ("bandit", "1.json", "src/b.py", 1, "BANDIT-B1", "medium", 0.72, "CWE-22", "", None),
        ("semgrep", "1.json", "src/a.c", 3, "cxx.source.use-after-free.x", "high", 0.5, "CWE-416", "free(p);", "f"), ("semgrep", "1.json", "lib/b.HPP", 3, "cxx.source.use-after-free", "high", 0.5, "CWE-416", "free(p);", "f"),
    }
    failed = {(r["tool"], r["report"]): r["reason"] for r in rows if r["status"] == "failed"}
    assert set(failed) == {("bandit", "2.json"), ("bandit", "4.json"), *[("semgrep", f"{n}.json") for n in (2, 3, 4)], *[("semgrep", f"bad{i}.json") for i in range(len(bad))]}
    assert failed["semgrep", "2.json"] == "semgrep-reported-errors" and failed["semgrep", "3.json"] == "semgrep-error-limit-exceeded:65" and failed["bandit", "2.json"] == "not JSON"


def test_batches_and_pushed_filters(spark, tmp_path):
    for tool in ("bandit", "semgrep"):
        (tmp_path / tool).mkdir()
        for i in range(230):
            (tmp_path / tool / f"{i:03}.json").write_text(json.dumps({"results": [{"filename": f"d{i % 3}/x.py"}] if tool == "bandit" else [semgrep(path=f"d{i % 3}/x.c")], "errors": []}))
    every = reports.read_reports(spark, str(tmp_path))
    assert every.rdd.getNumPartitions() == 6 and every.count() == 460
    some = every.where((F.col("tool") == "bandit") & F.startswith("path", F.lit("d1/")))
    assert some.rdd.getNumPartitions() == 3 and some.count() == 77
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(tool" in plan and "StartsWith" not in plan and "= bandit" not in plan  # both are left to the source
    assert every.where("tool in ('semgrep', 'none') and path like 'd2/%'").count() == 76
    assert every.where("tool = 'none'").count() == 0


def test_fact_budget_of_each_bundle(spark, tmp_path):
    rows = spark.range(6).select((F.col("id") % 3).alias("bundle"), F.sha2(F.col("id").cast("string"), 256).alias("fact_id"), F.lit("allocation").alias("kind"), F.array().cast("array<string>").alias("related_fact_ids"))
    rows.write.partitionBy("bundle").json(f"{tmp_path}/facts")
    assert datasets.read_facts(spark, f"{tmp_path}/facts", most=2).count() == 6
    with pytest.raises(Exception, match="invalid fact bundle"):
        datasets.read_facts(spark, f"{tmp_path}/facts", most=1).collect()
    rows.where("bundle = 0").withColumn("bundle", F.lit(1)).write.mode("append").partitionBy("bundle").json(f"{tmp_path}/facts")
    assert datasets.read_facts(spark, f"{tmp_path}/facts", most=4).count() == 8  # one id in two bundles is no repeat
    other = rows.where("bundle = 0").select(F.lit(2).alias("bundle"), F.sha2(F.concat(F.lit("x"), "fact_id"), 256).alias("fact_id"), "kind", F.array("fact_id").alias("related_fact_ids"))
    other.write.mode("append").partitionBy("bundle").json(f"{tmp_path}/facts")
    with pytest.raises(Exception, match="invalid fact bundle"):  # the named facts lie in other bundles
        datasets.read_facts(spark, f"{tmp_path}/facts").collect()
