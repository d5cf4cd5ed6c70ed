"""Reports over empty tables, secrets in odd payloads, failing functions and bundles without records."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strata.operators import attempts, bundles, metrics, privacy
from strata.plans.reports import _cases, _findings


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "v string").select(column(F.col("v")).alias("out")).first().out


def test_no_secret_leaves_a_payload(spark):
    redact = lambda c: privacy.redacted_json(c, "t", b"k")
    assert one(spark, None, redact) is None and one(spark, "{broken", redact) is None and one(spark, "[" * 100_000, redact) is None
    assert one(spark, '{"password": 1.5}', redact) is None
    assert one(spark, '{"a": 1.5, "e\\u0301": "e\\u0301"}', redact) == '{"a":1.5,"é":"é"}'
    out = json.loads(one(spark, '{"Key": null, "b": true, "c": "-----BEGIN RSA PRIVATE KEY-----"}', redact))
    assert out["Key"]["value_kind"] == "null" and out["Key"]["length"] == 4 and out["b"] is True and out["c"]["value_kind"] == "string"


def test_tenants_sign_differently(spark):
    a, b = (json.loads(one(spark, '{"token": "x"}', lambda c, t=t: privacy.redacted_json(c, t, b"k")))["token"]["fingerprint"] for t in ("t1", "t2"))
    assert a != b and len(a) == 32


def test_progress_without_fields(spark):
    for text in (None, "", "null", " { } ", '{"stage": '):
        assert one(spark, text, privacy.progress_summary) is None
    assert one(spark, '{"x": 1}', privacy.progress_summary).asDict() == dict.fromkeys(["stage", "stage_index", "stage_total", "message", "attempt", "max_attempts", "current", "total", "unit"])
    assert one(spark, '{"message": "api_key: abc, the token count"}', privacy.sanitized_progress) == '{"message":"[redacted] the token count"}'


def test_a_failing_row_stops_no_other(spark):
    rows = spark.createDataFrame([(3, "c"), (1, None), (2, "b")], "k int, v string")
    good, bad = attempts.results_and_failures(attempts.attempted(rows, lambda v: v.upper(), "v", "string"), ["k"])
    assert [(r.k, r.result) for r in good.collect()] == [(2, "B"), (3, "C")]
    assert [(r.k, r.failure.split(":")[0]) for r in bad.collect()] == [(1, "AttributeError")]
    assert attempts.attempted(rows.limit(0), len, "v", "long").collect() == []


def test_report_of_no_cases(spark, sf_dir):
    empty = _cases(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0))
    assert set(metrics.evaluation_report(empty).first()) == {0}
    assert metrics.failure_categories(empty).collect() == []


def test_report_by_mode(spark, sf_dir):
    cases = _cases(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    local, wide = metrics.evaluation_report(cases, "llm").first(), metrics.evaluation_report(cases, "llm-retrieval").first()
    assert local.llm_localized_paired_rate == local.llm_paired_rate > 0 and local.hybrid_non_clear_rate == 0
    assert wide.llm_localized_paired_rate == 0 and wide.hybrid_non_clear_rate > 0


def test_bundles_of_null_and_empty_records(spark, sf_dir):
    rows = _findings(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")).limit(5)
    for records in (F.lit(None).cast(rows.schema["evidence_records"].dataType), F.filter("evidence_records", lambda r: F.lit(False))):
        made = bundles.to_bundles(rows.withColumn("evidence_records", records))
        assert [len(r.evidence) for r in made.collect()] == [1] * 5 and bundles.to_findings(made).count() == 0


def test_a_function_runs_once_a_row(spark):
    from strata.operators import attempts

    calls = spark.sparkContext.accumulator(0)

    def halved(v):
        calls.add(1)
        return 10 // (v % 5)

    rows = spark.range(100).repartition(3)
    good, bad = attempts.results_and_failures(attempts.attempted(rows, halved, "id", "long"), ["id"])
    assert [r["id"] for r in bad.collect()] == list(range(0, 100, 5)) and good.count() == 80 and good.unionByName(bad.withColumn("result", bad["id"]).drop("failure")).count() == 100
    assert calls.value == 100


def test_ranks_over_many_values(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 500, "a").when(F.col("id") < 1999, "b").otherwise("c").alias("g"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 601) / 8).alias("v"))
    plain = rows.where("v is not null").groupBy("g")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: (round(r.mean, 9), r.at) for r in metrics.nearest_ranks(rows, "g", "v", p, parts=3, few=2).collect()}
        assert got == {r.g: (round(r.m, 9), r.at) for r in plain.agg(F.avg("v").alias("m"), metrics.nearest_rank("v", p).alias("at")).collect()} and len(got) == 3
    assert metrics.nearest_ranks(rows.limit(0), "g", "v", 0.5).collect() == []


def test_report_holds_no_values_in_a_buffer(spark, sf_dir):
    report = metrics.evaluation_report(_cases(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))
    assert "percentile" not in report._jdf.queryExecution().optimizedPlan().toString().lower()
