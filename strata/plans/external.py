"""Data sources and transactional sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.plans.catalog import query
from strata.plans.proofs import _folder
from strata.sources import ledger, reports

_GROUPS = "g AS (SELECT *, event_id // 50 AS n, CASE WHEN event_id // 50 % 2 = 0 THEN 'bandit' ELSE 'semgrep' END AS tool, 'r' || event_id // 50 || '.json' AS report FROM events)"
_FINDINGS = """f AS (SELECT tool, report, 'finding' AS status, 'src/' || user_id % 30 || CASE tool WHEN 'bandit' THEN '.py' ELSE '.c' END AS path, CAST(event_id + 1 AS INTEGER) AS line,
 CASE tool WHEN 'bandit' THEN 'BANDIT-B' || (300 + user_id % 9) WHEN 'semgrep' THEN 'cxx.source.' || CASE WHEN user_id % 2 = 0 THEN 'double-free' ELSE 'oob-read' END || '.r' END AS rule_id,
 CASE WHEN tool = 'semgrep' THEN 'high' WHEN event_id % 3 = 0 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN tool = 'semgrep' THEN 0.5::DOUBLE WHEN event_id % 4 = 0 THEN 0.62::DOUBLE ELSE 0.72::DOUBLE END AS confidence,
 CASE WHEN tool = 'semgrep' THEN CASE WHEN user_id % 2 = 0 THEN 'CWE-415' ELSE 'CWE-125' END WHEN user_id % 9 = 7 THEN 'CWE-95' ELSE 'CWE-' || user_id % 9 END AS cwe, NULL AS reason FROM g WHERE n % 7 <> 0 AND (user_id % 9 <> 0 OR tool = 'semgrep')
 UNION ALL SELECT DISTINCT tool, report, 'failed', NULL, NULL, NULL, NULL, NULL, NULL, CASE tool WHEN 'bandit' THEN 'not JSON' ELSE 'semgrep-reported-errors' END FROM g WHERE n % 7 = 0)"""


def _reports(t) -> tuple:
    """A report for every fifty events, in turn of two tools; each seventh is broken, or one of a run with errors."""
    e, u, n = F.col("event_id"), F.col("user_id"), F.floor(F.col("event_id") / 50)
    bandit = F.struct(
        F.concat(F.lit("src/"), (u % 30).cast("string"), F.lit(".py")).alias("filename"), (e + 1).alias("line_number"), F.concat(F.lit("B"), (300 + u % 9).cast("string")).alias("test_id"),
        F.when(e % 3 == 0, "HIGH").alias("issue_severity"), F.when(e % 4 == 0, "low").otherwise("UNDEFINED").alias("issue_confidence"), F.struct((u % 9).alias("id")).alias("issue_cwe"),
    )
    even = u % 2 == 0
    metadata = F.struct(F.when(even, "CWE-415").otherwise("CWE-125").alias("cwe"), F.lit(True).alias("candidate"))
    semgrep = F.struct(
        F.concat(F.lit("cxx.source."), F.when(even, "double-free").otherwise("oob-read"), F.lit(".r")).alias("check_id"), F.concat(F.lit("src/"), (u % 30).cast("string"), F.lit(".c")).alias("path"), F.struct((e + 1).alias("line")).alias("start"),
        F.struct(metadata.alias("metadata"), F.lit("x = y;").alias("lines")).alias("extra"),
    )
    errors = F.when(F.col("n") % 7 == 0, F.array(F.struct(F.lit("Timeout").alias("type"), F.lit("slow").alias("message")))).otherwise(F.array())
    rows = t("events").withColumn("n", n)
    name = F.concat(F.lit("r"), F.col("n").cast("string"), F.lit(".json")).alias("name")
    first = rows.where("n % 2 = 0 and user_id % 9 <> 0").groupBy("n").agg(F.to_json(F.struct(F.collect_list(bandit).alias("results"))).alias("c")).select(name, F.when(F.col("n") % 7 == 0, F.substring("c", 1, 20)).otherwise(F.col("c")).alias("content"))
    second = rows.where("n % 2 = 1").groupBy("n").agg(F.collect_list(semgrep).alias("results")).select(name, F.to_json(F.struct("results", errors.alias("errors"))).alias("content"))
    folder = _folder(rows, "tool-reports")
    ledger.replace_documents(first, f"{folder}/bandit")
    ledger.replace_documents(second, f"{folder}/semgrep")
    return rows.sparkSession, folder


@query(f"WITH {_GROUPS}, {_FINDINGS} SELECT * FROM f")
def tool_reports(t):
    """Findings and failed runs of two analyzers' reports, read by batches of files."""
    return reports.read_reports(*_reports(t)).select("tool", "report", "status", "path", "line", "rule_id", "severity", "confidence", "cwe", "reason")


@query(f"WITH {_GROUPS}, {_FINDINGS} SELECT report, path, line, cwe FROM f WHERE tool = 'semgrep' AND path LIKE 'src/1%'")
def tool_reports_below(t):
    """The findings of one tool below a path, where both filters are the source's."""
    found = reports.read_reports(*_reports(t))
    return found.where((F.col("tool") == "semgrep") & F.startswith("path", F.lit("src/1"))).select("report", "path", "line", "cwe")


@query("""
SELECT row_number() OVER (ORDER BY part, event_id) - 1 AS seq, 'e' || event_id || ' ' || event_type AS event FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS part FROM events)""")
def event_log(t):
    """An event log written in two commits, of which the first is repeated, and read back with its numbers."""
    rows = t("events").select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")).alias("event"))
    folder = _folder(rows, "log")
    ordered = lambda df: df.repartitionByRange("event_id").sortWithinPartitions("event_id")
    for part, transaction in (("event_id % 3 = 0", "first"), ("event_id % 3 = 0", "first"), ("event_id % 3 <> 0", "second")):
        ledger.append_events(ordered(rows.where(part)), folder, transaction)
    return ledger.read_events(rows.sparkSession, folder)


@query("""
SELECT 'k' || o_orderkey AS cache_key, CASE WHEN o_orderkey % 4 = 1 THEN '{"status":"' || o_orderstatus || '"}' WHEN o_orderkey % 4 = 2 THEN '{"again":true}' END AS payload, o_orderkey % 4 IN (1, 2) AS hit FROM orders""")
def cached_results(t):
    """Looked-up results of a cache in which some entries are missing, some broken, and some put anew after they broke."""
    k = F.col("o_orderkey")
    key = F.concat(F.lit("k"), k.cast("string")).alias("cache_key")
    o = t("orders")
    folder = _folder(o, "cache")
    ledger.put_results(o.where(k % 4 == 1).select(key, F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("payload")), folder)
    ledger.append_events(o.where(k % 4 >= 2).select(F.to_json(F.struct(key, F.when(k % 8 < 4, "{broken").otherwise("[1]").alias("payload"))).alias("event")), folder)
    ledger.put_results(o.where(k % 4 == 2).select(key, F.lit('{"again": true}').alias("payload")), folder)
    return ledger.get_results(o.select(key), folder)
