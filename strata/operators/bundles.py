"""Findings as bundles of signals, issues and evidence records, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.digests import joined_digest

# Marks of what a plain finding can't state.
MIGRATED, UNSTATED = "LEGACY_MIGRATED", "legacy-finding"


def _place(path: Column, line: Column) -> Column:
    return F.struct(path.alias("path"), line.alias("start_line"), line.alias("end_line"))


def to_bundles(findings: DataFrame) -> DataFrame:
    """One row per finding: structs ``signal`` and ``issue``, and the array ``evidence``.

    Findings: rule_id, path, line, evidence, evidence_kind, source, cwe, evidence_records (array of path, line, snippet). The finding's
    own evidence supports its signal, the records its issue. Ids come from the digest of rule, path, line and evidence, so equal
    findings give equal bundles. Null or empty records give an issue without evidence, an empty weakness an empty list.
    """
    digest = joined_digest(F.col("rule_id"), F.col("path"), F.col("line"), F.col("evidence"))
    rows = findings.withColumn("_digest", digest).withColumn("_prefix", F.substring("_digest", 1, 12))
    signal_id, issue_id = F.concat(F.lit("sig-"), "_prefix"), F.concat(F.lit("issue-"), "_prefix")

    def record(i: Column, subject_kind: str, subject: Column, summary: Column, place: Column) -> Column:
        nth = F.lpad(i.cast("string"), 3, "0")
        return F.struct(
            F.concat(F.lit("ev-"), "_prefix", F.lit("-"), nth).alias("evidence_id"), F.lit(subject_kind).alias("subject_kind"), subject.alias("subject_id"), F.lit("D0").alias("level"), F.lit("SUPPORTS").alias("polarity"),
            F.col("source").alias("analysis_family"), F.concat("rule_id", F.lit(":"), nth).alias("independence_key"), summary.alias("summary"), place.alias("location"),
        )

    first = record(F.lit(0), "SIGNAL", signal_id, F.col("evidence"), _place(F.col("path"), F.col("line")))
    more = F.transform("evidence_records", lambda r, i: record(i + 1, "SECURITY_ISSUE", issue_id, r["snippet"], _place(r["path"], r["line"])))
    rows = rows.withColumn("_records", F.when(F.size("evidence_records") > 0, F.concat(F.array(first), more)).otherwise(F.array(first)))
    ids = F.transform(F.filter("_records", lambda r: r["subject_kind"] == "SECURITY_ISSUE"), lambda r: r["evidence_id"])
    return rows.select(
        F.struct(signal_id.alias("signal_id"), F.col("_digest").alias("fingerprint"), "rule_id", F.col("source").alias("analysis_family"), "evidence_kind", _place(F.col("path"), F.col("line")).alias("location")).alias("signal"),
        F.struct(
            issue_id.alias("issue_id"), F.col("_digest").alias("identity_digest"), F.lit(UNSTATED).alias("root_cause_class"), F.lit(UNSTATED).alias("sink_identity"), F.lit(UNSTATED).alias("trust_boundary"),
            _place(F.col("path"), F.col("line")).alias("primary_location"), F.array(signal_id).alias("signal_ids"), ids.alias("evidence_ids"), F.array(F.lit(MIGRATED)).alias("reason_codes"),
            F.when(F.col("cwe") != "", F.array("cwe")).otherwise(F.array().cast("array<string>")).alias("cwe_ids"),
        ).alias("issue"),
        F.col("_records").alias("evidence"),
    )


def to_findings(bundles: DataFrame) -> DataFrame:
    """Findings of bundles whose issue has evidence of its own; the others have no finding and are left out, as they can't be stated."""
    own = F.filter("evidence", lambda r: (r["subject_kind"] == "SECURITY_ISSUE") & (r["subject_id"] == F.col("issue.issue_id")))
    rows = bundles.withColumn("_own", own).where((F.size("_own") > 0) & F.array_contains("issue.signal_ids", F.col("signal.signal_id")))
    return rows.select(
        F.col("signal.rule_id").alias("rule_id"), F.lit("low").alias("severity"), F.concat(F.lit("migrated:"), "issue.issue_id").alias("title"), F.array_join("issue.reason_codes", "; ").alias("explanation"),
        F.col("issue.primary_location.path").alias("path"), F.col("issue.primary_location.start_line").alias("line"), F.get("_own", F.lit(0))["summary"].alias("evidence"), F.lit("unmapped:fix").alias("fix"), F.lit("unmapped:test").alias("test"),
        F.coalesce(F.array_min("issue.cwe_ids"), F.lit("")).alias("cwe"), F.lit("legacy-adapter").alias("source"), F.col("signal.evidence_kind").alias("evidence_kind"), F.substring("issue.identity_digest", 1, 24).alias("fingerprint"),
    )
