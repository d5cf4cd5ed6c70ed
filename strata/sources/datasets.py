"""Readers with fixed schemas: evaluation cases, paired manifests, analyzer reports, fact bundles, manifests, and an index of known issues."""

from __future__ import annotations

import configparser
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "STRUCT<path: STRING, start_line: INT, end_line: INT, cwe: STRING, severity: STRING>"
CASES = f"id STRING, repository STRING, pull_request BIGINT, split STRING, diff STRING, source STRUCT<kind: STRING>, expected_findings ARRAY<{FINDING}>"
PAIRS = (
    "id STRING, cve STRING, ghsa STRING, cwe STRING, repository STRING, vulnerable_commit STRING, fixed_commit STRING, vulnerable_archive_sha256 STRING, fixed_archive_sha256 STRING, "
    "ground_truth_paths ARRAY<STRING>, ground_truth_symbols ARRAY<STRING>, expected_repair_policy STRING, oracle STRUCT<kind: STRING, tests: ARRAY<STRING>, automated: BOOLEAN, reason: STRING>, sources ARRAY<STRING>"
)
FACTS = (
    "fact_id STRING, kind STRING, snapshot_hash STRING, build_context_hash STRING, translation_unit STRING, canonical_path STRING, function_usr STRING, source_range STRUCT<start: INT, end: INT>, cfg_block INT, "
    "object_id STRING, pointer_id STRING, related_fact_ids ARRAY<STRING>, api STRING, source_pointer_id STRING"
)
ISSUES = "cve_id STRING, component STRING, affected_paths ARRAY<STRING>, introduced_commit STRING, fixed_commit STRING, summary STRING"
# Kinds of facts.
FACT_KINDS = ("allocation", "points-to", "alias-copy", "release", "dereference", "member-access", "rebind", "lifetime-restart", "cfg-node", "cfg-edge", "coverage-gap")
BANDIT = "results ARRAY<STRUCT<filename: STRING, line_number: INT, test_id: STRING, issue_text: STRING, issue_severity: STRING, issue_confidence: STRING, code: STRING, issue_cwe: STRUCT<id: INT>>>"
SEMGREP = "results ARRAY<STRUCT<check_id: STRING, path: STRING, start: STRUCT<line: INT>, `end`: STRUCT<line: INT>, extra: STRUCT<message: STRING, severity: STRING, lines: STRING, metadata: STRUCT<cwe: STRING>>>>"


def _checked(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """``df``, which raises when it runs if ``bad`` has a row."""
    guard = bad.agg((F.count("*") > 0).alias("_bad")).select(F.when(F.col("_bad"), F.raise_error(F.lit(message))).otherwise(F.lit(True)).alias("_ok"))
    return df.join(F.broadcast(guard), F.lit(True)).where("_ok").drop("_ok")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; blank lines are skipped, a repeated id or another split than the two known ones raises."""
    df = spark.read.schema(CASES).option("mode", "FAILFAST").json(path).where("id is not null")
    repeated = df.groupBy("id").count().where("count > 1").select("id")
    wrong = df.where(~F.coalesce(F.col("split").isin("validation", "holdout"), F.lit(False))).select("id")
    return _checked(df, repeated.unionByName(wrong), "invalid evaluation cases")


def read_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Paired manifests, one a file or one a line; needs distinct commits, 64-digit archive digests, ground-truth paths and unique ids."""
    df = spark.read.schema(PAIRS).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    digest = F.col("vulnerable_archive_sha256").rlike("^[0-9a-f]{64}$") & F.col("fixed_archive_sha256").rlike("^[0-9a-f]{64}$")
    good = (F.col("vulnerable_commit") != F.col("fixed_commit")) & digest & (F.size("ground_truth_paths") > 0) & F.col("cwe").rlike(r"^CWE-\d+$")
    wrong = df.where(~F.coalesce(good, F.lit(False))).select("id").unionByName(df.groupBy("id").count().where("count > 1").select("id"))
    return _checked(df, wrong, "invalid paired manifest")


def read_bandit(spark: SparkSession, path: str) -> DataFrame:
    """Findings of report files, one report a file: path, line, rule_id, severity, confidence, cwe, evidence."""
    return _bandit(spark.read.schema(BANDIT).option("multiLine", "true").json(path))


def read_bandit_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with a report on each line, which Spark can split."""
    return _bandit(spark.read.schema(BANDIT).json(path))


def _bandit(reports: DataFrame) -> DataFrame:
    rows = reports.select(F.explode("results").alias("r"))
    confidence = F.element_at(F.create_map(F.lit("HIGH"), F.lit(0.9), F.lit("MEDIUM"), F.lit(0.78), F.lit("LOW"), F.lit(0.62)), F.upper(F.coalesce("r.issue_confidence", F.lit("MEDIUM"))))
    return rows.select(
        F.col("r.filename").alias("path"), F.col("r.line_number").alias("line"), F.col("r.test_id").alias("rule_id"), F.lower("r.issue_severity").alias("severity"), F.coalesce(confidence, F.lit(0.72)).alias("confidence"),
        F.when(F.col("r.issue_cwe.id").isNotNull(), F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id").cast("string"))).alias("cwe"), F.col("r.code").alias("evidence"),
    )


def read_semgrep(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SEMGREP).option("multiLine", "true").json(path).select(F.explode("results").alias("r"))
    severity = F.coalesce(F.element_at(F.create_map(F.lit("ERROR"), F.lit("high"), F.lit("WARNING"), F.lit("medium"), F.lit("INFO"), F.lit("low")), F.upper("r.extra.severity")), F.lit("medium"))
    return rows.select(
        F.col("r.path").alias("path"), F.col("r.start.line").alias("line"), F.col("r.end.line").alias("end_line"), F.col("r.check_id").alias("rule_id"), severity.alias("severity"),
        F.regexp_extract(F.coalesce("r.extra.metadata.cwe", F.lit("")), r"CWE-\d+", 0).alias("cwe"), F.col("r.extra.lines").alias("evidence"),
    )


def read_facts(spark: SparkSession, path: str, most: int = 1_000_000) -> DataFrame:
    """Facts of a bundle; ids must be unique 64-digit digests of known kinds, related ids must exist, and there are at most ``most``.

    Where the facts lie in folders by ``bundle``, all this holds for each bundle by itself.
    """
    return checked_facts(spark.read.schema(FACTS).option("mode", "FAILFAST").json(path), most)


def checked_facts(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    bundle = ["bundle"] if "bundle" in df.columns else []
    repeated = df.groupBy(*bundle, "fact_id").count().where("count > 1").select("fact_id")
    wrong = df.where(~F.coalesce(F.col("fact_id").rlike("^[0-9a-f]{64}$") & F.col("kind").isin(*FACT_KINDS), F.lit(False))).select("fact_id")
    related = df.select(*bundle, F.explode("related_fact_ids").alias("fact_id")).distinct().join(df.select(*bundle, "fact_id"), [*bundle, "fact_id"], "left_anti").select("fact_id")
    over = df.groupBy(*bundle).agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit("budget").alias("fact_id"))
    return _checked(df, repeated.unionByName(wrong).unionByName(related).unionByName(over), "invalid fact bundle")


def read_issue_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Index rows, a list a file or one a line; an empty commit means unknown. Other fields than the six known ones, and an entry stated twice, raise."""
    raw = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    known = {c.split()[0] for c in ISSUES.split(", ")}
    if raw.columns and set(raw.columns) != known:
        raise ValueError(f"an index entry has the fields {sorted(known)}")
    df = spark.read.schema(ISSUES).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return _checked(df, df.groupBy("cve_id", "component").count().where("count > 1").select("cve_id"), "an index entry is stated twice")


def _manifest(path: str, text: str) -> list[tuple[str, str, str]]:
    """(ecosystem, name, requirement) declared by a manifest; a broken one declares nothing."""
    name = path.rsplit("/", 1)[-1]
    try:
        if name == "package.json":
            data = json.loads(text)
            return [("npm", k, str(v)) for part in ("dependencies", "devDependencies") for k, v in (data.get(part) or {}).items()]
        if name == "Cargo.toml":
            return [("cargo", k, v if isinstance(v, str) else str(v.get("version", ""))) for k, v in (tomllib.loads(text).get("dependencies") or {}).items()]
        if name == "pyproject.toml":
            wanted = (tomllib.loads(text).get("project") or {}).get("dependencies") or []
        elif name == "setup.cfg":
            parser = configparser.ConfigParser()
            parser.read_string(text)
            wanted = [x.strip() for x in parser.get("options", "install_requires", fallback="").splitlines() if x.strip()]
        else:
            return []
        split = [(w, next((i for i, c in enumerate(w) if not (c.isalnum() or c in "._-[]")), len(w))) for w in wanted]
        return [("pypi", w[:i].strip(), w[i:].strip()) for w, i in split]
    except (ValueError, AttributeError, configparser.Error):
        return []


def manifests(files: DataFrame) -> DataFrame:
    """(path, ecosystem, name, requirement) from manifests at most one folder deep. Files have path and text; other files never reach Python."""
    able = files.where(F.col("path").rlike(r"^([^/]+/)?(pyproject\.toml|setup\.cfg|package\.json|Cargo\.toml)$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *row) for p, t in zip(b["path"], b["text"]) for row in _manifest(p, t or "")], columns=["path", "ecosystem", "name", "requirement"])

    return able.select("path", "text").mapInPandas(run, "path string, ecosystem string, name string, requirement string")
