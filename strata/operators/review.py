"""Review of findings: verification decisions, provenance verdicts, packets of evidence, weighted inventories and dossiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions import text as T

# The least confidence that verification accepts, and phrases that make a fix unsafe.
LEAST_CONFIDENCE = 0.55
UNSAFE_FIXES = ("disable validation", "ignore error", "catch all")
# Weights of the kinds of facts that inventories hold.
INVENTORY_WEIGHTS = {"eval": 90, "command": 80, "sql": 80, "path": 70, "deserialization": 70, "entrypoint": 60, "external-source": 50, "trust-boundary": 40, "unresolved-edge": 30}


def verify(findings: DataFrame) -> DataFrame:
    """Findings with adjusted confidence, the reasons against them, and ``approved`` if there is none.

    Findings have confidence, adjustment, accepted, objections, reproducible and fix.
    """
    confidence = T.clamped(F.col("confidence") + F.coalesce("adjustment", F.lit(0.0)))
    safe = (F.coalesce("fix", F.lit("")) != "") & ~T.has_any(F.coalesce("fix", F.lit("")), UNSAFE_FIXES)
    reasons = F.concat(
        F.when(~F.col("accepted"), F.col("objections")).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(~F.col("reproducible"), F.lit("not reproducible")), F.when(~safe, F.lit("fix not ready")), F.when(confidence < LEAST_CONFIDENCE, F.lit("low confidence")),
        )),
    )
    return findings.withColumn("reasons", reasons).withColumn("confidence", confidence).withColumn("approved", F.size("reasons") == 0)


def provenance_verdicts(candidates: DataFrame, evidence: DataFrame, runs: DataFrame, statuses: DataFrame) -> DataFrame:
    """support, contradict or no-evidence for each candidate, with the gap if its evidence names no completed run.

    Evidence: candidate_id, polarity, run_id. Runs: run_id, status. Statuses are obligations (candidate_id, status). Refuting
    evidence contradicts only together with a refuted obligation; supporting evidence counts unless an obligation is refuted.
    """
    done = runs.where("status = 'completed'").select("run_id", F.lit(True).alias("_done")).distinct()
    real = F.coalesce("_done", F.lit(False))
    seen = evidence.join(done, "run_id", "left").groupBy("candidate_id").agg(
        F.bool_or(real).alias("_any"), F.bool_or(real & (F.col("polarity") == "refutes")).alias("_no"), F.bool_or(real & (F.col("polarity") == "supports")).alias("_yes")
    )
    refuted = statuses.groupBy("candidate_id").agg(F.bool_or(F.col("status") == "REFUTED").alias("_refuted"))
    rows = candidates.select("candidate_id").join(seen, "candidate_id", "left").join(refuted, "candidate_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = F.when(flag("_no") & flag("_refuted"), "contradict").when(flag("_yes") & ~flag("_refuted"), "support").otherwise("no-evidence")
    gap = F.when(F.col("_any").isNotNull() & ~flag("_any"), "provenance-incomplete")
    return rows.select("candidate_id", verdict.alias("verdict"), gap.alias("gap"))


def evidence_packet(candidates: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """At most ``most`` candidates of each group: the first risk anchor, a representative of each category, second anchors, then the rest.

    Candidates have rank, category, path, qualname, anchor and risk. Without an anchor in the group the first ones by rank
    are taken. A candidate is listed once, at its earliest stage.
    """
    w = Window.partitionBy(*by)
    first = F.row_number().over(w.orderBy(F.desc("risk"), F.desc("anchor"), "rank"))
    nth = F.row_number().over(Window.partitionBy(*by, "category").orderBy(F.desc("risk"), F.desc("anchor"), "rank"))
    rows = candidates.withColumns({"_first": first, "_nth": nth, "_order": F.min("rank").over(Window.partitionBy(*by, "category")), "_anchors": F.bool_or("anchor").over(w)})
    stage = F.when(~F.col("_anchors"), 3).when(F.col("_first") == 1, 0).when(F.col("_nth") == 1, 1).when(F.col("anchor") & (F.col("_nth") == 2), 2).otherwise(3)
    place = F.when(stage.isin(1, 2), F.col("_order")).otherwise(F.col("rank"))
    once = rows.withColumn("_stage", stage).withColumn("_place", place).withColumn("_copy", F.row_number().over(Window.partitionBy(*by, "path", "qualname").orderBy("_stage", "_place", "rank"))).where("_copy = 1")
    at = F.row_number().over(w.orderBy("_stage", "_place", "rank"))
    return once.withColumn("position", at).where(F.col("position") <= most).select(*candidates.columns, "position")


def weighted_inventories(inventories: dict[str, DataFrame]) -> DataFrame:
    """Inventories (path, symbol, line) by kind as one ranked table: weight, kind, path, symbol, line and an ordinal within (kind, path, symbol)."""
    parts = [df.select(F.lit(kind).alias("kind"), F.lit(INVENTORY_WEIGHTS[kind]).alias("weight"), "path", "symbol", "line") for kind, df in inventories.items()]
    ordinal = F.row_number().over(Window.partitionBy("kind", "path", "symbol").orderBy("line")) - 1
    rows = reduce(DataFrame.unionByName, parts).withColumn("ordinal", ordinal)
    return rows.withColumn("candidate_id", F.substring(F.sha2(F.concat_ws("\x00", "kind", "path", "symbol", F.col("ordinal").cast("string")), 256), 1, 24))


def dossiers(findings: DataFrame) -> DataFrame:
    """(finding_id, body): a Markdown page for each finding, with code marks and line ends of its cells made harmless."""
    def cell(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), "`", "'")

    line = lambda name, c: F.concat(F.lit(f"- {name}: `"), cell(c), F.lit("`"))
    body = F.concat_ws("\n", F.concat(F.lit("# "), cell("title")), F.lit(""), line("Rule", "rule_id"), line("Severity", "severity"), line("Weakness", "cwe"), line("Place", "path"), line("Line", "line"), F.lit(""), cell("explanation"))
    return findings.select("finding_id", body.alias("body"))


def trust_boundaries(entrypoints: DataFrame, sources: DataFrame) -> DataFrame:
    """The distinct paths that have an entry point or an outside source."""
    return entrypoints.select("path").unionByName(sources.select("path")).distinct()
