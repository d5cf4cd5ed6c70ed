"""Merging of findings by key: ordered folds and first-wins or last-wins choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions import text as T

# Ranks of verification states.
VERIFICATION_RANK = {"candidate": 0, "syntax-verified": 1, "corroborated": 2, "tool-corroborated": 2, "dataflow-verified": 3, "build-verified": 3, "fact-verified": 3, "runtime-confirmed": 4, "confirmed": 4}


def _rank(state: F.Column) -> F.Column:
    return F.coalesce(T.literal_map(VERIFICATION_RANK)[state], F.lit(0))


def merge_findings(findings: DataFrame) -> DataFrame:
    """Findings merged by (path, line, weakness or rule) in the order of ``seq``.

    Sources are united; each time a finding brings a new source, confidence becomes the larger one plus 0.03 (0.99 at
    most), its evidence is added and the state is at least corroborated. The best state and severity win; all else is
    the first finding's. The fold runs inside each key over its sorted rows, which a key has few of.
    """
    key = F.coalesce(F.nullif("cwe", F.lit("")), F.col("rule_id")).alias("weakness")
    row = F.struct(
        "seq", "rule_id", "severity", "source", F.col("confidence").cast("double").alias("confidence"), F.coalesce("verification_state", F.lit("unverified")).alias("state"),
        F.coalesce("evidence_kind", F.lit("")).alias("kind"), F.coalesce("evidence", F.lit("")).alias("evidence"),
    )
    groups = findings.select("path", "line", key, row.alias("row")).groupBy("path", "line", "weakness").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    first = F.col("rows")[0]
    start = F.struct(
        F.array_sort(F.array_distinct(F.split(first["source"], r"\+"))).alias("sources"), first["confidence"].alias("confidence"), first["state"].alias("state"), first["kind"].alias("kind"),
        T.severity_rank(first["severity"]).alias("rank"), F.array(first["evidence"]).alias("evidence"),
    )

    def step(a: F.Column, x: F.Column) -> F.Column:
        sources = F.array_sort(F.array_union(a["sources"], F.split(x["source"], r"\+")))
        fresh = F.size(sources) > F.size(a["sources"])
        best = F.when(_rank(x["state"]) > _rank(a["state"]), x["state"]).otherwise(a["state"])
        state = F.when(fresh & (_rank(best) < VERIFICATION_RANK["corroborated"]), "corroborated").otherwise(best)
        kind = F.when(state == "dataflow-verified", "source-to-sink").when(state == "corroborated", "corroborated").otherwise(a["kind"])
        return F.struct(
            sources.alias("sources"), F.when(fresh, F.least(F.lit(0.99), F.greatest(a["confidence"], x["confidence"]) + 0.03)).otherwise(a["confidence"]).alias("confidence"), state.alias("state"), kind.alias("kind"),
            F.greatest(a["rank"], T.severity_rank(x["severity"])).alias("rank"), F.when(fresh, F.array_union(a["evidence"], F.array(x["evidence"]))).otherwise(a["evidence"]).alias("evidence"),
        )

    merged = groups.select("path", "line", "weakness", F.size("rows").cast("long").alias("n_merged"), first["rule_id"].alias("rule_id"), first["seq"].alias("seq"), F.aggregate(F.slice("rows", 2, F.size("rows")), start, step).alias("m"))
    return merged.select(
        "path", "line", "weakness", "rule_id", "seq", "n_merged", F.array_join("m.sources", "+").alias("source"), F.col("m.confidence").alias("confidence"), F.col("m.state").alias("verification_state"),
        F.col("m.kind").alias("evidence_kind"), T.severity_label(F.col("m.rank")).alias("severity"), F.col("m.evidence").alias("evidence_records"),
    )


def merge_native_findings(findings: DataFrame) -> DataFrame:
    """Findings merged by (weakness, path, symbol, line): all evidence united, highest confidence and severity, mode and kind of the best state, no automatic repair."""
    rank = _rank(F.col("verification_state"))
    best = F.struct(rank.alias("r"), (-F.col("seq")).alias("s"))
    return findings.groupBy("cwe", "path", "symbol", "line").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("source", r"\+"))))), "+").alias("source"), F.max("confidence").alias("confidence"),
        F.max_by("verification_state", best).alias("verification_state"), F.max_by("analysis_mode", best).alias("analysis_mode"), F.max_by("evidence_kind", best).alias("evidence_kind"),
        T.severity_label(F.max(T.severity_rank(F.col("severity")))).alias("severity"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"])).alias("evidence_records"),
        F.lit(False).alias("automatic_repair"),
    )


def first_by(df: DataFrame, keys: list[str], *order: F.Column | str) -> DataFrame:
    """The first row of each key in an order. Ties are the caller's to exclude by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def fuse_layers(findings: DataFrame) -> DataFrame:
    """Layered results: the first of each (identity, tool, rule) by layer, then sequence."""
    return first_by(findings, ["identity", "tool", "rule_id"], "layer", "seq")


def compose_reviews(findings: DataFrame, reviewers: DataFrame) -> DataFrame:
    """The last reviewer's finding of each (path, line, rule). Raises at run time if there is none and every reviewer failed."""
    merged = first_by(findings, ["path", "line", "rule_id"], F.desc("seq"))
    state = reviewers.agg(F.bool_and("failed").alias("_all_failed"))
    empty = findings.agg((F.count("*") == 0).alias("_empty"))
    guard = state.join(empty, F.lit(True)).select(F.when(F.col("_all_failed") & F.col("_empty"), F.raise_error(F.lit("all reviewers failed"))).otherwise(F.lit(True)).alias("_ok"))
    return merged.join(F.broadcast(guard), F.lit(True), "right").where("path is not null").drop("_ok")


def arbitrate(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Approved findings only; the most confident of each key, the first of equals."""
    return first_by(findings.where("approved"), keys, F.desc("confidence"), "seq")


def adjudicate(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with the last model verdict for (path, symbol); without one, needs_review."""
    last = verdicts.groupBy("path", "symbol").agg(F.max_by("verdict", "seq").alias("disposition"))
    return findings.join(last, ["path", "symbol"], "left").withColumn("disposition", F.coalesce("disposition", F.lit("needs_review")))


def first_seen(df: DataFrame, value: str, seq: str = "seq") -> DataFrame:
    """Distinct values, each with the place where it was first seen; ordering by it restores first-seen order."""
    return df.groupBy(value).agg(F.min(seq).alias(seq))
