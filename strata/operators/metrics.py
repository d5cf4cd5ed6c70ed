"""Scores of predictions against truths, rates with their own denominators, percentiles and gates."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.functions.digests import basis_points, rounded

TOTALS = ["cases", "risk_cases", "clean_cases", "tp", "fp", "fn", "severity_hits", "high_total", "high_hits", "clean_hits", "execution_successes", "repair_attempted", "repair_passed", "e2e_successes"]


def ratio(part: Column, whole: Column, empty: float | None) -> Column:
    """part / whole, or ``empty`` (null if None) for a zero denominator."""
    out = part / F.nullif(whole.cast("double"), F.lit(0.0))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def one_to_one(edges: DataFrame) -> DataFrame:
    """Maximum matchings of truths e with predictions p inside each case, from edges (case_id, e, p, distance).

    Truths with the fewest edges are placed first, each at its nearest prediction; one already taken moves on along an
    augmenting path. A case is one review, so its edges are few.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        near = {e: list(zip(g["p"], g["distance"])) for e, g in rows.sort_values(["distance", "p"]).groupby("e")}
        owner: dict[int, int] = {}
        for start in sorted(near, key=lambda e: (len(near[e]), e)):
            # Depth-first along alternating paths, with an explicit stack of (truth, its next edge).
            tried: set[int] = set()
            stack, path = [(start, 0)], []
            while stack:
                e, k = stack.pop()
                if k >= len(near[e]):
                    if path:
                        path.pop()
                    continue
                stack.append((e, k + 1))
                p = near[e][k][0]
                if p in tried:
                    continue
                tried.add(p)
                path.append((e, p))
                if p not in owner:
                    for truth, prediction in path:
                        owner[prediction] = truth
                    break
                stack.append((owner[p], 0))
        out = [(key[0], e, p, dict(near[e])[p]) for p, e in owner.items()]
        return pd.DataFrame(out, columns=["case_id", "e", "p", "distance"])

    schema = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("case_id", "e", "p", "distance"))
    return edges.groupBy("case_id").applyInPandas(run, schema)


def greedy_match(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exact matches, truth by truth in order: same path and line (and rule, if given); the severest free prediction, then the least rule id.

    Expected: case_id, e, path, line, rule_id, min_severity. Predicted: case_id, path, line, rule_id, severity, unique by the first four.
    """
    rank = lambda c: F.coalesce(T.severity_rank(F.col(c)), F.lit(0))
    left = expected.select("case_id", "e", "path", "line", F.coalesce("rule_id", F.lit("")).alias("want"), rank("min_severity").alias("least"))
    right = predicted.select("case_id", "path", "line", "rule_id", rank("severity").alias("rank")).distinct()
    keys = ["case_id", "path", "line"]
    truths = left.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("e", "want", "least"))).alias("truths"))
    found = right.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("neg"), "rule_id"))).alias("free"))
    e_type = left.schema["e"].dataType.simpleString()
    start = F.struct(F.col("free").alias("free"), F.array().cast(f"array<struct<e:{e_type},rule_id:string,severity_ok:boolean,high:boolean>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        able = F.filter(a["free"], lambda f: (t["want"] == "") | (f["rule_id"] == t["want"]))
        best = F.get(able, F.lit(0))
        taken = F.struct(t["e"].alias("e"), best["rule_id"].alias("rule_id"), (-best["neg"] >= t["least"]).alias("severity_ok"), (t["least"] >= 2).alias("high"))
        return F.struct(
            F.when(best.isNull(), a["free"]).otherwise(F.filter(a["free"], lambda f: f["rule_id"] != best["rule_id"])).alias("free"),
            F.when(best.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(taken))).alias("out"),
        )

    # A place has few truths and predictions; the fold runs in the JVM over their sorted arrays.
    return truths.join(found, keys).select(*keys, F.inline(F.aggregate("truths", start, step)["out"])).select("case_id", "e", "path", "line", "rule_id", "severity_ok", "high")


def totals(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Additive counters over case results (expected, tp, fp, fn, ..., clean_hit, execution_success, e2e_success)."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    same = {c: n(c) for c in ("tp", "fp", "fn", "severity_hits", "high_total", "high_hits", "repair_attempted", "repair_passed")}
    values = {
        "cases": F.count("expected"), "risk_cases": F.count_if(F.col("expected") > 0), "clean_cases": F.count_if(F.col("expected") == 0), **same,
        "clean_hits": n("clean_hit"), "execution_successes": n("execution_success"), "e2e_successes": n("e2e_success"),
    }
    return results.groupBy(*(by or [])).agg(*[values[c].alias(c) for c in TOTALS])


def metrics(counted: DataFrame, exact: bool = True) -> DataFrame:
    """Metrics of totals. With ``exact`` false, rates are rounded to four digits as Python does and F1 follows from rounded precision and recall."""
    c = F.col
    view = (lambda x: x) if exact else (lambda x: rounded(x, 4))
    rates = {
        "precision": ratio(c("tp"), c("tp") + c("fp"), 0.0), "recall": ratio(c("tp"), c("tp") + c("fn"), 1.0), "severity_accuracy": ratio(c("severity_hits"), c("tp"), 1.0),
        "high_risk_recall": ratio(c("high_hits"), c("high_total"), 1.0), "clean_accuracy": ratio(c("clean_hits"), c("clean_cases"), 1.0), "execution_success_rate": ratio(c("execution_successes"), c("cases"), 0.0),
        "safe_fix_rate": ratio(c("repair_passed"), c("repair_attempted"), 0.0), "e2e_security_fix_rate": ratio(c("e2e_successes"), c("risk_cases"), 0.0),
    }
    out = counted.withColumns({k: view(v) for k, v in rates.items()})
    return out.withColumn("f1", view(F.coalesce(2 * c("precision") * c("recall") / F.nullif(c("precision") + c("recall"), F.lit(0.0)), F.lit(0.0))))


def metrics_by_split(results: DataFrame, splits: DataFrame) -> DataFrame:
    """Metrics for every split of a dimension (column ``split``), also those without a case."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in TOTALS}
    return metrics(splits.join(totals(results, ["split"]), "split", "left").withColumns(zero))


def replay_metrics(results: DataFrame) -> DataFrame:
    """Scores of a replay from (expected, tp, fp, predicted, severity_ok, high_total, high_hits, failed): F1 from unrounded rates, weighted score times success rate."""
    good = ~F.col("failed")
    s = lambda x: F.coalesce(F.sum(x), F.lit(0))
    t = results.agg(
        F.count("*").alias("cases"), s(F.when(good, F.col("tp")).otherwise(0)).alias("tp"), s(F.when(good, F.col("fp")).otherwise(0)).alias("fp"),
        s(F.when(good, F.col("expected") - F.col("tp")).otherwise(F.col("expected"))).alias("fn"), s(F.when(good, F.col("severity_ok")).otherwise(0)).alias("hits"), s("high_total").alias("high_total"),
        s(F.when(good, F.col("high_hits")).otherwise(0)).alias("high_hits"), s("expected").alias("expected_total"), F.count_if(F.col("expected") == 0).alias("clean_total"),
        F.count_if(good & (F.col("expected") == 0) & (F.col("predicted") == 0)).alias("clean_hits"), F.count_if(good).alias("successes"),
    )
    c = F.col
    p = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).when(c("tp") + c("fn") == 0, 1.0).otherwise(0.0)
    t = t.withColumns({"precision": p, "recall": ratio(c("tp"), c("tp") + c("fn"), 1.0)})
    t = t.withColumns({
        "f1": F.coalesce(2 * c("precision") * c("recall") / F.nullif(c("precision") + c("recall"), F.lit(0.0)), F.lit(0.0)),
        "severity_accuracy": F.when(c("tp") > 0, c("hits") / c("tp")).when(c("fn") == 0, 1.0).otherwise(0.0), "clean_accuracy": ratio(c("clean_hits"), c("clean_total"), 1.0),
        "high_severity_recall": ratio(c("high_hits"), c("high_total"), 1.0), "success_rate": ratio(c("successes"), c("cases"), 0.0),
    })
    risky, clean = (c("expected_total") > 0).cast("int"), (c("clean_total") > 0).cast("int")
    weighted = risky * (c("f1") * 0.65 + c("severity_accuracy") * 0.15) + clean * c("clean_accuracy") * 0.20
    return t.withColumn("score", F.coalesce(weighted / F.nullif(risky * 0.80 + clean * 0.20, F.lit(0.0)), F.lit(0.0)) * c("success_rate"))


def paired(results: DataFrame) -> DataFrame:
    """Per case: was the vulnerable revision found, was the fixed one clean, and both. Results: case_id, revision, found."""
    hit = F.coalesce(F.bool_or(F.when(F.col("revision") == "vulnerable", F.col("found"))), F.lit(False))
    noise = F.coalesce(F.bool_or(F.when(F.col("revision") == "fixed", F.col("found"))), F.lit(False))
    out = results.groupBy("case_id").agg(hit.alias("hit"), (~noise).alias("clean"))
    return out.withColumn("discriminated", F.col("hit") & F.col("clean"))


def scan_quality(results: DataFrame) -> DataFrame:
    """Confusion over revisions with nulls for empty denominators, and false positives per thousand fixed lines. Results: revision, found, source_lines, completed."""
    vulnerable, fixed = F.col("revision") == "vulnerable", F.col("revision") == "fixed"
    t = results.agg(
        F.count_if(vulnerable & F.col("found")).alias("tp"), F.count_if(vulnerable & ~F.col("found")).alias("fn"), F.count_if(fixed & F.col("found")).alias("fp"), F.count_if(fixed & ~F.col("found")).alias("tn"),
        F.coalesce(F.sum(F.when(fixed, F.col("source_lines"))), F.lit(0)).alias("fixed_lines"), F.count_if(F.col("completed")).alias("completed"), F.count("*").alias("revisions"),
    )
    c = F.col
    t = t.withColumns({
        "recall": ratio(c("tp"), c("tp") + c("fn"), None), "precision": ratio(c("tp"), c("tp") + c("fp"), None), "fp_per_kloc": ratio(c("fp") * 1000.0, c("fixed_lines"), None), "coverage": ratio(c("completed"), c("revisions"), None)
    })
    return t.withColumn("diagnostics", F.array_compact(F.array(*[F.when(c(x).isNull(), F.lit(f"{x}-denominator-zero")) for x in ("recall", "precision", "fp_per_kloc", "coverage")])))


def nearest_rank(value: str, p: float) -> Column:
    """The value of rank ceil(n * p), never interpolated; null without values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def nearest_ranks(df: DataFrame, by: str, value: str, p: float, parts: int = 4096, few: int = 100_000) -> DataFrame:
    """(by, mean, at) of few groups of any size: a group's mean, and its value of rank ceil(n * p).

    ``nearest_rank`` holds a group's distinct values in one task, and each task before it all that it meets. Here the values between
    two bounds are counted in equal ranges, and the range that has the rank gives the next bounds, until ``few`` values are left.
    """
    v, rows = F.col(value), df.select(by, value).where(F.col(value).isNotNull())
    groups = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
    rank = {g[by]: max(1, math.ceil(g.n * p)) for g in groups}
    left = {g[by]: (g.lo, g.hi, g.n) for g in groups}
    inside = lambda g: (F.col(by) == g) & v.between(*left[g][:2])
    while wide := [g for g, (lo, hi, n) in left.items() if n > few and lo < hi and math.isfinite(hi - lo)]:
        part = F.coalesce(*[F.when(inside(g), F.least(F.floor((v - left[g][0]) / (left[g][1] - left[g][0]) * parts), F.lit(parts - 1))) for g in wide])
        counts = rows.withColumn("_part", part).where("_part is not null").groupBy(by, "_part").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for g in wide:
            for c in sorted((c for c in counts if c[by] == g), key=lambda c: c["_part"]):
                if rank[g] <= c.n:
                    left[g] = (c.lo, c.hi, c.n)
                    break
                rank[g] -= c.n
    if not left:
        return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("at"))
    last = rows.where(reduce(or_, [inside(g) for g in left])).groupBy(by, value).agg(F.count("*").alias("_n"))
    upto = last.withColumn("_upto", F.sum("_n").over(Window.partitionBy(by).orderBy(value)))
    return upto.where(F.col("_upto") >= T.literal_map(rank)[F.col(by)]).groupBy(by).agg(F.min(value).alias("at")).select(by, T.literal_map({g[by]: g.mean for g in groups})[F.col(by)].alias("mean"), "at")


def latency_summary(samples: DataFrame, by: list[str], least_cold: int = 3, least_warm: int = 5) -> DataFrame:
    """Cold and warm percentiles, all null unless both modes have enough successes. Samples: mode, outcome, wall_time_ms."""
    good = samples.withColumn("cold", F.when((F.col("mode") == "cold") & (F.col("outcome") == "success"), F.col("wall_time_ms"))).withColumn("warm", F.when((F.col("mode") == "warm") & (F.col("outcome") == "success"), F.col("wall_time_ms")))
    wide = good.groupBy(*by).agg(
        F.count("cold").alias("n_cold"), F.count("warm").alias("n_warm"), *[nearest_rank(m, p).alias(f"{m}_p{int(p * 100)}") for m in ("cold", "warm") for p in (0.5, 0.95)]
    )
    enough = (F.col("n_cold") >= least_cold) & (F.col("n_warm") >= least_warm)
    return wide.withColumns({c: F.when(enough, F.col(c).cast(samples.schema["wall_time_ms"].dataType)) for c in ("cold_p50", "cold_p95", "warm_p50", "warm_p95")})


def dispositions(findings: DataFrame, categories: tuple[str, ...] = ("confirmed", "needs_review", "dismissed")) -> DataFrame:
    """Zero-filled counts of fixed categories and the outcome: alert, else needs_review, else all-clear."""
    t = findings.agg(*[F.count_if(F.col("disposition") == c).alias(c) for c in categories])
    return t.withColumn("outcome", F.when(F.col(categories[0]) > 0, "alert").when(F.col(categories[1]) > 0, "needs_review").otherwise("all-clear"))


def risk(findings: DataFrame) -> DataFrame:
    return findings.agg(T.severity_label(F.max(T.severity_rank(F.col("severity")))).alias("risk"))


def disagreement(a: Column, b: Column) -> Column:
    """Symmetric difference over union of two key arrays; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise((F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))) / union)


def failure_alert(tasks: DataFrame, by: list[str], least: int = 10, rate: float = 0.2) -> DataFrame:
    """Groups with enough tasks and too many failures. Tasks have a boolean ``failed``."""
    t = tasks.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("failed").alias("failed"))
    return t.where((F.col("total") >= least) & (F.col("failed") / F.col("total") > rate))


def distribution(statuses: DataFrame, dimensions: list[str], obligations: DataFrame) -> DataFrame:
    """Verdict counts and shares for each obligation: overall and by each dimension, every obligation of the dimension table present.

    One grouping-sets aggregation; ``slice`` names the dimension (``all`` for none) and ``slice_value`` its value.
    """
    counted = statuses.where("counted")
    name, value = F.lit("all"), F.lit("")
    for d in reversed(dimensions):
        here = F.grouping(d) == 0
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d).cast("string")).otherwise(value)
    sets = [[F.col("obligation")], *[[F.col("obligation"), F.col(d)] for d in dimensions]]
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SATISFIED", "REFUTED", "UNKNOWN")]
    out = counted.groupingSets(sets, "obligation", *dimensions).agg(name.alias("slice"), value.alias("slice_value"), *counts, F.count("*").alias("total")).drop(*dimensions)
    slices = out.select("slice", "slice_value").distinct()
    full = slices.join(obligations.select("obligation"), F.lit(True)).join(out, ["slice", "slice_value", "obligation"], "left")  # slices times the few fixed obligations
    filled = full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("satisfied", "refuted", "unknown", "total")})
    return filled.withColumns({"unknown_ratio": ratio(F.col("unknown"), F.col("total"), None), "refuted_ratio": ratio(F.col("refuted"), F.col("total"), None)})


def eligible_scores(revisions: DataFrame) -> DataFrame:
    """Confusion over all revisions; recall and abstention over counted ones. Revisions: revision, found, abstained, counted, seconds."""
    v, f, n = F.col("revision") == "vulnerable", F.col("revision") == "fixed", F.col("counted")
    return revisions.agg(
        F.count_if(v & F.col("found")).alias("tp"), F.count_if(v & ~F.col("found")).alias("fn"), F.count_if(f & F.col("found")).alias("fp"), F.count_if(f & ~F.col("found")).alias("tn"),
        ratio(F.count_if(v & n & F.col("found")), F.count_if(v & n), None).alias("recall"), ratio(F.count_if(n & F.col("abstained")), F.count_if(n), None).alias("abstention_rate"),
        (F.sum("seconds") / F.nullif(F.count("*"), F.lit(0))).alias("mean_seconds"),
    )


def by_weakness(cases: DataFrame) -> DataFrame:
    """Cases by weakness: passed, decisions, accuracy, failure categories and the nearest-rank 95th percentile of time. Cases: cwe, passed, decision, failure, seconds."""
    return cases.groupBy("cwe").agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(F.col("decision") == "repair").alias("repair"), F.count_if(F.col("decision") == "abstain").alias("abstain"),
        ratio(F.count_if("passed"), F.count("*"), 0.0).alias("accuracy"), F.sort_array(F.collect_set("failure")).alias("failures"), nearest_rank("seconds", 0.95).alias("p95_seconds"),
    )


def review_summary(rows: DataFrame) -> DataFrame:
    """Human and synthetic review rows apart; human sums are null, not zero, without a human row. Rows: reviewer, synthetic, verdict, minutes."""
    human = ~F.col("synthetic")
    return rows.agg(
        F.count_if(human).alias("human_rows"), F.count_if("synthetic").alias("synthetic_rows"), F.sum(F.when(human, F.col("minutes"))).alias("human_minutes"), F.count_distinct(F.when(human, F.col("reviewer"))).alias("reviewers"),
        F.count_if(human & (F.col("verdict") == "confirmed")).alias("confirmed"), F.count_if(human & (F.col("verdict") == "rejected")).alias("rejected"),
    )


def evidence_status(evidence: DataFrame) -> DataFrame:
    """Status of each subject from strong evidence both ways: conflicting, supported, refuted, or what it was. Evidence: subject_id, polarity, level, declared."""
    strong = F.col("level") == "D2"
    yes, no = F.bool_or(strong & (F.col("polarity") == "supports")), F.bool_or(strong & (F.col("polarity") == "refutes"))
    return evidence.groupBy("subject_id").agg(F.when(yes & no, "conflicting").when(yes, "supported").when(no, "refuted").otherwise(F.max("declared")).alias("status"))


def gates(baseline: DataFrame, candidate: DataFrame, protected: dict[str, float]) -> DataFrame:
    """Deltas of protected metrics between two one-row frames, a gate each, and whether all pass."""
    pair = baseline.select(*[F.col(m).alias(f"b_{m}") for m in protected]).join(candidate.select(*[F.col(m).alias(f"c_{m}") for m in protected]), F.lit(True))
    checks = [F.struct(F.lit(m).alias("metric"), (F.col(f"c_{m}") - F.col(f"b_{m}")).alias("delta"), (F.col(f"c_{m}") - F.col(f"b_{m}") >= -slack).alias("passed")) for m, slack in protected.items()]
    return pair.select(F.array(*checks).alias("gates")).withColumn("accepted", F.forall("gates", lambda g: g["passed"]))


# The release gates' least values, the kind of source that production needs, and the rounds within which a case converges.
F1_GAIN, EXECUTION_LEAST, SAFE_FIX_LEAST, END_TO_END_LEAST = 0.02, 0.98, 0.75, 0.60
PRODUCTION_SOURCE = "public-github-pr"
ROUND_BUDGET = 2


def release_gates(baseline: DataFrame, candidate: DataFrame, sources: DataFrame) -> DataFrame:
    """(gate, delta, passed, released): seven gates on numbers and one on where the candidate's cases come from; all must pass for a release.

    Both frames have one row of validation_f1, holdout_f1, high_risk_recall, clean_accuracy, execution_success_rate, safe_fix_rate and
    e2e_security_fix_rate; ``sources`` has a row (source_kind) a case. A missing number passes no gate.
    """
    names = ["validation_f1", "holdout_f1", "high_risk_recall", "clean_accuracy", "execution_success_rate", "safe_fix_rate", "e2e_security_fix_rate"]
    pair = baseline.select(*[F.col(c).alias(f"b_{c}") for c in names]).join(candidate.select(*[F.col(c).alias(f"c_{c}") for c in names]), F.lit(True))
    kinds = sources.agg(F.coalesce(F.bool_and(F.col("source_kind") == PRODUCTION_SOURCE) & (F.count("source_kind") == F.count("*")), F.lit(False)).alias("from_production"))
    gain, kept, least = (lambda c, by=0.0: F.col(f"c_{c}") >= F.col(f"b_{c}") + by), (lambda c: F.col(f"c_{c}") >= F.col(f"b_{c}")), (lambda c, x: F.col(f"c_{c}") >= x)
    gates_ = [
        ("validation_f1_improvement", "validation_f1", gain("validation_f1", F1_GAIN)), ("high_risk_recall_non_regression", "high_risk_recall", kept("high_risk_recall")), ("clean_accuracy_non_regression", "clean_accuracy", kept("clean_accuracy")),
        ("holdout_f1_non_regression", "holdout_f1", kept("holdout_f1")), ("execution_success", "execution_success_rate", least("execution_success_rate", EXECUTION_LEAST)), ("safe_fix_rate", "safe_fix_rate", least("safe_fix_rate", SAFE_FIX_LEAST)),
        ("e2e_security_fix_rate", "e2e_security_fix_rate", least("e2e_security_fix_rate", END_TO_END_LEAST)),
    ]
    rows = [F.struct(F.lit(g).alias("gate"), (F.col(f"c_{c}") - F.col(f"b_{c}")).alias("delta"), F.coalesce(ok, F.lit(False)).alias("passed")) for g, c, ok in gates_]
    rows.append(F.struct(F.lit("production_data_provenance").alias("gate"), F.lit(None).cast("double").alias("delta"), F.col("from_production").alias("passed")))
    made = pair.join(kinds, F.lit(True)).select(F.array(*rows).alias("g"))
    return made.withColumn("released", F.forall("g", lambda x: x["passed"])).select(F.explode("g").alias("x"), "released").select("x.*", "released")


def pair_scores(revisions: DataFrame) -> DataFrame:
    """Rates over pairs and gaps of an evaluation, null for an empty denominator: a case counts as a pair only if no revision of it is degraded.

    Revisions: case_id, counted, correct, gaps, calls, reply_bytes. Gaps are shares of counted revisions; means are over all revisions.
    """
    cases = revisions.groupBy("case_id").agg(F.bool_and("counted").alias("eligible"), F.bool_and("correct").alias("correct"))
    pairs = cases.agg(F.count_if("eligible").alias("pairs"), ratio(F.count_if(F.col("eligible") & F.col("correct")), F.count_if("eligible"), None).alias("paired_accuracy"))
    n = F.count("*")
    whole = revisions.agg(
        n.alias("revisions"), F.count_if("counted").alias("counted_revisions"), ratio(F.count_if(F.col("counted") & (F.col("gaps") > 0)), F.count_if("counted"), None).alias("gap_rate"), ratio(F.sum("calls"), n, None).alias("mean_calls"),
        ratio(F.sum("reply_bytes"), n, None).alias("mean_reply_bytes"),
    )
    return whole.join(pairs, F.lit(True))


def loop_scores(revisions: DataFrame, rounds: int = ROUND_BUDGET) -> DataFrame:
    """Rates of an experiment loop: revisable cases whose vulnerable revision is hit within ``rounds``, cases without security import that give no finding on either side, and stable ones of the revisions that are hit at all.

    Revisions: case_id, revision, kind, non_security, findings, first_hit_round, stable.
    """
    hit = F.coalesce((F.col("revision") == "vulnerable") & (F.col("first_hit_round") <= rounds), F.lit(False))
    cases = revisions.groupBy("case_id").agg(F.max("kind").alias("kind"), F.bool_or("non_security").alias("other"), F.bool_or(hit).alias("converged"), (F.sum("findings") == 0).alias("silent"))
    revisable = F.col("kind") == "revisable"
    of_cases = cases.agg(ratio(F.count_if(revisable & F.col("converged")), F.count_if(revisable), None).alias("convergence_rate"), ratio(F.count_if(F.col("other") & F.col("silent")), F.count_if("other"), None).alias("filter_rate"))
    found = F.col("first_hit_round").isNotNull()
    return of_cases.join(revisions.agg(ratio(F.count_if(found & F.coalesce("stable", F.lit(False))), F.count_if(found), None).alias("stability_rate")), F.lit(True))


def funnel(stages: DataFrame) -> DataFrame:
    """Stages (position, n) with the floored basis points that each keeps of the one before."""
    from pyspark.sql.window import Window

    before = F.lag("n").over(Window.orderBy("position"))
    return stages.withColumn("kept_bp", basis_points(F.col("n"), before))


def trace_metrics(traces: DataFrame, reasons: list[str]) -> DataFrame:
    """Traces (targets, stop_reason) counted by reason; an unknown reason is an error."""
    reason = F.when(F.col("stop_reason").isin(reasons), F.col("stop_reason")).otherwise("error")
    return traces.select(F.explode("targets").alias("target"), reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("targets"), F.count_distinct("target").alias("distinct_targets"))


def repository_profile(files: DataFrame) -> DataFrame:
    """Per repository: declared languages before inferred ones, and kinds (docs if more than half of the files are; test and build need a path and other evidence). Files: repository, path, language, declared, evidence."""
    roles = files.withColumn("roles", T.path_roles(F.col("path")))
    has = lambda r: F.array_contains("roles", r)
    other = F.col("evidence").isNotNull()
    t = roles.groupBy("repository").agg(
        F.sort_array(F.collect_set(F.when(F.col("declared"), F.col("language")))).alias("declared_languages"), F.sort_array(F.collect_set("language")).alias("languages"), (F.count_if(has("docs")) * 2 > F.count("*")).alias("docs"),
        (F.bool_or(has("test")) & F.bool_or(has("test") & other)).alias("test"), (F.bool_or(has("build")) & F.bool_or(has("build") & other)).alias("build"),
    )
    kinds = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("docs", "test", "build")]))
    return t.select("repository", F.when(F.size("declared_languages") > 0, F.col("declared_languages")).otherwise(F.col("languages")).alias("languages"), kinds.alias("kinds"))


def platform_scores(revisions: DataFrame) -> DataFrame:
    """Rates of an evaluation in one row, each with its own denominator, null where that is zero.

    Revisions: case_id, revision (vulnerable or fixed), found, abstained, completed, seconds. A case passes if a vulnerable
    revision is found and no fixed one is; it is stable if all its vulnerable revisions gave the same answer.
    """
    v, f, n = F.col("revision") == "vulnerable", F.col("revision") == "fixed", F.count("*")
    whole = revisions.agg(
        ratio(F.count_if(v & F.col("found")), F.count_if(v), None).alias("detection_rate"), ratio(F.count_if(f & F.col("found")), F.count_if(f), None).alias("false_positive_rate"),
        ratio(F.count_if("abstained"), n, None).alias("abstention_rate"), ratio(F.count_if("completed"), n, None).alias("completion_rate"), F.avg("seconds").alias("mean_seconds"), nearest_rank("seconds", 0.95).alias("p95_seconds"),
    )
    cases = revisions.groupBy("case_id").agg((F.bool_or(v & F.col("found")) & ~F.bool_or(f & F.col("found"))).alias("passed"), (F.count_distinct(F.when(v, F.col("found"))) < 2).alias("stable"))
    return whole.join(cases.agg(ratio(F.count_if("passed"), n, None).alias("pair_rate"), ratio(F.count_if("stable"), n, None).alias("stability_rate")), F.lit(True))


def _seconds(cases: DataFrame) -> DataFrame:
    """One row: mean and nearest-rank p95 of scans, retrievals and model calls over both revisions, zero without any."""
    sides = [F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}.{side}_ms").alias("ms")) for kind in ("scan", "retrieval", "llm") for side in ("vulnerable", "fixed")]
    timed = nearest_ranks(cases.select(F.explode(F.array(*sides)).alias("x")).select("x.*"), "kind", "ms", 0.95).withColumnRenamed("at", "p95")
    return timed.agg(*[rounded(F.coalesce(F.max(F.when(F.col("kind") == k, F.col(m))), F.lit(0.0)), 3).alias(f"{k}_ms_{m}") for k in ("scan", "retrieval", "llm") for m in ("mean", "p95")])


def evaluation_report(cases: DataFrame, mode: str = "llm-retrieval") -> DataFrame:
    """An evaluation in one row: rates of four digits with their own denominators (zero where that is zero), latencies and tokens.

    Cases hold structs: scan (vulnerable_hit, fixed_clean, discriminated, verified, vulnerable_ms, fixed_ms), repair (policy, attempted,
    patched), oracle (configured, executed, passed), and, null where not run, retrieval (path_hit, inventory_recall, symbol_hit,
    packet_hit, fixed_symbol_hit, risk_hit, mitigation_hit, vulnerable_candidates, fixed_candidates, two ms) and llm (vulnerable_correct,
    fixed_correct, fixed_clean, paired, snapshot_paired, vulnerable_status, fixed_status, vulnerable_valid, fixed_valid, non_clear,
    auto_cleared, paired_safe, reviews, decisions, tokens_in, tokens_out, two ms). Rates bound to a mode are zero in the others.
    """
    n, n_llm, n_found = F.count("*"), F.count("llm"), F.count("retrieval")
    executed = F.col("oracle.configured") & F.col("oracle.executed")
    both = lambda test: F.count_if(test("vulnerable")) + F.count_if(test("fixed"))
    localized, hybrid = (n_llm if mode == "llm" else F.lit(0)), (n_llm if mode == "llm-retrieval" else F.lit(0))
    rates = {f"scan_{f}_rate": (F.count_if(f"scan.{f}"), n) for f in ("vulnerable_hit", "fixed_clean", "discriminated", "verified")}
    rates |= {"repair_attempt_rate": (F.count_if("repair.attempted"), n), "verified_patch_rate": (F.count_if("repair.patched"), n)}
    abstain = F.col("repair.policy") == "abstain"
    rates |= {"abstention_adherence": (F.count_if(abstain & ~F.col("repair.patched")), F.count_if(abstain))}
    rates |= {"oracle_coverage": (F.count_if("oracle.configured"), n), "oracle_executed_coverage": (F.count_if(executed), n), "oracle_pass_rate": (F.count_if(executed & F.col("oracle.passed")), F.count_if(executed))}
    rates |= {f"retrieval_{f}_rate": (F.count_if(f"retrieval.{f}"), n_found) for f in ("path_hit", "symbol_hit", "packet_hit", "fixed_symbol_hit", "risk_hit", "mitigation_hit")}
    rates |= {f"llm_{f}_rate": (F.count_if(f"llm.{f}"), n_llm) for f in ("vulnerable_correct", "fixed_correct", "fixed_clean", "paired", "snapshot_paired")}
    rates |= {f"llm_localized_{f}_rate": (F.count_if(f"llm.{f}"), localized) for f in ("vulnerable_correct", "fixed_correct", "paired")}
    rates |= {f"hybrid_{f}_rate": (F.count_if(f"llm.{f}"), hybrid) for f in ("non_clear", "auto_cleared", "paired_safe")}
    rates |= {"hybrid_review_rate": (F.coalesce(F.sum("llm.reviews"), F.lit(0)), F.coalesce(F.sum("llm.decisions"), F.lit(0)))}
    rates |= {"llm_success_rate": (both(lambda s: F.col(f"llm.{s}_status") == "completed"), n_llm * 2), "llm_valid_rate": (both(lambda s: F.col(f"llm.{s}_valid")), n_llm * 2)}
    candidates = (F.sum("retrieval.vulnerable_candidates") + F.sum("retrieval.fixed_candidates")) / F.nullif(n_found * 2, F.lit(0))
    whole = cases.agg(
        n.alias("cases"), *[rounded(ratio(part, of, 0.0), 4).alias(name) for name, (part, of) in rates.items()], rounded(F.coalesce(F.avg("retrieval.inventory_recall"), F.lit(0.0)), 4).alias("retrieval_inventory_recall"),
        rounded(F.coalesce(candidates, F.lit(0.0)), 3).alias("retrieval_candidates_mean"), F.coalesce(F.sum("llm.tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("llm.tokens_out"), F.lit(0)).alias("tokens_out"),
    )
    return whole.join(_seconds(cases), F.lit(True))


def failure_categories(cases: DataFrame) -> DataFrame:
    """(category, n) of an evaluation's failures; a case may have several, and one for each failed model call."""
    failed = lambda side: F.col("llm").isNotNull() & ~F.equal_null(F.col(f"llm.{side}_status"), F.lit("completed"))
    tests = [
        ("detector-missed-known-vulnerable-file", ~F.col("scan.vulnerable_hit")), ("detector-alerted-on-fixed-pair", ~F.col("scan.fixed_clean")),
        ("project-oracle-pair-failed", F.col("oracle.executed") & ~F.coalesce("oracle.passed", F.lit(False))), ("retrieval-inventory-missed-ground-truth-path", F.col("retrieval.inventory_recall") < 1),
        ("retriever-missed-vulnerable-symbol", ~F.col("retrieval.symbol_hit")), ("llm-api-failed", failed("vulnerable")), ("llm-api-failed", failed("fixed")),
        ("llm-pair-misclassified", F.col("llm").isNotNull() & ~F.coalesce("llm.paired", F.lit(False))),
    ]
    return cases.select(F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
