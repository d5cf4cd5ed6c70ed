"""Metrics, percentiles, gates and distributions over labels, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import digests
from strata.operators import metrics
from strata.plans.catalog import query

_CASES = """cases AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN d.source = 'src0' THEN 'holdout' ELSE 'validation' END AS split, 1 - l.quality AS expected, (d.n_chars < 400)::INT AS predicted FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT *, (expected = 1 AND predicted = 1)::INT AS tp, (expected = 0 AND predicted = 1)::INT AS fp, (expected = 1 AND predicted = 0)::INT AS fn, (expected = 0 AND predicted = 0) AS clean_hit FROM cases)"""


def _results(t):
    labelled = t("documents").join(t("labels"), "doc_id")
    rows = labelled.select("doc_id", "lang", "source", F.when(F.col("source") == "src0", "holdout").otherwise("validation").alias("split"), (1 - F.col("quality")).alias("expected"), (F.col("n_chars") < 400).cast("int").alias("predicted"))
    e, p = F.col("expected") == 1, F.col("predicted") == 1
    zero = F.lit(0)
    return rows.withColumns({
        "tp": (e & p).cast("int"), "fp": (~e & p).cast("int"), "fn": (e & ~p).cast("int"), "severity_hits": (e & p).cast("int"), "high_total": zero, "high_hits": zero, "repair_attempted": zero, "repair_passed": zero,
        "clean_hit": ~e & ~p, "execution_success": F.lit(True), "e2e_success": F.lit(False),
    })


_RATES = """coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 1.0) AS recall"""


@query(f"""
WITH {_CASES}, t AS (SELECT lang, count(*) AS cases, count(*) FILTER (WHERE expected = 0) AS clean_cases, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) FILTER (WHERE clean_hit) AS clean_hits FROM r GROUP BY lang), m AS (SELECT *, {_RATES} FROM t)
SELECT lang, cases, tp, fp, fn, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1, coalesce(clean_hits / nullif(clean_cases, 0), 1.0) AS clean_accuracy FROM m""")
def quality_metrics(t):
    """Confusion and rates of a length rule against quality labels, by language."""
    return metrics.metrics(metrics.totals(_results(t), ["lang"])).select("lang", "cases", "tp", "fp", "fn", "precision", "recall", "f1", "clean_accuracy")


@query(f"""
WITH {_CASES}, d AS (SELECT unnest(['validation', 'holdout', 'unused']) AS split), t AS (SELECT d.split, count(r.doc_id) AS cases, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM d LEFT JOIN r ON r.split = d.split GROUP BY d.split), m AS (SELECT *, {_RATES} FROM t)
SELECT split, cases, tp, fp, fn, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m""")
def metrics_by_split(t):
    """The same by split, with a split that has no case."""
    results = _results(t)
    splits = results.sparkSession.createDataFrame([("validation",), ("holdout",), ("unused",)], "split string")
    return metrics.metrics_by_split(results, splits).select("split", "cases", "tp", "fp", "fn", "precision", "recall", "f1")


@query(f"""
WITH {_CASES}, t AS (SELECT count(*) AS cases, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(expected)::BIGINT AS expected_total, count(*) FILTER (WHERE expected = 0) AS clean_total, count(*) FILTER (WHERE clean_hit) AS clean_hits FROM r),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 1.0) AS recall, clean_hits / clean_total AS clean_accuracy, CASE WHEN tp > 0 OR fn = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS severity FROM t),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m)
SELECT cases, tp, fp, fn, precision, recall, f1, clean_accuracy, (f1 * 0.65::DOUBLE + severity * 0.15::DOUBLE + clean_accuracy * 0.20::DOUBLE) / (0.80::DOUBLE + 0.20::DOUBLE) AS score FROM f""")
def replay_score(t):
    rows = _results(t).select("expected", "tp", "fp", "predicted", F.col("tp").alias("severity_ok"), F.lit(0).alias("high_total"), F.lit(0).alias("high_hits"), F.lit(False).alias("failed"))
    return metrics.replay_metrics(rows).select("cases", "tp", "fp", "fn", "precision", "recall", "f1", "clean_accuracy", "score")


@query("""
WITH r AS (SELECT source AS case_id, CASE WHEN l.quality = 0 THEN 'vulnerable' ELSE 'fixed' END AS revision, regexp_matches(d.text, '[#*$%&|<>]') AS found FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT case_id, coalesce(bool_or(CASE WHEN revision = 'vulnerable' THEN found END), false) AS hit, NOT coalesce(bool_or(CASE WHEN revision = 'fixed' THEN found END), false) AS clean FROM r GROUP BY case_id) SELECT case_id, hit, clean, hit AND clean AS discriminated FROM g""")
def paired_discrimination(t):
    rows = t("documents").join(t("labels"), "doc_id").select(F.col("source").alias("case_id"), F.when(F.col("quality") == 0, "vulnerable").otherwise("fixed").alias("revision"), F.col("text").rlike("[#*$%&|<>]").alias("found"))
    return metrics.paired(rows)


@query("SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, max(o_totalprice) AS longest FROM orders GROUP BY o_orderpriority")
def nearest_rank_prices(t):
    return t("orders").groupBy("o_orderpriority").agg(metrics.nearest_rank("o_totalprice", 0.5).alias("p50"), metrics.nearest_rank("o_totalprice", 0.95).alias("p95"), F.max("o_totalprice").alias("longest"))


_SAMPLES = "s AS (SELECT user_id, CASE WHEN event_type = 'signup' THEN 'cold' ELSE 'warm' END AS mode, event_type <> 'error' AS ok, floor(value * 100)::BIGINT AS ms FROM events)"


@query(f"""
WITH {_SAMPLES}, a AS (SELECT user_id, count(*) FILTER (WHERE ok AND mode = 'cold') AS n_cold, count(*) FILTER (WHERE ok AND mode = 'warm') AS n_warm, quantile_disc(ms, 0.5) FILTER (WHERE ok AND mode = 'cold') AS c50, quantile_disc(ms, 0.95) FILTER (WHERE ok AND mode = 'cold') AS c95,
  quantile_disc(ms, 0.5) FILTER (WHERE ok AND mode = 'warm') AS w50, quantile_disc(ms, 0.95) FILTER (WHERE ok AND mode = 'warm') AS w95 FROM s GROUP BY user_id)
SELECT user_id, n_cold, n_warm, CASE WHEN n_cold >= 3 AND n_warm >= 5 THEN c50 END AS cold_p50, CASE WHEN n_cold >= 3 AND n_warm >= 5 THEN c95 END AS cold_p95, CASE WHEN n_cold >= 3 AND n_warm >= 5 THEN w50 END AS warm_p50, CASE WHEN n_cold >= 3 AND n_warm >= 5 THEN w95 END AS warm_p95 FROM a""")
def latency_percentiles(t):
    """Cold and warm percentiles of users with enough samples of both."""
    rows = t("events").select("user_id", F.when(F.col("event_type") == "signup", "cold").otherwise("warm").alias("mode"), F.when(F.col("event_type") != "error", "success").otherwise("failed").alias("outcome"), F.floor(F.col("value") * 100).cast("long").alias("wall_time_ms"))
    return metrics.latency_summary(rows, ["user_id"])


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id HAVING count(*) >= 10 AND count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.2")
def failure_alerts(t):
    return metrics.failure_alert(t("events").withColumn("failed", F.col("event_type") == "error"), ["user_id"])


_STATUS = "x AS (SELECT 'P' || l_linenumber AS obligation, CASE l_returnflag WHEN 'R' THEN 'REFUTED' WHEN 'N' THEN 'UNKNOWN' ELSE 'SATISFIED' END AS status, l_linestatus AS kind, o_orderpriority AS project FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 1)"


@query(f"""
WITH {_STATUS}, o AS (SELECT 'P' || i AS obligation FROM range(1, 10) r(i)),
g AS (SELECT obligation, CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(project) = 0 THEN 'project' ELSE 'all' END AS slice, CASE WHEN grouping(kind) = 0 THEN kind WHEN grouping(project) = 0 THEN project ELSE '' END AS slice_value,
  count(*) FILTER (WHERE status = 'SATISFIED') AS satisfied, count(*) FILTER (WHERE status = 'REFUTED') AS refuted, count(*) FILTER (WHERE status = 'UNKNOWN') AS unknown, count(*) AS total FROM x GROUP BY GROUPING SETS ((obligation), (obligation, kind), (obligation, project)))
SELECT s.slice, s.slice_value, o.obligation, coalesce(satisfied, 0) AS satisfied, coalesce(refuted, 0) AS refuted, coalesce(unknown, 0) AS unknown, coalesce(total, 0) AS total, unknown / nullif(total, 0) AS unknown_ratio, refuted / nullif(total, 0) AS refuted_ratio
FROM (SELECT DISTINCT slice, slice_value FROM g) s CROSS JOIN o LEFT JOIN g ON g.slice = s.slice AND g.slice_value = s.slice_value AND g.obligation = o.obligation""")
def obligation_distribution(t):
    """Verdicts by obligation, overall and by two dimensions, in one grouping-sets pass."""
    status = F.when(F.col("l_returnflag") == "R", "REFUTED").when(F.col("l_returnflag") == "N", "UNKNOWN").otherwise("SATISFIED")
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("obligation"), status.alias("status"), F.col("l_linestatus").alias("kind"), F.col("o_orderpriority").alias("project"), (F.col("l_quantity") > 1).alias("counted")
    )
    obligations = rows.sparkSession.range(1, 10).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("obligation"))
    return metrics.distribution(rows, ["kind", "project"], obligations)


_REV = "r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'vulnerable' ELSE 'fixed' END AS revision, l_discount > 0.05 AS found, l_tax = 0 AS abstained, l_quantity > 10 AS counted, l_orderkey FROM lineitem)"


@query(f"""
WITH {_REV} SELECT count(*) FILTER (WHERE revision = 'vulnerable' AND found) AS tp, count(*) FILTER (WHERE revision = 'vulnerable' AND NOT found) AS fn, count(*) FILTER (WHERE revision = 'fixed' AND found) AS fp, count(*) FILTER (WHERE revision = 'fixed' AND NOT found) AS tn,
 count(*) FILTER (WHERE revision = 'vulnerable' AND counted AND found) / nullif(count(*) FILTER (WHERE revision = 'vulnerable' AND counted), 0) AS recall, count(*) FILTER (WHERE counted AND abstained) / nullif(count(*) FILTER (WHERE counted), 0) AS abstention_rate FROM r""")
def eligible_scores(t):
    rows = t("lineitem").select(F.when(F.col("l_returnflag") == "R", "vulnerable").otherwise("fixed").alias("revision"), (F.col("l_discount") > 0.05).alias("found"), (F.col("l_tax") == 0).alias("abstained"), (F.col("l_quantity") > 10).alias("counted"), F.lit(1.0).alias("seconds"))
    return metrics.eligible_scores(rows).drop("mean_seconds")


@query("""
SELECT p_type AS cwe, count(*) AS cases, count(*) FILTER (WHERE p_size > 25) AS passed, count(*) FILTER (WHERE p_size > 40) AS repair, count(*) FILTER (WHERE p_size <= 10) AS abstain, count(*) FILTER (WHERE p_size > 25) / count(*) AS accuracy,
 string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS failures, quantile_disc(p_retailprice, 0.95) AS p95_seconds FROM part GROUP BY p_type""")
def weakness_groups(t):
    rows = t("part").select(F.col("p_type").alias("cwe"), (F.col("p_size") > 25).alias("passed"), F.when(F.col("p_size") > 40, "repair").when(F.col("p_size") <= 10, "abstain").otherwise("").alias("decision"), F.col("p_brand").alias("failure"), F.col("p_retailprice").alias("seconds"))
    return metrics.by_weakness(rows).withColumn("failures", F.array_join("failures", ","))


@query("""
SELECT count(*) FILTER (WHERE role = 'user') AS human_rows, count(*) FILTER (WHERE role <> 'user') AS synthetic_rows, sum(CASE WHEN role = 'user' THEN turn END)::BIGINT AS human_minutes, count(DISTINCT CASE WHEN role = 'user' THEN conv_id END) AS reviewers,
 count(*) FILTER (WHERE role = 'user' AND turn = 0) AS confirmed, count(*) FILTER (WHERE role = 'user' AND turn > 1) AS rejected FROM conversations""")
def review_summary(t):
    rows = t("conversations").select(F.col("conv_id").alias("reviewer"), (F.col("role") != "user").alias("synthetic"), F.when(F.col("turn") == 0, "confirmed").when(F.col("turn") > 1, "rejected").otherwise("open").alias("verdict"), F.col("turn").alias("minutes"))
    return metrics.review_summary(rows)


@query("""
WITH e AS (SELECT l_orderkey AS subject_id, bool_or(l_quantity > 45 AND l_returnflag = 'A') AS yes, bool_or(l_quantity > 45 AND l_returnflag = 'R') AS no FROM lineitem GROUP BY l_orderkey)
SELECT subject_id, CASE WHEN yes AND no THEN 'conflicting' WHEN yes THEN 'supported' WHEN no THEN 'refuted' ELSE 'proposed' END AS status FROM e""")
def evidence_statuses(t):
    polarity = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "refutes").otherwise("neutral")
    rows = t("lineitem").select(F.col("l_orderkey").alias("subject_id"), polarity.alias("polarity"), F.when(F.col("l_quantity") > 45, "D2").otherwise("D1").alias("level"), F.lit("proposed").alias("declared"))
    return metrics.evidence_status(rows)


@query("""
WITH s AS (SELECT 0 AS position, count(*) AS n FROM lineitem UNION ALL SELECT 1, count(*) FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT 2, count(*) FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'R' UNION ALL SELECT 3, count(*) FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'R' AND l_discount > 0.08)
SELECT position::BIGINT AS position, n, floor(n * 10000 / nullif(lag(n) OVER (ORDER BY position), 0))::BIGINT AS kept_bp FROM s""")
def compression_funnel(t):
    """How many basis points of rows each further condition keeps; one scan counts them all."""
    a, b, c = F.col("l_quantity") > 10, F.col("l_returnflag") == "R", F.col("l_discount") > 0.08
    counts = t("lineitem").agg(F.array(F.count("*"), F.count_if(a), F.count_if(a & b), F.count_if(a & b & c)).alias("ns"))
    return metrics.funnel(counts.select(F.posexplode("ns").alias("position", "n")).withColumn("position", F.col("position").cast("long")))


@query("""
SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'error' END AS reason, count(*) AS targets, count(DISTINCT user_id) AS distinct_targets FROM events GROUP BY 1""")
def trace_metrics(t):
    return metrics.trace_metrics(t("events").select(F.array("user_id").alias("targets"), F.col("event_type").alias("stop_reason")), ["view", "click", "purchase"])


@query("""
WITH k AS (SELECT o_custkey, list(DISTINCT o_orderstatus) FILTER (WHERE o_orderpriority < '3') AS a, list(DISTINCT o_orderstatus) FILTER (WHERE o_orderpriority >= '3') AS b FROM orders GROUP BY o_custkey), j AS (SELECT o_custkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM k)
SELECT o_custkey, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE (len(list_distinct(list_concat(a, b))) - len(list_intersect(a, b))) / len(list_distinct(list_concat(a, b))) END AS disagreement FROM j""")
def lane_disagreement(t):
    sets = t("orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderpriority") < "3", F.col("o_orderstatus"))).alias("a"), F.collect_set(F.when(F.col("o_orderpriority") >= "3", F.col("o_orderstatus"))).alias("b"))
    return sets.select("o_custkey", metrics.disagreement(F.col("a"), F.col("b")).alias("disagreement"))


@query("""
WITH v AS (SELECT event_type, count(*) FILTER (WHERE value > 30) / count(*) AS rate FROM events GROUP BY event_type), b AS (SELECT max(rate) AS x FROM v WHERE event_type = 'view'), c AS (SELECT max(rate) AS x FROM v WHERE event_type = 'click')
SELECT c.x - b.x AS delta, c.x - b.x >= -0.05::DOUBLE AS accepted FROM b, c""")
def regression_gate(t):
    rate = lambda kind: t("events").where(F.col("event_type") == kind).agg((F.count_if(F.col("value") > 30) / F.count("*")).alias("rate"))
    out = metrics.gates(rate("view"), rate("click"), {"rate": 0.05})
    return out.select(F.col("gates")[0]["delta"].alias("delta"), "accepted")


@query("SELECT n_regionkey::BIGINT AS region, floor(count(*) FILTER (WHERE c_acctbal > 0) * 10000 / nullif(count(*), 0))::BIGINT AS floor_bp, least(ceil(count(*) FILTER (WHERE c_acctbal > 0) * 10000 / nullif(count(*), 0)), 10000)::BIGINT AS ceil_bp FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def basis_point_shares(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.count_if(F.col("c_acctbal") > 0).alias("a"), F.count("*").alias("b"))
    return rows.select("region", digests.basis_points(F.col("a"), F.col("b")).alias("floor_bp"), digests.basis_points_up(F.col("a"), F.col("b")).alias("ceil_bp"))


_GATED = ["validation_f1", "holdout_f1", "high_risk_recall", "clean_accuracy", "execution_success_rate", "safe_fix_rate", "e2e_security_fix_rate"]


@query("""
WITH m AS (SELECT i, avg(CASE WHEN user_id % 2 = 0 AND event_id % (i + 2) > 0 THEN 1.0 WHEN user_id % 2 = 0 THEN 0.0 END) AS b, avg(CASE WHEN user_id % 2 = 1 AND (event_id % (i + 2) > 0 OR i > 3) THEN 1.0 WHEN user_id % 2 = 1 THEN 0.0 END) AS c FROM events, unnest(range(7)) u(i) GROUP BY i),
g AS (SELECT (['validation_f1_improvement', 'holdout_f1_non_regression', 'high_risk_recall_non_regression', 'clean_accuracy_non_regression', 'execution_success', 'safe_fix_rate', 'e2e_security_fix_rate'])[(i + 1)::INT] AS gate, c - b AS delta,
 CASE i WHEN 0 THEN c >= b + 0.02 WHEN 4 THEN c >= 0.98 WHEN 5 THEN c >= 0.75 WHEN 6 THEN c >= 0.6 ELSE c >= b END AS passed FROM m UNION ALL SELECT 'production_data_provenance', NULL, bool_and(event_type <> 'none') FROM events)
SELECT *, (SELECT bool_and(passed) FROM g) AS released FROM g""")
def release_gates(t):
    """Gates between two halves of the events as baseline and candidate, all of whose cases come from where production needs."""
    rows = t("events").withColumn("half", F.col("user_id") % 2)
    rate = lambda half, i: F.avg(F.when(F.col("half") == half, ((F.col("event_id") % (i + 2) > 0) | F.lit(half == 1 and i > 3)).cast("double"))).alias(_GATED[i])
    sides = [rows.agg(*[rate(half, i) for i in range(7)]) for half in (0, 1)]
    return metrics.release_gates(*sides, rows.select(F.when(F.col("event_type") != "none", "public-github-pr").alias("source_kind")))


@query("""
WITH r AS (SELECT user_id // 2 AS case_id, event_id % 13 <> 0 AS counted, event_id % 5 > 0 AS correct, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS gaps, event_id % 4 AS calls, length(props) AS bytes FROM events), p AS (SELECT bool_and(counted) AS e, bool_and(correct) AS c FROM r GROUP BY case_id)
SELECT count(*) AS revisions, count(*) FILTER (WHERE counted) AS counted_revisions, count(*) FILTER (WHERE counted AND gaps > 0) / nullif(count(*) FILTER (WHERE counted), 0) AS gap_rate, sum(calls) / count(*) AS mean_calls, sum(bytes) / count(*) AS mean_reply_bytes,
 (SELECT count(*) FILTER (WHERE e) FROM p) AS pairs, (SELECT count(*) FILTER (WHERE e AND c) / nullif(count(*) FILTER (WHERE e), 0) FROM p) AS paired_accuracy FROM r""")
def pair_scores(t):
    i = F.col("event_id")
    rows = t("events").select(F.floor(F.col("user_id") / 2).alias("case_id"), (i % 13 != 0).alias("counted"), (i % 5 > 0).alias("correct"), (i % 3 == 0).cast("int").alias("gaps"), (i % 4).alias("calls"), F.length("props").alias("reply_bytes"))
    return metrics.pair_scores(rows)


@query("""
WITH r AS (SELECT user_id AS case_id, event_id % 2 = 0 AS v, user_id % 3 = 0 AS revisable, user_id % 4 = 0 AS other, CASE WHEN user_id % 8 = 0 THEN 0 ELSE event_id % 5 END AS findings, CASE WHEN event_id % 7 > 3 THEN event_id % 7 - 3 + user_id % 2 END AS hit, event_id % 11 > 0 AS stable FROM events),
c AS (SELECT bool_or(revisable) AS revisable, bool_or(other) AS other, bool_or(coalesce(v AND hit <= 2, false)) AS converged, sum(findings) = 0 AS silent FROM r GROUP BY case_id)
SELECT (SELECT count(*) FILTER (WHERE revisable AND converged) / nullif(count(*) FILTER (WHERE revisable), 0) FROM c) AS convergence_rate, (SELECT count(*) FILTER (WHERE other AND silent) / nullif(count(*) FILTER (WHERE other), 0) FROM c) AS filter_rate,
 count(*) FILTER (WHERE hit IS NOT NULL AND stable) / nullif(count(*) FILTER (WHERE hit IS NOT NULL), 0) AS stability_rate FROM r""")
def loop_scores(t):
    i, u = F.col("event_id"), F.col("user_id")
    rows = t("events").select(
        u.alias("case_id"), F.when(i % 2 == 0, "vulnerable").otherwise("fixed").alias("revision"), F.when(u % 3 == 0, "revisable").otherwise("plain").alias("kind"), (u % 4 == 0).alias("non_security"),
        F.when(u % 8 == 0, 0).otherwise(i % 5).alias("findings"), F.when(i % 7 > 3, i % 7 - 3 + u % 2).alias("first_hit_round"), (i % 11 > 0).alias("stable"),
    )
    return metrics.loop_scores(rows, 2)
