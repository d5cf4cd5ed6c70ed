"""State folds, delivery and reachability over events, orders and the place tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import graph, state
from strata.plans.catalog import query
from strata.streaming import delivery


def _log(t):
    return t("events").select("user_id", "event_type", F.col("event_id").alias("seq"), "value", "props")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY ALL")
def upsert_last(t):
    return state.upsert_last(_log(t), ["user_id", "event_type"]).select("user_id", "event_type", "value", "seq")


@query("SELECT user_id, max(value) AS importance, arg_max(props, event_id) AS expires_at, arg_min(event_type, event_id) AS kind FROM events GROUP BY user_id")
def upsert_max(t):
    rows = _log(t).select("user_id", "seq", F.col("value").alias("importance"), F.col("props").alias("expires_at"), F.col("event_type").alias("kind"))
    return state.upsert_max(rows, ["user_id"], "importance", "expires_at").select("user_id", "importance", "expires_at", "kind")


@query("SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(props, event_id) FILTER (WHERE event_type = 'purchase') AS result FROM events GROUP BY user_id")
def upsert_coalesce(t):
    rows = _log(t).select("user_id", "seq", F.col("event_type").alias("status"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("result"))
    return state.upsert_coalesce(rows, ["user_id"], "result").select("user_id", "status", "result")


@query("SELECT user_id, event_type, min(event_id) AS seq, arg_min(value, event_id) AS value FROM events GROUP BY ALL")
def insert_or_ignore(t):
    return state.insert_or_ignore(_log(t), ["user_id", "event_type"]).select("user_id", "event_type", "seq", "value")


@query("""
WITH v AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events) SELECT user_id, version, event_id,
 coalesce(version = max(CASE WHEN event_type = 'purchase' THEN version END) OVER (PARTITION BY user_id), false) AS active FROM v""")
def artifact_versions(t):
    rows = t("events").select("user_id", "event_id", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("activate"))
    return state.versions(rows, ["user_id"]).select("user_id", F.col("version").cast("long").alias("version"), "event_id", "active")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') GROUP BY o_orderstatus")
def deleted_by_predicate(t):
    return state.delete_where(t("orders"), o_orderstatus="F", o_orderpriority="5-LOW", o_custkey=None).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT user_id, event_id, count(*) OVER w AS n, sum((event_type = 'error')::INT) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT CAST(user_id AS VARCHAR) AS tenant_id, max(n) AS samples, max(e)::BIGINT AS errors, min(CASE WHEN n >= 10 AND e / n > 0.25 THEN event_id END) AS breach_seq, CASE WHEN min(CASE WHEN n >= 10 AND e / n > 0.25 THEN event_id END) IS NULL THEN 'running' ELSE 'rolled_back' END AS status FROM r GROUP BY user_id""")
def canary_rollbacks(t):
    """Each user as a deployment: the first point at which its error rate breaches the budget."""
    seen = t("events").select(F.col("user_id").cast("string").alias("tenant_id"), F.lit("llm-review").alias("skill_name"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))
    configs = seen.select("tenant_id", "skill_name").distinct().withColumns({"seq": F.lit(-1).cast("long"), "min_samples": F.lit(10), "max_error_rate": F.lit(0.25)})
    return state.deployments(configs, seen).select("tenant_id", "samples", "errors", "breach_seq", "status")


@query("""
WITH b AS (SELECT c_custkey, (('0x' || substr(sha256('default:llm-review:' || c_custkey), 1, 8))::BIGINT % 100)::BIGINT AS bucket FROM customer) SELECT c_custkey, bucket, CASE WHEN bucket < 20 THEN 'canary' ELSE 'stable' END AS lane, bucket < 50 AS shadow FROM b""")
def release_lanes(t):
    return state.lanes(t("customer").select("c_custkey"), 20, 50, "default", "llm-review", "c_custkey")


@query("""
SELECT user_id AS task_id, CASE WHEN bool_or(event_type = 'error') AND arg_max(event_type, event_id) = 'purchase' THEN 'CANCELLED' WHEN arg_max(event_type, event_id) = 'purchase' THEN 'SUCCESS' WHEN arg_max(event_type, event_id) = 'error' THEN 'CANCELLED' ELSE 'RUNNING' END AS state FROM events GROUP BY user_id""")
def terminal_states(t):
    name = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "CANCELLED").otherwise("RUNNING")
    return state.terminal_state(t("events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), name.alias("state")))


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY user_id) SELECT c_custkey AS case_id, coalesce(l.s = 'error', false) AS needs_permission FROM customer LEFT JOIN l ON l.user_id = c_custkey WHERE coalesce(l.s, '') <> 'purchase'""")
def resumable_cases(t):
    name = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "AMBIGUOUS").otherwise("RUNNING")
    marks = t("events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), name.alias("status"))
    return state.resume(t("customer").select(F.col("c_custkey").alias("case_id")), marks).select("case_id", "needs_permission")


@query("""
WITH r AS (SELECT DISTINCT p_brand AS skill, p_type AS rule_id, p_name AS m FROM part WHERE p_size <= 25), f AS (SELECT 'Brand#' || (l_suppkey % 25 + 1) AS skill, p_type AS rule_id, p_name AS m, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS kind FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45),
a AS (SELECT skill, rule_id, m, -1 AS seq FROM r UNION ALL SELECT skill, rule_id, m, seq FROM f WHERE kind = 'A'), l AS (SELECT skill, rule_id, m, max(seq) AS came FROM a GROUP BY ALL), g AS (SELECT skill, rule_id, max(seq) AS gone FROM f WHERE kind = 'R' GROUP BY ALL)
SELECT l.skill, l.rule_id, l.m AS match FROM l LEFT JOIN g ON g.skill = l.skill AND g.rule_id = l.rule_id WHERE g.gone IS NULL OR l.came > g.gone""")
def evolved_rules(t):
    """Rule sets after feedback that removes and adds rules in order."""
    rules = t("part").where("p_size <= 25").select(F.col("p_brand").alias("skill"), F.col("p_type").alias("rule_id"), F.col("p_name").alias("match"))
    heavy = t("lineitem").where("l_quantity >= 45").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    feedback = heavy.select(
        F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("skill"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_returnflag") == "R", "false_positive").when(F.col("l_returnflag") == "A", "missed_issue").otherwise("").alias("kind"), F.col("p_type").alias("rule_id"), F.col("p_name").alias("match"),
    )
    return state.evolve_rules(rules, feedback)


@query("SELECT o_orderkey AS cache_key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def cache_misses(t):
    cache = t("lineitem").select(F.col("l_orderkey").alias("cache_key"), F.when(F.col("l_returnflag") == "R", F.lit("{}")).alias("payload"))
    return state.cache_misses(t("orders").select(F.col("o_orderkey").alias("cache_key")), cache)


def _deliveries(t):
    return t("lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("delivery_id"), F.col("l_returnflag").alias("payload"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("seq"))


@query("""
SELECT l_orderkey || '-' || l_linenumber AS delivery_id, l_returnflag AS payload FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""")
def idempotent_deliveries(t):
    return delivery.accepted(_deliveries(t)).select("delivery_id", "payload")


@query("SELECT l_orderkey || '-' || l_linenumber AS delivery_id, count(DISTINCT l_returnflag) AS payloads FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_returnflag) > 1")
def delivery_conflicts(t):
    return delivery.conflicts(_deliveries(t))


@query("""
WITH e AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, value > 60 AS permanent, (epoch_us(ts) // 1000000)::BIGINT AS t0 FROM events WHERE event_type = 'error')
SELECT CAST(event_id AS VARCHAR) AS message_id, attempt, CASE WHEN permanent OR attempt >= 3 THEN 'dead' ELSE 'retry' END AS route, CASE WHEN NOT (permanent OR attempt >= 3) THEN attempt + 1 END AS next_attempt,
 CASE WHEN NOT (permanent OR attempt >= 3) THEN t0 + least(power(2, attempt - 1), 10) END::DOUBLE AS due_at FROM e""")
def failure_routes(t):
    from pyspark.sql.window import Window

    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    failed = t("events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("message_id"), attempt.alias("attempt"), (F.col("value") > 60).alias("permanent"), F.unix_timestamp("ts").alias("failed_at"), F.col("props").alias("error"))
    return delivery.route_failures(failed).select("message_id", "attempt", "route", "next_attempt", F.col("due_at").cast("double").alias("due_at"))


@query("SELECT CAST(event_id AS VARCHAR) AS message_id, (epoch_us(ts) // 1000000)::BIGINT AS failed_at FROM events WHERE event_type = 'error' ORDER BY (epoch_us(ts) // 1000000)::BIGINT DESC, CAST(event_id AS VARCHAR) LIMIT 500")
def dead_letter_list(t):
    dead = t("events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("message_id"), F.unix_timestamp("ts").alias("failed_at"))
    return delivery.dead_letters(dead, 1000)


@query("SELECT o_orderkey AS delivery_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') ORDER BY o_orderkey LIMIT 100")
def outbox_drain(t):
    sent = t("lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("delivery_id"))
    return delivery.undispatched(t("orders").select(F.col("o_orderkey").alias("delivery_id")), sent)


_PLACE = "CASE s WHEN 'view' THEN 2 WHEN 'click' THEN 8 WHEN 'purchase' THEN 15 WHEN 'signup' THEN 1 ELSE 13 END"


@query(f"SELECT task_id, {_PLACE}::BIGINT AS place FROM (SELECT user_id AS task_id, arg_max(event_type, event_id) AS s FROM events GROUP BY user_id)")
def stage_positions(t):
    named = F.when(F.col("event_type") == "view", "RESOLVING_REVISION").when(F.col("event_type") == "click", "INVENTORY").when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "signup", "QUEUED").otherwise("SEMANTIC_TRIAGE")
    rows = t("events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), named.alias("stage"))
    return delivery.stage_progress(rows).select("task_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT 'r' || r_regionkey AS tip, 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def reachable_places(t):
    """Everything a region leads to, hop by hop."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = (
        t("nation").select(name("r", "n_regionkey").alias("commit"), name("n", "n_nationkey").alias("parent"))
        .unionByName(t("customer").select(name("n", "c_nationkey").alias("commit"), name("c", "c_custkey").alias("parent")))
        .unionByName(t("supplier").select(name("n", "s_nationkey").alias("commit"), name("s", "s_suppkey").alias("parent")))
    )
    tips = t("region").select(name("r", "r_regionkey").alias("tip"), name("r", "r_regionkey").alias("commit"))
    return graph.ancestry(edges, tips)


@query("""
WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 50 AND l_discount = 0.1 AND l_returnflag = 'R')
SELECT a::BIGINT AS src, b::BIGINT AS dst, 'self-edge' AS problem FROM e WHERE a = b UNION ALL SELECT a::BIGINT, b::BIGINT, 'level-inversion' FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE a <> b AND y.n_regionkey > x.n_regionkey""")
def dependency_levels(t):
    """Edges between nations that break the order of levels; cycles are left to the fixture tests."""
    lines = t("lineitem").where("l_quantity >= 50 and l_discount = 0.1 and l_returnflag = 'R'").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = lines.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).distinct()
    nodes = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("level"))
    return graph.dependency_problems(nodes, edges).where("problem <> 'cycle'")
