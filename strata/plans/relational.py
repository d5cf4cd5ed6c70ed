"""Dashboards, point reads and set comparisons over the task-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import joins, metrics, ranking, state
from strata.plans.catalog import query


@query("""
SELECT o_orderstatus, count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS failed, coalesce(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / nullif(count(*), 0), 0.0) AS failure_rate,
  count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus""")
def status_dashboard(t):
    bad = F.col("o_orderpriority") == "1-URGENT"
    return t("orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("total"), F.count_if(bad).alias("failed"), metrics.ratio(F.count_if(bad), F.count("*"), 0.0).alias("failure_rate"), F.count_distinct("o_custkey").alias("customers")
    )


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def latest_orders(t):
    return ranking.latest(t("orders"), "o_orderdate", "o_orderkey", 500).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("""
SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderstatus = 'F' AND c.c_mktsegment = 'BUILDING'""")
def failures_of_tenant(t):
    """Child rows with their parents' columns; both filters reach the scans."""
    failed = state.optional_filters(t("orders"), o_orderstatus="F", o_orderpriority=None)
    tenants = state.optional_filters(t("customer"), c_mktsegment="BUILDING")
    joined = failed.join(tenants, failed.o_custkey == tenants.c_custkey).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.select("o_orderkey", "c_name", "n_name")


@query("""
SELECT c_custkey, c_acctbal > 5000 AS flagged FROM customer c
WHERE c_acctbal > 5000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
def active_or_referenced(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    rows = t("customer").join(urgent, "c_custkey", "left").where((F.col("c_acctbal") > 5000) | F.col("hit"))
    return rows.select("c_custkey", (F.col("c_acctbal") > 5000).alias("flagged"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1998-01-01')")
def scoped_unexpired(t):
    scoped = t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return state.purge(scoped, F.lit("1998-01-01").cast("timestamp"), "o_orderdate").select("o_orderkey", "o_orderpriority")


@query("""
SELECT o.o_orderkey, count(l.l_orderkey) AS n_lines, coalesce(string_agg(CAST(l.l_linenumber AS VARCHAR) || ':' || l.l_returnflag, ',' ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag), '') AS lines
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def tasks_with_children(t):
    child = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = joins.parent_with_children(t("orders").select("o_orderkey"), "o_orderkey", items=(child, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]))
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ",")
    return rows.select("o_orderkey", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(text, F.lit("")).alias("lines"))


@query("""
SELECT coalesce(o.lang, n.lang) AS lang, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change, count(*) AS n
FROM (SELECT lang, md5(text) AS d, min(doc_id) AS doc_id FROM documents WHERE source = 'src0' GROUP BY ALL) o FULL OUTER JOIN (SELECT lang, md5(text) AS d, min(doc_id) AS doc_id FROM documents WHERE source <> 'src0' GROUP BY ALL) n
  ON o.lang = n.lang AND o.d = n.d GROUP BY ALL""")
def snapshot_changes(t):
    """Texts of one source against all others as two snapshots: what came, went or changed its digest."""
    docs = t("documents").select(F.concat_ws("/", "lang", F.md5("text")).alias("path"), "lang", "source", F.when(F.col("source") == "src0", F.sha2("source", 256)).otherwise("x").alias("sha256"))
    old, new = docs.where("source = 'src0'").dropDuplicates(["path"]), docs.where("source <> 'src0'").dropDuplicates(["path"])
    return joins.snapshot_diff(old, new).select(F.substring_index("path", "/", 1).alias("lang"), "change").groupBy("lang", "change").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT l_orderkey AS s, l_partkey AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), a AS (SELECT l_orderkey AS s, l_partkey AS e FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT coalesce(d.s, a.s) AS subject_id, coalesce(d.e, a.e) AS evidence_id, CASE WHEN a.s IS NULL THEN 'declared-only' ELSE 'undeclared' END AS problem
FROM d FULL OUTER JOIN a ON d.s = a.s AND d.e = a.e WHERE d.s IS NULL OR a.s IS NULL""")
def reference_integrity(t):
    """Declared against actual references, both ways."""
    lines = t("lineitem").select(F.col("l_orderkey").alias("subject_id"), F.col("l_partkey").alias("evidence_id"), "l_returnflag", "l_linestatus")
    declared = lines.where("l_returnflag = 'R'").groupBy("subject_id").agg(F.collect_set("evidence_id").alias("evidence_ids"))
    return joins.dangling_references(declared, lines.where("l_linestatus = 'F'").select("subject_id", "evidence_id"))


@query("""
SELECT coalesce(s.s_suppkey, -1) AS s_suppkey, l.l_orderkey, l.l_linenumber, coalesce(s.s_name, 'needs_review') AS disposition
FROM (SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49) l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0""")
def verdicts_with_default(t):
    verdicts = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("disposition"))
    rows = joins.with_default(t("lineitem").where("l_quantity >= 49").select("l_suppkey", "l_orderkey", "l_linenumber"), verdicts, ["l_suppkey"], "seq", "disposition", "needs_review")
    return rows.select(F.when(F.col("disposition") == "needs_review", F.lit(-1)).otherwise(F.col("l_suppkey")).cast("long").alias("s_suppkey"), "l_orderkey", "l_linenumber", "disposition")


@query("""
WITH m AS (SELECT p_name AS alias, min(p_partkey) AS symbol FROM part GROUP BY p_name HAVING count(*) = 1) SELECT l.l_orderkey, l.l_linenumber, m.symbol
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN m ON m.alias = p.p_name""")
def unambiguous_imports(t):
    """Uses resolved by names that one row alone has."""
    uses = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("alias"), "l_orderkey", "l_linenumber")
    return joins.resolve_imports(uses, t("part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("symbol"))).select("l_orderkey", "l_linenumber", "symbol")


@query("""
WITH v AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT p_brand, count(*) AS parts, count(v.l_partkey) AS in_truth FROM part LEFT JOIN v ON v.l_partkey = p_partkey GROUP BY p_brand""")
def ground_truth_semi(t):
    truth = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    part = t("part").select("p_brand", "p_partkey")
    hit = part.join(truth, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("in_truth"))
    return part.groupBy("p_brand").agg(F.count("*").alias("parts")).join(hit, "p_brand", "left").withColumn("in_truth", F.coalesce("in_truth", F.lit(0)))
