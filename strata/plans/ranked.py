"""Top-k, budgets, windows, and joins by range, prefix and symbol over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import joins, ranking
from strata.plans.catalog import query


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 6")
def part_top_per_brand(t):
    return ranking.top_per_group(t("part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 6).select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS w FROM part QUALIFY w <= 2)
SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM c QUALIFY rank <= 6""")
def diverse_parts(t):
    """Six parts a brand, two of each type at most."""
    rows = ranking.diverse_top(t("part"), ["p_brand"], ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")])
    return rows.select("p_brand", "p_type", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_name, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_size DESC, p_partkey) = 1")
def first_identities(t):
    return ranking.keep_first(t("part"), ["p_name", "p_type"], [F.desc("p_size"), F.asc("p_partkey")]).select("p_name", "p_type", "p_partkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def global_order_rank(t):
    """Ranks of all orders without a single-task sort."""
    return ranking.global_rank(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""
WITH RECURSIVE r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS i FROM part),
f AS (SELECT p_brand, p_partkey, i, p_size <= 200 AS kept, CASE WHEN p_size <= 200 THEN p_size ELSE 0 END AS used FROM r WHERE i = 1
  UNION ALL SELECT r.p_brand, r.p_partkey, r.i, f.used + r.p_size <= 200, CASE WHEN f.used + r.p_size <= 200 THEN f.used + r.p_size ELSE f.used END FROM f JOIN r ON r.p_brand = f.p_brand AND r.i = f.i + 1)
SELECT p_brand, p_partkey FROM f WHERE kept""")
def budgeted_parts(t):
    """Parts of a brand by price as long as their sizes fit 200; one that doesn't fit is passed over."""
    rows = t("part").select("p_brand", "p_retailprice", "p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return ranking.budget_skip(rows, ["p_brand"], ["p_retailprice", "p_partkey"], "p_size", 200).select("p_brand", "p_partkey")


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS s FROM part) x WHERE s <= 200")
def prefix_parts(t):
    return ranking.budget_stop(t("part"), ["p_brand"], ["p_retailprice", "p_partkey"], "p_size", 200).select("p_brand", "p_partkey")


@query("SELECT event_id, 0.05::DOUBLE / row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS bonus FROM events")
def recency_bonus(t):
    return ranking.position_bonus(t("events"), ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("event_id", "bonus")


@query("""
WITH q AS (SELECT item_id AS query_id, list_distinct(list_transform(regexp_extract_all(CASE WHEN item_id % 25 = 0 THEN '' ELSE text END, '[A-Za-z0-9_./:-]{2,}'), lambda x: lower(x))) AS qt FROM benchmark),
m AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'semantic' ELSE 'episodic' END AS scope, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE (n_chars % 97) / 97.0::DOUBLE END::DOUBLE AS importance, n_chars AS created_at,
  list_distinct(list_concat(CASE WHEN doc_id % 2 = 0 THEN [lang, 'the'] ELSE [] END, list_transform(regexp_extract_all(text, '[A-Za-z0-9_./:-]{2,}'), lambda x: lower(x)))) AS mt FROM documents),
i AS (SELECT *, row_number() OVER (ORDER BY importance DESC, created_at DESC, id) AS i FROM m QUALIFY i <= 200),
p AS (SELECT query_id, id, scope, created_at, len(list_intersect(qt, mt)) AS shared, len(qt) AS nq, len(mt) AS nm, importance, i FROM q, i),
s AS (SELECT query_id, id, created_at, 0.55::DOUBLE * shared / greatest(nq, 1) + 0.15::DOUBLE * shared / greatest(nm, 1) + 0.25::DOUBLE * importance + 0.05::DOUBLE / i AS score FROM p WHERE nq = 0 OR shared > 0 OR scope = 'semantic')
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at, id) AS rank FROM s QUALIFY rank <= 6""")
def memory_recall(t):
    """For each benchmark item, some of them without text, the six best of two hundred memories by shared terms, keywords, importance and scope."""
    d = F.col("doc_id")
    memories = t("documents").select(
        d.alias("id"), F.when(d % 9 == 0, "semantic").otherwise("episodic").alias("scope"), F.col("text").alias("content"), F.when(d % 2 == 0, F.array("lang", F.lit("the"))).alias("keywords"),
        F.when(d % 5 == 0, F.lit(0.5)).otherwise((F.col("n_chars") % 97) / 97.0).alias("importance"), F.col("n_chars").alias("created_at"),
    )
    queries = t("benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 25 == 0, "").otherwise(F.col("text")).alias("text"))
    return ranking.recall(memories, queries).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS s, strlen(ls[i]) + 1 AS n FROM d, unnest(range(1, len(ls) + 1)) u(i)),
w AS (SELECT doc_id, i, n AS used, i AS first_line FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN w.used + l.n > 2000 THEN l.n ELSE w.used + l.n END, CASE WHEN w.used + l.n > 2000 THEN l.i ELSE w.first_line END FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT w.doc_id, w.first_line::BIGINT AS first_line, string_agg(l.s, chr(10) ORDER BY l.i) AS body FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i GROUP BY ALL""")
def packed_lines(t):
    """Whole lines in windows of two thousand bytes."""
    return ranking.line_windows(t("documents"), "doc_id", "text", 2000)


@query("""
SELECT 's' || s_suppkey AS key, CASE WHEN 1000 - s_nationkey * 40 > 500 THEN 'ttl' ELSE 'lru' END AS reason FROM
 (SELECT *, coalesce(sum(CASE WHEN 1000 - s_nationkey * 40 > 500 THEN 0 ELSE sz END) OVER (ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(CASE WHEN 1000 - s_nationkey * 40 > 500 THEN 0 ELSE sz END) OVER () AS tot
  FROM (SELECT *, (100 + s_nationkey)::BIGINT AS sz FROM supplier)) WHERE 1000 - s_nationkey * 40 > 500 OR tot - b > 2000""")
def evicted_entries(t):
    """Suppliers as cache entries: old ones go, then the least recently used until two thousand units remain."""
    entries = t("supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), (F.lit(100) + F.col("s_nationkey")).cast("long").alias("size"), (F.col("s_nationkey") * 40).alias("created_at"),
        F.struct("s_acctbal", "s_suppkey").alias("last_access"), F.lit(False).alias("pinned"),
    )
    return ranking.evict(entries, F.lit(1000), 500, 2000)


@query("""
(SELECT l_orderkey, l_linenumber, l_partkey, 'row' AS kind FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50)
UNION ALL SELECT NULL, NULL, count(*) - 50, 'gap' FROM lineitem""")
def capped_lines(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", F.lit("row").alias("kind"))
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    null = lambda kind: F.lit(None).cast(kind)
    gap = lambda n: F.struct(null("long").alias("l_orderkey"), null("int").alias("l_linenumber"), n.cast("long").alias("l_partkey"), null("double").alias("l_extendedprice"), null("long").alias("l_suppkey"), F.lit("gap").alias("kind"))
    return ranking.capped_with_gap(rows, order, 50, gap).select("l_orderkey", "l_linenumber", "l_partkey", "kind")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000000)::BIGINT AS at FROM events) SELECT p.event_id AS purchase_id, c.event_id AS click_id, abs(p.at - c.at)::BIGINT AS distance
FROM e p JOIN e c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click' AND abs(p.at - c.at) <= 3600""")
def near_events(t):
    """Clicks within an hour of a purchase of the same user: a range join in bins of time."""
    e = t("events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("at"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("at").alias("from"), F.col("at").alias("to"))
    rows = joins.range_join(e.where("event_type = 'purchase'"), clicks, ["user_id"], "at", "from", "to", 3600, 7200)
    return rows.select(F.col("event_id").alias("purchase_id"), "click_id", F.col("distance").cast("long").alias("distance"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000000)::BIGINT AS at FROM events)
SELECT x.event_id, y.event_id AS session_id FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_type = 'error' AND y.event_type = 'signup' AND x.at BETWEEN y.at AND y.at + 86400
QUALIFY row_number() OVER (PARTITION BY x.event_id ORDER BY y.at, y.event_id) = 1""")
def first_covering_session(t):
    """For each error the earliest sign-up day of its user that covers it."""
    e = t("events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("at"))
    days = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session_id"), F.col("at").alias("from"), (F.col("at") + 86400).alias("to"), F.struct("at", "event_id").alias("seq"))
    return joins.first_covering(e.where("event_type = 'error'"), days, ["user_id"], "at", "from", "to", "seq").select("event_id", "session_id")


@query("""
WITH a AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS path, CASE WHEN s_acctbal > 5000 THEN '' ELSE 'ns::f' || s_suppkey % 7 END AS symbol, (s_suppkey % 50)::BIGINT AS line FROM supplier),
b AS (SELECT c_custkey AS other, 'n' || c_nationkey AS path, CASE WHEN c_acctbal > 5000 THEN '' ELSE 'f' || c_custkey % 7 END AS symbol, (c_custkey % 50)::BIGINT AS line FROM customer)
SELECT a.id, b.other FROM a JOIN b ON a.path = b.path AND CASE WHEN a.symbol <> '' AND b.symbol <> '' THEN a.symbol = b.symbol OR a.symbol LIKE '%::' || b.symbol OR b.symbol LIKE '%::' || a.symbol
  WHEN a.symbol = '' AND b.symbol = '' THEN abs(a.line - b.line) <= 3 ELSE false END""")
def symbol_or_near(t):
    name = lambda balance, text: F.when(F.col(balance) > 5000, "").otherwise(text)
    a = t("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("path"), name("s_acctbal", F.concat(F.lit("ns::f"), (F.col("s_suppkey") % 7).cast("string"))).alias("symbol"), (F.col("s_suppkey") % 50).alias("line"))
    b = t("customer").select(F.col("c_custkey").alias("other"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("path"), name("c_acctbal", F.concat(F.lit("f"), (F.col("c_custkey") % 7).cast("string"))).alias("symbol"), (F.col("c_custkey") % 50).alias("line"))
    return joins.symbol_or_near(a, b).select("id", "other")


@query("""
WITH f AS (SELECT p_partkey AS finding_id, p_brand AS component, p_type || '/' || p_name AS path FROM part), i AS (SELECT 'ISSUE-' || n_nationkey AS cve_id, 'Brand#' || n_nationkey AS component, CASE WHEN n_regionkey = 0 THEN 'SMALL/*' WHEN n_regionkey = 1 THEN '*/red ?i*' ELSE '[EP]*/*' END AS g FROM nation)
SELECT f.finding_id, coalesce(string_agg(DISTINCT i.cve_id, ',' ORDER BY i.cve_id), '') AS cve_ids FROM f LEFT JOIN i ON (starts_with(f.component, i.component) OR starts_with(i.component, f.component)) AND f.path GLOB i.g GROUP BY f.finding_id""")
def known_issue_matches(t):
    """Parts against an index by mutual prefix of the brand and globs of the path."""
    findings = t("part").select(F.col("p_partkey").alias("finding_id"), F.col("p_brand").alias("component"), F.concat_ws("/", "p_type", "p_name").alias("path"), F.lit(None).cast("array<string>").alias("window"))
    glob = F.when(F.col("n_regionkey") == 0, "SMALL/*").when(F.col("n_regionkey") == 1, "*/red ?i*").otherwise("[EP]*/*")
    key = F.col("n_nationkey").cast("string")
    index = t("nation").select(F.concat(F.lit("ISSUE-"), key).alias("cve_id"), F.concat(F.lit("Brand#"), key).alias("component"), F.array(glob).alias("affected_paths"), F.lit("").alias("introduced_commit"), F.lit("").alias("fixed_commit"))
    return joins.match_cves(findings, index).select("finding_id", F.array_join("cve_ids", ",").alias("cve_ids"))


@query("""
WITH e AS (SELECT DISTINCT n_name AS path, r_name AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <= 2)
SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE EXISTS (SELECT 1 FROM e WHERE e.path = n_name AND (r_name || '.' || c_mktsegment = e.symbol OR starts_with(r_name || '.' || c_mktsegment, e.symbol || '.')))""")
def hierarchy_matches(t):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("path"), "r_name", "r_regionkey")
    found = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "path", F.concat_ws(".", "r_name", "c_mktsegment").alias("symbol"))
    return joins.hierarchy_semi(found, places.where("r_regionkey <= 2").select("path", F.col("r_name").alias("symbol"))).select("c_custkey")


@query("""
WITH b AS (SELECT item_id, trim(string_split(text, chr(10))[1]) AS q FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents)
SELECT b.item_id, count(DISTINCT l.doc_id) AS docs FROM b JOIN l ON b.q = l.s WHERE b.q <> '' GROUP BY b.item_id""")
def quoted_items(t):
    """Documents that have a benchmark item's first line as a line of their own."""
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    items = t("benchmark").select("item_id", F.trim(F.split("text", "\n")[0]).alias("line")).where("line <> ''")
    return lines.join(items, "line").groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"))
