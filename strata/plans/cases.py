"""Cases, manifests, indexes, imports, evictions, redactions and consumed streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import dataflow, graph, joins, lookups, privacy, ranking
from strata.plans.catalog import query
from strata.plans.proofs import _diffs, _folder
from strata.sources import datasets, diffs, sinks
from strata.streaming import delivery


@query("""
WITH c AS (SELECT c_custkey AS i, c_custkey % 4 AS form FROM customer)
SELECT 'r' || i AS project, CAST(CASE form WHEN 0 THEN 2 ELSE 3 END AS INTEGER) AS line, CASE form WHEN 3 THEN 'pkg/tool.py' ELSE 'tool.py' END AS to_path FROM c WHERE form IN (0, 3)
UNION ALL SELECT 'r' || i, 4, 'main.py' FROM c WHERE form = 1""")
def resolved_imports(t):
    """Calls of imported functions: by name, by a module's alias, of a name that the file defines anew, and of a module that two files claim."""
    i, form = F.col("c_custkey"), F.col("c_custkey") % 4
    project = F.concat(F.lit("r"), i.cast("string")).alias("project")
    main = (
        F.when(form == 0, "from tool import go as run\nrun(1)\n").when(form == 1, "from tool import go\ndef go(v):\n    return v\ngo(1)\n").when(form == 2, "import tool as t\nt.go(1)\n").otherwise("import os\nimport pkg.tool as t\nt.go(os)\nos.go(1)\n")
    )
    rows = t("customer")
    files = rows.select(project, F.lit("main.py").alias("path"), main.alias("text"))
    body = F.lit("def go(v):\n    return v\n").alias("text")
    files = files.unionByName(rows.select(project, F.when(form == 3, "pkg/tool.py").otherwise("tool.py").alias("path"), body)).unionByName(rows.where(form == 2).select(project, F.lit("tool/__init__.py").alias("path"), body))
    return dataflow.resolved_calls(graph.cut(dataflow.flows(files))).select("project", "line", "to_path")


@query("""
WITH f AS (SELECT p_partkey AS finding_id, p_brand AS component, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ['c' || p_partkey % 5, 'c' || p_size % 5] END AS w FROM part),
i AS (SELECT 'ISSUE-' || n_nationkey AS cve_id, 'Brand#' || n_nationkey AS component, CASE WHEN n_nationkey % 2 = 0 THEN 'c' || n_nationkey % 5 ELSE '' END AS a, CASE WHEN n_nationkey % 7 > 2 THEN 'c' || (n_nationkey + 1) % 5 ELSE '' END AS b FROM nation)
SELECT f.finding_id, coalesce(string_agg(DISTINCT i.cve_id, ',' ORDER BY i.cve_id), '') AS cve_ids FROM f
LEFT JOIN i ON (starts_with(f.component, i.component) OR starts_with(i.component, f.component)) AND (f.w IS NULL OR (a = '' AND b = '') OR list_contains(w, a) OR list_contains(w, b)) GROUP BY f.finding_id""")
def issue_windows(t):
    """Parts against an index whose entries name commits, some of one side or of none, by windows that are known for most parts."""
    k, n = F.col("p_partkey"), F.col("n_nationkey")
    commit = lambda c: F.concat(F.lit("c"), (c % 5).cast("string"))
    findings = t("part").select(k.alias("finding_id"), F.col("p_brand").alias("component"), F.lit("src/a.c").alias("path"), F.when(k % 3 != 0, F.array(commit(k), commit(F.col("p_size")))).alias("window"))
    index = t("nation").select(
        F.concat(F.lit("ISSUE-"), n.cast("string")).alias("cve_id"), F.concat(F.lit("Brand#"), n.cast("string")).alias("component"), F.array(F.lit("src/*")).alias("affected_paths"), F.when(n % 2 == 0, commit(n)).otherwise("").alias("introduced_commit"),
        F.when(n % 7 > 2, commit(n + 1)).otherwise("").alias("fixed_commit"),
    )
    return joins.match_cves(findings, index).select("finding_id", F.array_join("cve_ids", ",").alias("cve_ids"))


@query("""
WITH e AS (SELECT c_custkey AS key, (100 + c_nationkey)::BIGINT AS sz, 1000 - c_nationkey * 40 > 500 AND c_custkey % 5 <> 0 AS ttl, c_custkey % 5 = 0 AS pinned, c_acctbal AS used FROM customer),
t AS (SELECT sum(sz) FILTER (WHERE NOT ttl) AS total, sum(sz) FILTER (WHERE ttl) AS freed FROM e),
l AS (SELECT key, coalesce(sum(sz) OVER (ORDER BY used, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e WHERE NOT ttl AND NOT pinned)
SELECT key, 'ttl' AS reason FROM e WHERE ttl UNION ALL SELECT key, 'lru' FROM l, t WHERE total - b > 5000 OR 300 + freed + b < 9000""")
def pinned_evictions(t):
    """Customers as cache entries, every fifth pinned: old ones go, then the least recently used until quota and free space hold."""
    entries = t("customer").select(
        F.col("c_custkey").alias("key"), (F.lit(100) + F.col("c_nationkey")).cast("long").alias("size"), (F.col("c_nationkey") * 40).alias("created_at"), F.struct("c_acctbal", "c_custkey").alias("last_access"), (F.col("c_custkey") % 5 == 0).alias("pinned"),
    )
    return ranking.evict(entries, F.lit(1000), 500, 5000, free=300, floor=9000)


@query("SELECT user_id, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def consumed_events(t):
    """Events drained as a stream into a writer that may repeat a batch, counted from what it wrote."""
    e = t("events").select("event_id", "user_id", "event_type", "value")
    folder = _folder(e, "stream")
    e.repartition(3).write.parquet(f"{folder}/in")
    spark = e.sparkSession
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    write = delivery.write_once(f"{folder}/out")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    delivery.run_to_end(stream, twice, f"{folder}/progress")
    return spark.read.parquet(f"{folder}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query("""
SELECT l_orderkey AS case_id, 'f' || l_linenumber AS path, l_quantity::BIGINT AS start_line FROM lineitem x
WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber % 3 = x.l_linenumber % 3 AND y.l_partkey % 60 BETWEEN x.l_quantity::BIGINT AND x.l_quantity::BIGINT + 15 AND 'f' || y.l_linenumber = 'f' || x.l_linenumber)""")
def uncovered_cases(t):
    """Expected ranges that cover no added line of their file."""
    l, path = t("lineitem"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path")
    start = F.col("l_quantity").cast("long")
    expected = l.select(F.col("l_orderkey").alias("case_id"), path, start.alias("start_line"), (start + 15).alias("end_line"))
    added = l.select(F.col("l_orderkey").alias("case_id"), path, (F.col("l_partkey") % 60).alias("line"))
    return joins.uncovered_cases(expected, added).select("case_id", "path", "start_line")


@query("""
SELECT 'pair-' || o_orderkey AS id, 'CWE-' || (400 + o_custkey % 30) AS cwe, o_orderkey % 3 + 1 AS n_paths, sha256('fixed' || o_orderkey) AS fixed_archive FROM orders""")
def paired_manifests(t):
    """Pairs of commits written as JSON and read under their rules: distinct commits, digests of archives, paths, unique ids."""
    k = F.col("o_orderkey")
    key = k.cast("string")
    text = lambda p: F.concat(F.lit(p), key)
    none = F.array().cast("array<string>")
    rows = t("orders").select(
        text("pair-").alias("id"), text("CVE-2024-").alias("cve"), F.lit("").alias("ghsa"), F.concat(F.lit("CWE-"), (400 + F.col("o_custkey") % 30).cast("string")).alias("cwe"), F.lit("repo").alias("repository"), text("a").alias("vulnerable_commit"),
        text("b").alias("fixed_commit"), F.sha2(text("broken"), 256).alias("vulnerable_archive_sha256"), F.sha2(text("fixed"), 256).alias("fixed_archive_sha256"), F.array_repeat(F.lit("src/a.c"), (k % 3 + 1).cast("int")).alias("ground_truth_paths"),
        none.alias("ground_truth_symbols"), F.lit("patch").alias("expected_repair_policy"), F.struct(F.lit("tests").alias("kind"), none.alias("tests"), F.lit(True).alias("automated"), F.lit("").alias("reason")).alias("oracle"), none.alias("sources"),
    )
    path = _folder(rows, "pairs")
    rows.write.json(path)
    found = datasets.read_pairs(rows.sparkSession, path, lines=True)
    return found.select("id", "cwe", F.size("ground_truth_paths").cast("long").alias("n_paths"), F.col("fixed_archive_sha256").alias("fixed_archive"))


@query("SELECT p_brand AS component, count(*) AS entries, count(*) FILTER (WHERE p_partkey % 4 = 0) AS unknown FROM part GROUP BY p_brand")
def issue_index(t):
    """An index of issues written as JSON and read under its closed fields; an empty commit is an unknown one."""
    key = F.col("p_partkey").cast("string")
    rows = t("part").select(
        F.concat(F.lit("CVE-"), key).alias("cve_id"), F.col("p_brand").alias("component"), F.array(F.lit("src/*")).alias("affected_paths"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(key).alias("introduced_commit"), F.lit("").alias("fixed_commit"),
        F.col("p_name").alias("summary"),
    )
    path = _folder(rows, "issues")
    rows.write.json(path)
    return datasets.read_issue_index(rows.sparkSession, path, lines=True).groupBy("component").agg(F.count("*").alias("entries"), F.count_if(F.col("introduced_commit") == "").alias("unknown"))


@query("""
WITH v AS (SELECT l_partkey AS entity, CASE WHEN l_linenumber % 2 = 0 THEN 'size' ELSE 'name' END AS field, CASE WHEN l_returnflag = 'N' THEN 'null' ELSE l_suppkey::VARCHAR END AS value, l_orderkey AS priority, l_orderkey || '-' || l_linenumber AS pointer FROM lineitem),
w AS (SELECT p_partkey AS entity, unnest(['size', 'name', 'color']) AS field FROM part),
g AS (SELECT entity, field, arg_min(value, (priority, pointer)) AS value, string_agg(pointer, ' ' ORDER BY priority, pointer) AS sources FROM v GROUP BY ALL)
SELECT w.entity, w.field, g.value, coalesce(g.sources, '') AS sources, CASE WHEN g.entity IS NULL THEN 'not stated' WHEN g.value = 'null' THEN 'stated as null' END AS note FROM w LEFT JOIN g ON w.entity = g.entity AND w.field = g.field""")
def projected_fields(t):
    """Fields of parts as the first line that states them does (of lines with one number, the first in the table), with all that do, and why others have none."""
    l = t("lineitem").select(
        F.col("l_partkey").alias("entity"), F.when(F.col("l_linenumber") % 2 == 0, "size").otherwise("name").alias("field"), F.when(F.col("l_returnflag") == "N", "null").otherwise(F.col("l_suppkey").cast("string")).alias("value"), F.col("l_orderkey").alias("priority"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("pointer"), F.struct("_metadata.file_path", "_metadata.row_index").alias("nth"),
    )
    wanted = t("part").select(F.col("p_partkey").alias("entity"), F.explode(F.lit(["size", "name", "color"])).alias("field"))
    return lookups.projected_fields(l, wanted, tie="nth").select("entity", "field", "value", F.array_join("sources", " ").alias("sources"), "note")


@query(f"""
SELECT doc_id, regexp_replace('é ' || x || ' ' || substr(text, 1, 300), '{privacy.BASE64_SPAN}', '[REDACTED]', 'g') AS text, 1 + len(regexp_extract_all(substr(text, 1, 300), '{privacy.BASE64_SPAN}')) AS marks FROM (SELECT *, sha256('s' || doc_id) AS x FROM documents) WHERE text <> ''""")
def redacted_texts(t):
    """Texts with a long run before them, each run replaced by its tenant's fingerprint (shown without it)."""
    text = F.concat(F.lit("é "), F.sha2(F.concat(F.lit("s"), F.col("doc_id").cast("string")), 256), F.lit(" "), F.substring("text", 1, 300))
    rows = t("documents").where("text <> ''").select("doc_id", privacy.redacted(text, "tenant", b"key").alias("text"))
    mark = r"\[REDACTED:[0-9a-f]{32}\]"
    return rows.select("doc_id", F.regexp_replace("text", mark, "[REDACTED]").alias("text"), F.regexp_count("text", F.lit(mark)).cast("long").alias("marks"))


@query("SELECT event_type, 2 * count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def appended_rows(t):
    """Rows appended twice to a table."""
    e = t("events").select("event_id", "event_type")
    folder = _folder(e, "appended")
    sinks.append(e, folder)
    sinks.append(e, folder)
    return e.sparkSession.read.parquet(folder).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("""
SELECT doc_id, unnest([2, 3]) AS diff_line, unnest(['--- a/src/' || doc_id || '.py', '+++ b/src/' || doc_id || '.py' || chr(9) || '2024']) AS content FROM documents WHERE doc_id % 3 = 0""")
def diff_search(t):
    """The lines of diffs that name a folder, whatever the case."""
    found = diffs.search_diff(_diffs(t).where("doc_id % 3 = 0"), " SRC/ ", 50, "doc_id")
    return found.withColumn("diff_line", F.col("diff_line").cast("long"))


@query("""
SELECT doc_id AS id, 'src/' || doc_id || '.py' AS path, doc_id % 90 + 2 + k AS line, k = 0 AS found FROM documents, unnest([0, 40]) u(k)""")
def asked_lines(t):
    """Lines that a diff adds, and lines that it doesn't."""
    rows = _diffs(t).withColumnRenamed("doc_id", "id")
    asked = rows.select("id", F.concat(F.lit("src/"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.explode(F.array(F.lit(0), F.lit(40))).alias("k")).withColumn("line", F.col("id") % 90 + 2 + F.col("k")).drop("k")
    return diffs.changed_line(asked, diffs.added_lines(rows)).select("id", "path", "line", "found")
