"""Use-after-release candidates and their proofs, ancestry, diffs, inventories, readers, writers and deliveries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import graph, metrics, proving, python_facts, state
from strata.plans.catalog import query
from strata.sources import corpus, datasets, diffs, sinks
from strata.streaming import delivery

# Each order is a function: an allocation at line 10, an alias copy p to q at 15, a release at 20, a copy q to s at 25, a rebind of q
# at 27, a restart of p at 28 and a use at 30, each only for some orders; thirty units hold them.
_O = "o AS (SELECT o_orderkey AS k, o_custkey % 30 AS u FROM orders)"
_BOUND = "CASE WHEN k % 7 = 0 THEN k % 4 <> 0 AND k % 6 = 0 WHEN k % 2 = 1 THEN k % 4 <> 0 ELSE true END"
_TARGET = "CASE WHEN k % 7 = 0 THEN 's' WHEN k % 2 = 1 THEN 'q' ELSE 'p' END"
_FOUND = f"c AS (SELECT *, CASE WHEN k % 17 = 0 THEN '' ELSE 'f' || k END AS fn, {_TARGET} AS target, 'u' || u AS unit, sha256('src/' || u || '.c' || '|' || CASE WHEN k % 17 = 0 THEN '' ELSE 'f' || k END || '|a' || k || '|r' || k || '|d' || k) AS candidate_id FROM o WHERE k % 19 <> 0 AND {_BOUND})"


def _facts(t) -> DataFrame:
    o = t("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 30).alias("u"))
    key = F.col("k").cast("string")
    name = lambda p: F.concat(F.lit(p), key)
    none = F.lit(None).cast("string")
    api = F.element_at(F.lit(["malloc", "new", "pool_get", "", "calloc"]), (F.col("k") % 5 + 1).cast("int"))

    def fact(id_, kind, line, pointer, when=None, related=None, source=none, api_=none, block=1):
        columns = [
            name(id_).alias("fact_id"), F.lit(kind).alias("kind"), F.concat(F.lit("u"), F.col("u").cast("string")).alias("translation_unit"), F.concat(F.lit("src/"), F.col("u").cast("string"), F.lit(".c")).alias("canonical_path"),
            F.when(F.col("k") % 17 == 0, "").otherwise(name("f")).alias("function_usr"), F.struct(F.lit(line).alias("start"), F.lit(line).alias("end")).alias("source_range"), pointer.alias("pointer_id"),
            (F.array() if related is None else F.array(related)).cast("array<string>").alias("related_fact_ids"), api_.alias("api"), source.alias("source_pointer_id"), F.lit(block).cast("int").alias("cfg_block") if isinstance(block, int) else block.cast("int").alias("cfg_block"),
        ]
        return (o if when is None else o.where(when)).select(*columns)

    used = F.when(F.col("k") % 7 == 0, name("s")).when(F.col("k") % 2 == 1, name("q")).otherwise(name("p"))
    parts = [
        fact("a", "allocation", 10, name("p"), api_=api), fact("e", "alias-copy", 15, name("q"), "k % 4 <> 0", source=name("p")),
        fact("r", "release", 20, F.when(F.col("k") % 3 == 0, name("q")).otherwise(name("p")), related=F.when(F.col("k") % 19 == 0, F.lit("x")).otherwise(name("a"))),
        fact("g", "alias-copy", 25, name("s"), "k % 6 = 0", source=name("q")), fact("b", "rebind", 27, name("q"), "k % 5 = 0", source=name("z")), fact("l", "lifetime-restart", 28, name("p"), "k % 13 = 0"),
        fact("d", "dereference", 30, used, block=F.col("k") % 11 % 3), fact("i", "points-to", 12, name("w"), "u = 0 and k % 50 = 0"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_O}, {_FOUND} SELECT candidate_id, fn AS function_usr, 'p' || k AS root, target || k AS target FROM c")
def release_candidates(t):
    """Uses after release whose pointer is the released one, or reached from it by copies made before the use."""
    return graph.candidates(_facts(t)).select("candidate_id", "function_usr", "root", "target")


@query(f"WITH {_O}, {_FOUND} SELECT (SELECT count(DISTINCT u) FROM o) AS tu_count, (SELECT count(*) FROM o) AS allocation_count, (SELECT count(*) FROM c) AS pair_count, (SELECT count(*) FROM o WHERE k % 19 = 0) AS unattached_release_count")
def candidate_statistics(t):
    facts = _facts(t)
    return graph.generation_stats(facts, graph.candidates(facts))


_GAPPED = "(u % 5 = 0)"
_STATUSES = f"""{_O}, {_FOUND}, w AS (SELECT *, NOT bool_or(u = 0 AND k % 50 = 0) OVER (PARTITION BY u) AS ignored FROM o),
m AS (SELECT u, NOT bool_or(u = 0 AND k % 50 = 0) AS whole FROM o GROUP BY u),
s AS (SELECT candidate_id, unnest(['P1', 'P2', 'P3', 'P4', 'P5', 'P6', 'P7']) AS obligation, unnest([
  CASE WHEN k % 5 IN (0, 1, 4) AND fn <> '' THEN 'SATISFIED' ELSE 'UNKNOWN' END,
  CASE WHEN k % 3 <> 0 OR k % 4 <> 0 THEN 'SATISFIED' WHEN whole THEN 'REFUTED' ELSE 'UNKNOWN' END, 'SATISFIED', 'SATISFIED',
  CASE WHEN (u % 4 <> 0 AND NOT {_GAPPED} AND k % 11 % 3 < 1) OR u = 9 THEN 'REFUTED' WHEN u % 4 <> 0 AND NOT {_GAPPED} AND k % 11 % 3 = 1 THEN 'SATISFIED' ELSE 'UNKNOWN' END,
  CASE WHEN NOT whole THEN 'UNKNOWN' WHEN target = 'q' AND k % 5 = 0 THEN 'REFUTED' ELSE 'SATISFIED' END,
  CASE WHEN u % 7 = 0 THEN 'UNKNOWN' WHEN k % 13 = 0 THEN 'REFUTED' ELSE 'SATISFIED' END]) AS status FROM c JOIN m USING (u))"""


def _statuses(t) -> DataFrame:
    facts = _facts(t)
    u = F.col("u")
    gaps = F.array_compact(F.array(F.when(u % 5 == 0, F.lit("cfg-loop")), F.when(u % 7 == 0, F.lit("lifetime-restart")), F.when(u == 9, F.lit("clang-constant-unreachable"))))
    units = t("orders").select((F.col("o_custkey") % 30).alias("u")).distinct()
    coverage = units.select(F.concat(F.lit("u"), u.cast("string")).alias("translation_unit"), (u % 4 != 0).alias("cfg_complete"), gaps.alias("semantic_gaps"))
    return proving.proved(facts, graph.graph_complete(facts), coverage)


@query(f"WITH {_STATUSES} SELECT candidate_id, obligation, status FROM s")
def proof_obligations(t):
    """Seven three-valued obligations of each candidate, from facts, alias reach, coverage and its gaps."""
    return _statuses(t)


@query(f"WITH {_STATUSES} SELECT candidate_id, CASE WHEN bool_or(status = 'REFUTED') THEN 'REFUTED' WHEN bool_and(status = 'SATISFIED') THEN 'PASS' ELSE 'UNKNOWN' END AS verdict FROM s GROUP BY candidate_id")
def proof_verdicts(t):
    return graph.verdicts(_statuses(t))


@query("""
WITH RECURSIVE x(tip, node) AS (SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 100 = 1 UNION SELECT tip, node // 2 FROM x WHERE node > 0) SELECT tip, node FROM x""")
def commit_ancestry(t):
    """All commits that a tip contains, where a commit's parent has half its number."""
    o = t("orders").select(F.col("o_orderkey").alias("commit"))
    parents = o.where("commit > 0").select("commit", F.floor(F.col("commit") / 2).alias("parent"))
    return graph.ancestry(parents, o.where("commit % 100 = 1").select(F.col("commit").alias("tip"), "commit"))


def _diffs(t) -> DataFrame:
    i = F.col("doc_id").cast("string")
    at = (F.col("doc_id") % 90 + 1).cast("string")
    first = F.split("text", "\n")[0]
    text = F.concat(
        F.lit("diff --git a/x b/x\n--- a/src/"), i, F.lit(".py\n+++ b/src/"), i, F.lit(".py\t2024\n@@ -3,2 +"), at, F.lit(",4 @@ def f\n context\n+"), first, F.lit("\n-gone\n\\ No newline at end of file\n other\n+tail "), i,
        F.lit("\n@@ -50 +500 @@\n+far\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-old\n+++ b/new file\n@@ -0,0 +1,2 @@\n+one\n+two\n"),
    )
    return t("documents").select("doc_id", text.alias("diff"))


@query("""
WITH d AS (SELECT doc_id, 'src/' || doc_id || '.py' AS path, doc_id % 90 + 1 AS b, string_split(text, chr(10))[1] AS head FROM documents)
SELECT doc_id, path, b + 1 AS line, head AS content FROM d UNION ALL SELECT doc_id, path, b + 3, 'tail ' || doc_id FROM d UNION ALL SELECT doc_id, path, 500, 'far' FROM d UNION ALL SELECT doc_id, 'new file', 1, 'one' FROM d UNION ALL SELECT doc_id, 'new file', 2, 'two' FROM d""")
def diff_added_lines(t):
    """Lines that diffs add, with their places: context counts, removed lines and remarks don't, a removed file has none."""
    return diffs.added_lines(_diffs(t), "doc_id")


@query("SELECT doc_id, 'src/' || doc_id || '.py' AS path, 1 AS place FROM documents UNION ALL SELECT doc_id, 'new file', 2 FROM documents")
def diff_changed_files(t):
    changed = diffs.changed_files(_diffs(t), "doc_id")
    return changed.select("doc_id", "path", F.when(F.col("path") == "new file", 2).otherwise(1).alias("place"))


_BUDGET, _FILES = 40_000, 12


@query(f"""
WITH RECURSIVE f AS (SELECT source, CASE WHEN lang = 'en' THEN 'src/' WHEN lang = 'de' THEN 'docs/' ELSE 'pkg/' END || source || '/' || doc_id || '.py' AS path, strlen(text) AS size, text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN starts_with(path, 'docs/') THEN 2 WHEN starts_with(path, 'src/') THEN 0 ELSE 1 END, path) AS n FROM f WHERE size <= 9000),
w(source, n, path, used, kept, took) AS (SELECT source, n, path, CASE WHEN size <= {_BUDGET} THEN size ELSE 0 END, (size <= {_BUDGET})::INT, size <= {_BUDGET} FROM r WHERE n = 1 UNION ALL
  SELECT r.source, r.n, r.path, w.used + CASE WHEN w.used + r.size <= {_BUDGET} AND w.kept < {_FILES} THEN r.size ELSE 0 END, w.kept + (w.used + r.size <= {_BUDGET} AND w.kept < {_FILES})::INT, w.used + r.size <= {_BUDGET} AND w.kept < {_FILES} FROM w JOIN r ON r.source = w.source AND r.n = w.n + 1)
SELECT w.source, w.path, r.size, sha256(r.text) AS sha256, (len(string_split(r.text, chr(10))) - (r.text = '' OR ends_with(r.text, chr(10)))::INT)::BIGINT AS line_count FROM w JOIN r ON r.source = w.source AND r.n = w.n WHERE took""")
def bounded_inventory(t):
    """Admitted files of each source in priority order under a byte and a file budget; a file that doesn't fit is passed over."""
    folder = F.when(F.col("lang") == "en", "src").when(F.col("lang") == "de", "docs").otherwise("pkg")
    files = t("documents").select("source", F.concat_ws("/", folder, "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"))
    return corpus.inventory(files, _FILES, _BUDGET, 9000, "source", (".py",)).select("source", "path", "size", "sha256", "line_count")


@query("""
SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) FILTER (WHERE strlen(text) <= 2000) AS kept_files, coalesce(sum(strlen(text)) FILTER (WHERE strlen(text) <= 2000), 0)::BIGINT AS kept_bytes,
 count(*) FILTER (WHERE strlen(text) <= 2000) / count(*) AS file_coverage, coalesce(sum(strlen(text)) FILTER (WHERE strlen(text) <= 2000), 0) / sum(strlen(text)) AS byte_coverage FROM documents""")
def scan_coverage(t):
    files = t("documents").select(F.octet_length("text").cast("long").alias("size"))
    return corpus.coverage(files, files.where("size <= 2000"))


@query("SELECT 'x/' || doc_id AS path, text FROM documents WHERE doc_id % 3 = 0")
def verified_texts(t):
    """Texts whose digest is the inventoried one."""
    files = t("documents").select(F.concat(F.lit("x/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")
    return corpus.verified_text(files.drop("doc_id"), files.where("doc_id % 3 = 0").select("path", F.sha2("content", 256).alias("sha256")))


def _folder(df: DataFrame, name: str) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    graph.cut(df.limit(0))
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("""
SELECT 'case-' || o_orderkey AS id, 'repo' || (o_custkey % 5) AS repository, CASE WHEN o_orderkey % 4 = 0 THEN 'holdout' ELSE 'validation' END AS split, o_orderkey % 3 AS n_expected, CASE WHEN o_orderkey % 3 > 0 THEN 'src/a.py' END AS first_path FROM orders""")
def evaluation_cases(t):
    """Cases written as JSON lines and read under their schema."""
    k = F.col("o_orderkey")
    one = F.struct(F.lit("src/a.py").alias("path"), F.lit(3).alias("start_line"), F.lit(5).alias("end_line"), F.lit("CWE-89").alias("cwe"), F.lit("high").alias("severity"))
    rows = t("orders").select(
        F.concat(F.lit("case-"), k.cast("string")).alias("id"), F.concat(F.lit("repo"), (F.col("o_custkey") % 5).cast("string")).alias("repository"), k.alias("pull_request"), F.when(k % 4 == 0, "holdout").otherwise("validation").alias("split"),
        F.lit("").alias("diff"), F.struct(F.lit("synthetic").alias("kind")).alias("source"), F.array_repeat(one, (k % 3).cast("int")).alias("expected_findings"),
    )
    path = _folder(rows, "cases")
    rows.write.json(path)
    return datasets.read_cases(rows.sparkSession, path).select("id", "repository", "split", F.size("expected_findings").cast("long").alias("n_expected"), F.get("expected_findings", 0)["path"].alias("first_path"))


@query("""
SELECT 'src/' || (event_id % 30) || '.py' AS path, event_id AS line, 'B' || (100 + user_id % 9) AS rule_id, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
 CASE event_id % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.78::DOUBLE WHEN 2 THEN 0.62::DOUBLE ELSE 0.72::DOUBLE END AS confidence, CASE WHEN user_id % 2 = 0 THEN 'CWE-' || (user_id % 9) END AS cwe FROM events""")
def analyzer_reports(t):
    """Reports of one analyzer written as files and read to findings."""
    e, u = F.col("event_id"), F.col("user_id")
    pick = lambda values, k: F.element_at(F.lit(values), (k + 1).cast("int"))
    result = F.struct(
        F.concat(F.lit("src/"), (e % 30).cast("string"), F.lit(".py")).alias("filename"), e.alias("line_number"), F.concat(F.lit("B"), (100 + u % 9).cast("string")).alias("test_id"), F.lit("text").alias("issue_text"),
        pick(["HIGH", "MEDIUM", "LOW"], e % 3).alias("issue_severity"), pick(["HIGH", "MEDIUM", "LOW", "UNDEFINED"], e % 4).alias("issue_confidence"), F.lit("x").alias("code"), F.when(u % 2 == 0, F.struct((u % 9).alias("id"))).alias("issue_cwe"),
    )
    rows = t("events").groupBy(F.floor(e / 200).alias("part")).agg(F.collect_list(result).alias("results"))
    path = _folder(rows, "reports")
    rows.select("results").write.json(path)
    return datasets.read_bandit_lines(rows.sparkSession, path).select("path", F.col("line").cast("long").alias("line"), "rule_id", "severity", "confidence", "cwe")


_BUNDLE_ORDERS = 250_000  # two facts each, within a bundle's budget


@query(f"""
WITH {_O} SELECT kind, count(*) AS n, count(DISTINCT unit) AS units FROM (SELECT 'allocation' AS kind, u AS unit FROM o UNION ALL SELECT 'release', u FROM o WHERE k % 19 <> 0) GROUP BY kind""")
def fact_bundles(t):
    """Allocation and release facts written as JSON lines under digest ids, read back and checked: known kinds, unique ids, references that exist. A bundle has the orders of a range of keys."""
    made = _facts(t).where("kind in ('allocation', 'release')").where("not array_contains(related_fact_ids, 'x')")
    made = made.withColumn("bundle", F.floor(F.substring("fact_id", 2, 20).cast("long") / _BUNDLE_ORDERS))
    rows = made.withColumn("fact_id", F.sha2("fact_id", 256)).withColumn("related_fact_ids", F.transform("related_fact_ids", lambda x: F.sha2(x, 256)))
    path = _folder(rows, "facts")
    rows.write.partitionBy("bundle").json(path)
    return datasets.read_facts(rows.sparkSession, path).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("translation_unit").alias("units"))


@query("""
SELECT 'p' || p_partkey || '/pyproject.toml' AS path, 'pypi' AS ecosystem, 'lib-' || p_size AS name, '>=' || p_size AS requirement FROM part WHERE p_partkey % 4 = 0 UNION ALL
SELECT 'p' || p_partkey || '/package.json', 'npm', 'pkg' || p_size, '^1.' || p_size FROM part WHERE p_partkey % 4 = 1 UNION ALL SELECT 'p' || p_partkey || '/Cargo.toml', 'cargo', 'crate', p_size::VARCHAR FROM part WHERE p_partkey % 4 = 2""")
def declared_dependencies(t):
    """Dependencies of manifests of three kinds; a broken manifest declares none."""
    i, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = F.when(i == 0, "pyproject.toml").when(i == 1, "package.json").when(i == 2, "Cargo.toml").otherwise("package.json")
    text = (
        F.when(i == 0, F.concat(F.lit('[project]\nname = "x"\ndependencies = ["lib-'), n, F.lit(">="), n, F.lit('"]\n'))).when(i == 1, F.concat(F.lit('{"dependencies": {"pkg'), n, F.lit('": "^1.'), n, F.lit('"}}')))
        .when(i == 2, F.concat(F.lit('[dependencies]\ncrate = "'), n, F.lit('"\n'))).otherwise(F.lit("{broken"))
    )
    return datasets.manifests(t("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"), text.alias("text")))


@query("SELECT sha256(text) || '  ' || source || '/' || doc_id AS line FROM documents UNION ALL SELECT '| ' || n_nationkey || ' | a\\|' || n_name || '<br>b |' FROM nation")
def text_exports(t):
    """Checksum lines of files and escaped table rows."""
    files = t("documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    rows = sinks.markdown_rows(t("nation").select("n_nationkey", F.concat(F.lit("a|"), "n_name", F.lit("\nb")).alias("name")))
    return sinks.checksums(files).unionByName(rows)


@query("""
SELECT unnest(['strata_' || event_type || '_total ' || count(*), 'strata_' || event_type || '_seconds_sum ' || printf('%.6f', sum(event_id) * 0.5::DOUBLE), 'strata_' || event_type || '_seconds_count ' || count(*)]) AS line FROM events GROUP BY event_type""")
def metric_lines(t):
    return sinks.metric_text(t("events").select(F.col("event_type").alias("name"), (F.col("event_id") * 0.5).alias("seconds")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '''=' ELSE '' END || c_name AS name FROM customer")
def exported_cells(t):
    """Guarded cells written as CSV and read back."""
    rows = t("customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "=").otherwise(""), "c_name").alias("name"))
    path = _folder(rows, "cells")
    sinks.export_csv(rows, path)
    return rows.sparkSession.read.option("header", "true").schema("c_custkey long, name string").csv(path)


@query("""
SELECT CASE WHEN user_id % 3 = 0 THEN 'fresh' ELSE 'task-' || event_id END AS id, count(*) AS messages, count(*) AS distinct_ids, min(event_id * 1.0::DOUBLE) AS first_at FROM events GROUP BY 1""")
def message_envelopes(t):
    """Messages of tasks; those without an id get fresh ones, even for equal payloads."""
    tasks = t("events").select(F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("task-"), F.col("event_id").cast("string"))).alias("task_id"), F.lit("same").alias("payload"), F.col("event_id").alias("submitted_at"))
    made = delivery.envelopes(tasks)
    shown = F.when(F.startswith("message_id", F.lit("task-")), F.col("message_id")).otherwise("fresh")
    return made.groupBy(shown.alias("id")).agg(F.count("*").alias("messages"), F.count_distinct("message_id").alias("distinct_ids"), F.min("submitted_at").alias("first_at"))


@query("SELECT event_id AS message_id, event_id % 500 AS due_at FROM events WHERE event_id % 500 <= 120 ORDER BY due_at, message_id LIMIT 25")
def deferred_messages(t):
    return delivery.deferred(t("events").select(F.col("event_id").alias("message_id"), (F.col("event_id") % 500).alias("due_at")), F.lit(120), 25)


@query("SELECT event_id AS message_id, 1 AS attempt, props AS payload, value AS submitted_at FROM events WHERE event_type = 'error' AND event_id IN (SELECT o_orderkey FROM orders)")
def replayed_letters(t):
    dead = t("events").where("event_type = 'error'").select(F.col("event_id").alias("message_id"), F.col("props").alias("payload"), F.col("value").alias("failed_at"))
    return delivery.replayed(dead, t("orders").select(F.col("o_orderkey").alias("message_id")))


@query("SELECT event_id AS message_id FROM events WHERE user_id % 4 <> 0 AND 1000 - event_id % 900 >= 300")
def stale_leases(t):
    leases = t("events").select(F.col("event_id").alias("message_id"), (F.col("event_id") % 900).alias("renewed_at"), (F.col("user_id") % 4 == 0).alias("acknowledged"))
    return delivery.stale(leases, F.lit(1000), 300).select("message_id")


_FILES_OF = "(SELECT doc_id, 'm' || doc_id || '.py' AS path FROM documents)"


@query("""
SELECT 'm' || doc_id || '.py' AS path, 6 + doc_id % 3 AS line, 'eval' AS sink, 'CWE-95' AS cwe, 'console input' AS origin FROM documents WHERE doc_id % 4 = 0 UNION ALL
SELECT 'm' || doc_id || '.py', 6 + doc_id % 3, 'os.system', 'CWE-78', 'environment variable' FROM documents WHERE doc_id % 4 = 1""")
def tainted_calls(t):
    """Sinks of small programs that outside data reaches through a call and its return, or doesn't as it is made a number first."""
    i = F.col("doc_id") % 4
    source = F.when(i == 1, "os.getenv('X')").otherwise("input()")
    kept = F.when(i == 2, "int(a)").otherwise("f(a)")
    sink = F.when(i == 1, "os.system").otherwise("eval")
    used = F.when(i == 3, "'fixed'").otherwise("b")
    text = F.concat(F.lit("import os\ndef f(v):\n    return v\na = "), source, F.lit("\nb = "), kept, F.lit("\n"), F.repeat(F.lit("\n"), (F.col("doc_id") % 3).cast("int")), sink, F.lit("("), used, F.lit(")\n"))
    files = t("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    return python_facts.tainted_sinks(python_facts.facts(files))


@query("SELECT 'm' || doc_id || '.py' AS path, 1 AS line, 'function' AS kind FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'm' || doc_id || '.py', 3, 'definition' FROM documents WHERE doc_id % 3 < 2 ORDER BY path, line, kind LIMIT 50")
def symbol_definitions(t):
    text = F.when(F.col("doc_id") % 3 == 0, "def goal():\n    pass\ngoal = 1\n").when(F.col("doc_id") % 3 == 1, "x = 2\n\ngoal = x\n").otherwise("goals = 1\n")
    files = t("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    return python_facts.definitions(python_facts.facts(files), "goal").select("path", F.col("line").cast("long").alias("line"), "kind")


@query("""
WITH r AS (SELECT user_id % 40 AS case_id, event_type IN ('error', 'click') AS vulnerable, event_id % 3 = 0 AS found, event_id % 7 = 0 AS abstained, event_id % 11 <> 0 AS completed, value AS seconds FROM events),
p AS (SELECT case_id, bool_or(vulnerable AND found) AND NOT bool_or(NOT vulnerable AND found) AS passed, count(DISTINCT CASE WHEN vulnerable THEN found END) < 2 AS stable FROM r GROUP BY case_id)
SELECT count(*) FILTER (WHERE vulnerable AND found) / nullif(count(*) FILTER (WHERE vulnerable), 0) AS detection_rate, count(*) FILTER (WHERE NOT vulnerable AND found) / nullif(count(*) FILTER (WHERE NOT vulnerable), 0) AS false_positive_rate,
 count(*) FILTER (WHERE abstained) / nullif(count(*), 0) AS abstention_rate, count(*) FILTER (WHERE completed) / nullif(count(*), 0) AS completion_rate, avg(seconds) AS mean_seconds, quantile_disc(seconds, 0.95) AS p95_seconds,
 (SELECT count(*) FILTER (WHERE passed) / nullif(count(*), 0) FROM p) AS pair_rate, (SELECT count(*) FILTER (WHERE stable) / nullif(count(*), 0) FROM p) AS stability_rate FROM r""")
def platform_scores(t):
    """Rates of an evaluation over revisions and over cases, each with its own denominator."""
    rows = t("events").select(
        (F.col("user_id") % 40).alias("case_id"), F.when(F.col("event_type").isin("error", "click"), "vulnerable").otherwise("fixed").alias("revision"), (F.col("event_id") % 3 == 0).alias("found"), (F.col("event_id") % 7 == 0).alias("abstained"),
        (F.col("event_id") % 11 != 0).alias("completed"), F.col("value").alias("seconds"),
    )
    return metrics.platform_scores(rows)


@query("SELECT o_orderkey AS operation_id, o_custkey AS intent, CASE WHEN o_orderkey % 3 > 0 THEN 'staged' END AS staged, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS result FROM orders WHERE o_orderkey % 3 < 3")
def repair_operations(t):
    """A ledger of operations: the first intent, and the last staged content and result that are known."""
    k = F.col("o_orderkey")
    o = t("orders")
    none = F.lit(None).cast("string")
    first = o.select(k.alias("operation_id"), F.col("o_custkey").alias("intent"), none.alias("staged"), none.alias("result"), F.lit(1).alias("seq"))
    second = o.where(k % 3 > 0).select(k.alias("operation_id"), (F.col("o_custkey") + 1).alias("intent"), F.lit("staged").alias("staged"), none.alias("result"), F.lit(2).alias("seq"))
    third = o.where(k % 3 == 2).select(k.alias("operation_id"), F.lit(-1).cast("long").alias("intent"), none.alias("staged"), F.col("o_orderstatus").alias("result"), F.lit(3).alias("seq"))
    return state.operation_ledger(first.unionByName(second).unionByName(third))
