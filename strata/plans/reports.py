"""Evaluation reports, redacted and sanitized payloads, plug-in functions and bundles of findings over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strata.operators import attempts, bundles, metrics, privacy, python_facts, signals
from strata.plans.catalog import query
from strata.plans.review import _INNER, _OUTER, _TENANT, _TENANT_KEY

# Each order is a case; the texts below are expressions of both dialects, over k (its key) and p (its price).
_CASE = {
    "scan": ("true", {"vulnerable_hit": "k % 10 < 8", "fixed_clean": "k % 7 <> 0", "discriminated": "k % 10 < 8 AND k % 7 <> 0", "verified": "k % 9 <> 0", "vulnerable_ms": "p", "fixed_ms": "p / 2"}),
    "repair": ("true", {"policy": "CASE WHEN k % 4 = 0 THEN 'abstain' ELSE 'repair' END", "attempted": "k % 3 = 0", "patched": "k % 6 = 0"}),
    "oracle": ("true", {"configured": "k % 5 <> 0", "executed": "k % 5 IN (1, 2)", "passed": "CASE WHEN k % 11 <> 0 THEN k % 2 = 0 END"}),
    "retrieval": ("k % 8 <> 0", {
        "path_hit": "k % 3 <> 1", "inventory_recall": "CASE k % 4 WHEN 1 THEN CAST(0.75 AS DOUBLE) WHEN 2 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END", "symbol_hit": "k % 5 < 3", "packet_hit": "k % 5 < 2", "fixed_symbol_hit": "k % 6 < 2",
        "risk_hit": "k % 7 < 5", "mitigation_hit": "k % 9 < 4", "vulnerable_candidates": "k % 24", "fixed_candidates": "k % 12", "vulnerable_ms": "p / 4", "fixed_ms": "p / 8",
    }),
    "llm": ("k % 6 <> 5", {
        "vulnerable_correct": "k % 5 <> 1", "fixed_correct": "k % 7 <> 2", "fixed_clean": "k % 4 <> 3", "paired": "k % 5 <> 1 AND k % 7 <> 2", "snapshot_paired": "k % 5 <> 1 AND k % 4 <> 3",
        "vulnerable_status": "CASE WHEN k % 13 = 0 THEN 'failed' ELSE 'completed' END", "fixed_status": "CASE WHEN k % 17 <> 0 THEN 'completed' END", "vulnerable_valid": "k % 13 <> 0 AND k % 3 <> 2", "fixed_valid": "CASE WHEN k % 17 <> 0 THEN k % 3 <> 1 END",
        "non_clear": "k % 10 < 7", "auto_cleared": "CASE WHEN k % 8 <> 1 THEN k % 10 < 5 END", "paired_safe": "k % 10 < 4", "reviews": "k % 3", "decisions": "k % 3 + k % 2", "tokens_in": "k % 1000", "tokens_out": "k % 100",
        "vulnerable_ms": "CASE WHEN k % 13 <> 0 THEN p * 2 END", "fixed_ms": "CASE WHEN k % 17 <> 0 THEN p * 4 END",
    }),
}
_CASES = "c AS (SELECT k, {} FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders))".format(
    ", ".join(f"CASE WHEN {when} THEN struct_pack({', '.join(f'{f} := {e}' for f, e in fields.items())}) END AS {name}" for name, (when, fields) in _CASE.items())
)


def _cases(t):
    rows = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    return rows.select(*[F.when(F.expr(when), F.struct(*[F.expr(e).alias(f) for f, e in fields.items()])).alias(name) for name, (when, fields) in _CASE.items()])


def _rates(**of: tuple[str, str]) -> str:
    return ", ".join(f"coalesce(round((count(*) FILTER (WHERE {part})) / nullif({whole}, 0), 4), 0) AS {name}" for name, (part, whole) in of.items())


_SCAN = {f"scan_{f}_rate": (f"scan.{f}", "count(*)") for f in ("vulnerable_hit", "fixed_clean", "discriminated", "verified")}
_FOUND = {f"retrieval_{f}_rate": (f"retrieval.{f}", "count(retrieval)") for f in ("path_hit", "symbol_hit", "packet_hit", "fixed_symbol_hit", "risk_hit", "mitigation_hit")}
_LLM = {f"llm_{f}_rate": (f"llm.{f}", "count(llm)") for f in ("vulnerable_correct", "fixed_correct", "fixed_clean", "paired", "snapshot_paired")}
_HYBRID = {f"hybrid_{f}_rate": (f"llm.{f}", "count(llm)") for f in ("non_clear", "auto_cleared", "paired_safe")}
_FLAT = "SELECT {0}.vulnerable_ms AS ms FROM c WHERE {0}.vulnerable_ms IS NOT NULL UNION ALL SELECT {0}.fixed_ms FROM c WHERE {0}.fixed_ms IS NOT NULL"


@query(f"""
WITH {_CASES}, r AS (SELECT count(*) AS cases, {_rates(**_SCAN, **_FOUND, **_LLM, **_HYBRID)},
  {_rates(repair_attempt_rate=("repair.attempted", "count(*)"), verified_patch_rate=("repair.patched", "count(*)"), abstention_adherence=("repair.policy = 'abstain' AND NOT repair.patched", "count(*) FILTER (WHERE repair.policy = 'abstain')"))},
  {_rates(oracle_coverage=("oracle.configured", "count(*)"), oracle_executed_coverage=("oracle.configured AND oracle.executed", "count(*)"), oracle_pass_rate=("oracle.configured AND oracle.executed AND oracle.passed", "count(*) FILTER (WHERE oracle.configured AND oracle.executed)"))},
  0.0::DOUBLE AS llm_localized_vulnerable_correct_rate, 0.0::DOUBLE AS llm_localized_fixed_correct_rate, 0.0::DOUBLE AS llm_localized_paired_rate,
  round(sum(llm.reviews) / sum(llm.decisions), 4) AS hybrid_review_rate,
  round((count(*) FILTER (WHERE llm.vulnerable_status = 'completed') + count(*) FILTER (WHERE llm.fixed_status = 'completed')) / (2 * count(llm)), 4) AS llm_success_rate,
  round((count(*) FILTER (WHERE llm.vulnerable_valid) + count(*) FILTER (WHERE llm.fixed_valid)) / (2 * count(llm)), 4) AS llm_valid_rate,
  round(avg(retrieval.inventory_recall), 4) AS retrieval_inventory_recall, round(sum(retrieval.vulnerable_candidates + retrieval.fixed_candidates) / (2 * count(retrieval)), 3) AS retrieval_candidates_mean,
  sum(llm.tokens_in)::BIGINT AS tokens_in, sum(llm.tokens_out)::BIGINT AS tokens_out FROM c)
SELECT r.*, {", ".join(f"(SELECT round(avg(ms), 3) FROM ({_FLAT.format(k)})) AS {k}_ms_mean, (SELECT round(quantile_disc(ms, 0.95), 3) FROM ({_FLAT.format(k)})) AS {k}_ms_p95" for k in ("scan", "retrieval", "llm"))} FROM r""")
def evaluation_report(t):
    """An evaluation's rates, latencies and tokens in one row; every order is a case."""
    return metrics.evaluation_report(_cases(t))


@query(f"""
WITH {_CASES} SELECT category, count(*) AS n FROM (
  SELECT 'detector-missed-known-vulnerable-file' AS category FROM c WHERE NOT scan.vulnerable_hit UNION ALL SELECT 'detector-alerted-on-fixed-pair' FROM c WHERE NOT scan.fixed_clean
  UNION ALL SELECT 'project-oracle-pair-failed' FROM c WHERE oracle.executed AND oracle.passed IS DISTINCT FROM true UNION ALL SELECT 'retrieval-inventory-missed-ground-truth-path' FROM c WHERE retrieval.inventory_recall < 1
  UNION ALL SELECT 'retriever-missed-vulnerable-symbol' FROM c WHERE NOT retrieval.symbol_hit UNION ALL SELECT 'llm-api-failed' FROM c WHERE llm IS NOT NULL AND llm.vulnerable_status IS DISTINCT FROM 'completed'
  UNION ALL SELECT 'llm-api-failed' FROM c WHERE llm IS NOT NULL AND llm.fixed_status IS DISTINCT FROM 'completed' UNION ALL SELECT 'llm-pair-misclassified' FROM c WHERE llm IS NOT NULL AND NOT llm.paired) GROUP BY category""")
def evaluation_failures(t):
    """Failures of the same evaluation by category."""
    return metrics.failure_categories(_cases(t))


def _signed(text: str) -> str:
    return f"substr(sha256(unhex('{_OUTER.hex()}') || unhex(sha256(unhex('{_INNER.hex()}') || encode({text})))), 1, 32)"


def _record(text: str, kind: str) -> str:
    return f"""'{{"fingerprint":"' || {_signed(text)} || '","value_kind":"{kind}","length":' || length({text}) || '}}'"""


@query(f"""
WITH e AS (SELECT event_id, event_type, event_id % 6 AS way, sha256(event_id::VARCHAR) AS run, 'http://u:' || user_id || '@h/' AS url FROM events)
SELECT event_id, CASE way WHEN 0 THEN '{{"meta":{{"session_token":' || {_record("event_type", "string")} || ',"n":' || event_id || '}}}}' WHEN 1 THEN '[' || {_record("url", "string")} || ',"' || event_type || '"]'
  WHEN 2 THEN '{{"a":' || {_record("run", "string")} || '}}' WHEN 3 THEN '{{"a":"see [REDACTED:' || {_signed("run")} || '] é"}}' WHEN 4 THEN '{{"apiKey":' || {_record("('[1,' || event_id || ']')", "structured")} || '}}' END AS redacted FROM e""")
def redacted_payloads(t):
    """Payloads in six forms without their secrets: below a sensitive key, an address with a password, a whole and an inner base64 run, a list below a key, and broken JSON (null)."""
    way, id_, run = F.col("event_id") % 6, F.col("event_id").cast("string"), F.sha2(F.col("event_id").cast("string"), 256)
    payload = (
        F.when(way == 0, F.concat(F.lit('{"meta": {"session_token": "'), "event_type", F.lit('", "n": '), id_, F.lit("}}"))).when(way == 1, F.concat(F.lit('["http://u:'), F.col("user_id").cast("string"), F.lit('@h/", "'), "event_type", F.lit('"]')))
        .when(way == 2, F.concat(F.lit('{"a": "'), run, F.lit('"}'))).when(way == 3, F.concat(F.lit('{"a": "see '), run, F.lit(' é"}'))).when(way == 4, F.concat(F.lit('{"apiKey": [1, '), id_, F.lit("]}"))).otherwise(F.concat(F.lit('{"a": '), id_))
    )
    return t("events").select("event_id", privacy.redacted_json(payload, _TENANT, _TENANT_KEY).alias("redacted"))


@query("""
WITH e AS (SELECT event_id, event_type, event_id % 4 AS way FROM events)
SELECT event_id, CASE WHEN way < 2 THEN event_type END AS stage, CASE WHEN way = 0 THEN event_id % 7 END::INT AS stage_index,
  CASE way WHEN 0 THEN 'sent [redacted] to ' || event_type WHEN 1 THEN '[redacted] [redacted]' END AS message,
  CASE way WHEN 0 THEN '{"stage":"' || event_type || '","stage_index":' || event_id % 7 || ',"message":"sent [redacted] to ' || event_type || '","Api-Key":"[redacted]"}'
    WHEN 1 THEN '{"stage":"' || event_type || '","message":"[redacted] [redacted]","parts":[{"Authorization":"[redacted]"},true]}' WHEN 2 THEN '{}' END AS record FROM e""")
def progress_records(t):
    """Progress of tasks without credentials, and the fields of its summary; empty and broken progress has none."""
    way, kind, id_ = F.col("event_id") % 4, F.col("event_type"), F.col("event_id")
    payload = (
        F.when(way == 0, F.concat(F.lit('{"stage": "'), kind, F.lit('", "stage_index": '), (id_ % 7).cast("string"), F.lit(', "message": "sent Bearer x'), id_.cast("string"), F.lit(" to "), kind, F.lit('", "Api-Key": {"a": 1}}')))
        .when(way == 1, F.concat(F.lit('{"stage": "'), kind, F.lit('", "message": "TOKEN = t'), id_.cast("string"), F.lit(' password:p", "parts": [{"Authorization": 5}, true]}'))).when(way == 2, F.lit("{}")).otherwise(F.lit('{"stage": '))
    )
    rows = t("events").select("event_id", privacy.sanitized_progress(payload).alias("record"))
    return rows.withColumn("s", privacy.progress_summary(F.col("record"))).select("event_id", "s.stage", "s.stage_index", "s.message", "record")


def _share(payload: str) -> int:
    divisor = json.loads(payload)["k"] % 10
    if not divisor:
        raise ValueError("no divisor")
    return 1000 // divisor


@query("""
SELECT event_id, CASE WHEN k % 10 <> 0 THEN 1000 // (k % 10) END AS result, CASE WHEN k % 10 = 0 THEN 'ValueError: no divisor' END AS failure FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def attempted_divisions(t):
    """A function of every payload, whose failures are rows as well."""
    rows = attempts.attempted(t("events").select("event_id", "props"), _share, "props", "long")
    good, bad = attempts.results_and_failures(rows, ["event_id"])
    return good.withColumn("failure", F.lit(None).cast("string")).unionByName(bad.withColumn("result", F.lit(None).cast("long"))).select("event_id", "result", "failure")


def _shouting(path: str, text: str):
    for i, line in enumerate(text.split("\n"), 1):
        if len(line) > 60 and "a" not in line[:12]:
            yield f"{path[:2]}-NO-A", i, line[:12]


@query("""
SELECT doc_id, lang || '-NO-A' AS rule_id, line::INT AS line, substr(content, 1, 12) AS evidence FROM (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL)
WHERE length(content) > 60 AND NOT contains(substr(content, 1, 12), 'a')""")
def plugin_findings(t):
    """A scanner that a user plugs in as a table function, over all documents."""
    docs = t("documents").select("doc_id", "lang", "text")
    spark = docs.sparkSession
    attempts.register_scanner(spark, "strata_plugin_scan", _shouting)
    return spark.sql("SELECT d.doc_id, s.rule_id, s.line, s.evidence FROM {docs} d, LATERAL strata_plugin_scan(d.lang, d.text) s", docs=docs)


def _findings(t):
    k, path = F.col("event_id"), F.concat(F.lit("src/"), F.col("user_id").cast("string"), F.lit(".py"))
    note = F.struct(path.alias("path"), (k % 40 + 1).cast("int").alias("line"), F.concat(F.lit("seen by "), "event_type").alias("snippet"))
    other = F.struct(F.lit("lib/a.py").alias("path"), F.lit(7).alias("line"), F.col("props").alias("snippet"))
    records = F.when(k % 3 == 0, F.array(note)).when(k % 3 == 1, F.array(note, other))
    return t("events").select(
        F.col("event_type").alias("rule_id"), path.alias("path"), (k % 40).cast("int").alias("line"), F.col("props").alias("evidence"), F.lit("line-match").alias("evidence_kind"), F.lit("scanner").alias("source"),
        F.when(k % 2 == 0, "CWE-78").otherwise("").alias("cwe"), records.alias("evidence_records"),
    )


_PLAIN = """f AS (SELECT event_id AS k, event_type AS rule_id, 'src/' || user_id || '.py' AS path, event_id % 40 AS line, props AS evidence, CASE WHEN event_id % 2 = 0 THEN 'CWE-78' ELSE '' END AS cwe, sha256(event_type || chr(0) || 'src/' || user_id || '.py' || chr(0) || event_id % 40 || chr(0) || props) AS d FROM events)"""


@query(f"WITH {_PLAIN} SELECT rule_id, 'migrated:issue-' || substr(d, 1, 12) AS title, path, line::INT AS line, 'seen by ' || rule_id AS evidence, cwe, 'low' AS severity, substr(d, 1, 24) AS fingerprint FROM f WHERE k % 3 < 2")
def migrated_findings(t):
    """Findings turned to bundles and back; those without evidence records have no way back."""
    return bundles.to_findings(bundles.to_bundles(_findings(t))).select("rule_id", "title", "path", "line", "evidence", "cwe", "severity", "fingerprint")


@query(f"""
WITH {_PLAIN}, r AS (SELECT *, unnest(CASE k % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [0, 1, 2] ELSE [0] END) AS i FROM f)
SELECT 'ev-' || substr(d, 1, 12) || '-00' || i AS evidence_id, CASE WHEN i = 0 THEN 'SIGNAL' ELSE 'SECURITY_ISSUE' END AS subject_kind, CASE WHEN i = 0 THEN 'sig-' ELSE 'issue-' END || substr(d, 1, 12) AS subject_id,
  CASE WHEN i = 1 THEN 'seen by ' || rule_id ELSE evidence END AS summary, CASE WHEN i = 2 THEN 'lib/a.py' ELSE path END AS path, (CASE i WHEN 0 THEN line WHEN 1 THEN line + 1 ELSE 7 END)::INT AS line FROM r""")
def bundle_evidence(t):
    """All evidence records of the findings' bundles."""
    return bundles.to_bundles(_findings(t)).select(F.inline("evidence")).select("evidence_id", "subject_kind", "subject_id", "summary", F.col("location.path").alias("path"), F.col("location.start_line").alias("line"))


_CODE = """@app.route('/x')
def view(file_name, {p}):
    value = request.args.get('q')
    {a}
    def inner(x):
        return os.path.join(x, 'a')
    return inner(value)

class Store:
    def find(self, *, sort_by):
        {b}
"""
_LINES = ("eval(f'{value}')", "subprocess.run(value, shell=True)", "os.system('ls')", "pass")
_BODY = ("return self.db.execute(sort_by)", "return getattr(json.loads('{}'), sort_by)", "return getattr(self, sort_by)")


@query("""
WITH p AS (SELECT p_partkey AS k, 'src/' || p_partkey || '.py' AS path FROM part), r AS (
  SELECT path, 'view' AS symbol, 'path' AS category, 12 + 6 + 8 + 12 AS score, 'path-construction,path-parameter,request-argument-source,web-route-handler' AS signals FROM p
  UNION ALL SELECT path, 'view.inner', 'path', 12, 'path-construction' FROM p
  UNION ALL SELECT path, 'view', 'sql', 22 + CASE WHEN k % 2 = 0 THEN 8 ELSE 0 END, CASE WHEN k % 2 = 0 THEN 'request-argument-source,sql-structure-parameter' ELSE 'request-argument-source' END FROM p
  UNION ALL SELECT path, 'view', 'command', 8 + CASE k % 4 WHEN 0 THEN 184 WHEN 1 THEN 68 WHEN 2 THEN 44 ELSE 0 END, CASE k % 4 WHEN 0 THEN 'interpreter-execution-sink,interpreter-template-expansion,request-argument-source'
    WHEN 1 THEN 'command-execution-sink,dynamic-shell-sink,request-argument-source' WHEN 2 THEN 'command-execution-sink,request-argument-source' ELSE 'request-argument-source' END FROM p
  UNION ALL SELECT path, 'Store', 'sql', 30, 'dynamic-sql-execute' FROM p WHERE k % 3 = 0 UNION ALL SELECT path, 'Store.find', 'sql', 38, 'dynamic-sql-execute,sql-structure-parameter' FROM p WHERE k % 3 = 0
  UNION ALL SELECT path, s, 'command', 160, 'dynamic-dispatch-boundary' FROM p, (VALUES ('Store'), ('Store.find')) v(s) WHERE k % 3 = 1)
SELECT path, symbol, category, score::BIGINT AS score, signals FROM r""")
def symbol_signals(t):
    """Weighted signals of the symbols of a source written for each part, in twelve forms."""
    k = F.col("p_partkey")
    sides = {"p": F.when(k % 2 == 0, "query").otherwise("other"), "a": F.element_at(F.lit(list(_LINES)), (k % 4 + 1).cast("int")), "b": F.element_at(F.lit(list(_BODY)), (k % 3 + 1).cast("int"))}
    text = F.lit(_CODE)
    for name, side in sides.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), side)
    files = t("part").select(F.concat(F.lit("src/"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    return signals.symbol_signals(python_facts.facts(files)).withColumn("signals", F.array_join("signals", ","))
