"""Merging, verification, expressions and joins of findings, with events, orders and parts in their place."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import digests
from strata.functions import text as T
from strata.operators import joins, lookups, merge, metrics, ranking, review, state
from strata.plans.catalog import query

_E = "e AS (SELECT event_id AS seq, 'src/' || (user_id % 20) || '.py' AS path, (event_id % 40)::BIGINT AS line, event_type AS rule_id, value, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def _events(t) -> DataFrame:
    path = F.concat(F.lit("src/"), (F.col("user_id") % 20).cast("string"), F.lit(".py"))
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").select(F.col("event_id").alias("seq"), path.alias("path"), (F.col("event_id") % 40).alias("line"), F.col("event_type").alias("rule_id"), "value", "user_id", k.alias("k"))


@query(f"WITH {_E} SELECT path, line, seq, value AS confidence FROM e WHERE k % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY value DESC, seq) = 1")
def arbitrated_by_confidence(t):
    """Of approved findings the most confident of each place, the first of equals."""
    rows = _events(t).withColumn("approved", F.col("k") % 3 != 0).withColumnRenamed("value", "confidence")
    return merge.arbitrate(rows, ["path", "line"]).select("path", "line", "seq", "confidence")


@query(f"WITH {_E} SELECT path, line, rule_id, k % 5 AS rule, k % 3 AS layer, seq FROM e QUALIFY row_number() OVER (PARTITION BY path, line, rule_id, k % 5 ORDER BY k % 3, seq) = 1")
def fused_layers(t):
    rows = _events(t).select(F.concat_ws(":", "path", "line").alias("identity"), "path", "line", F.col("rule_id").alias("tool"), (F.col("k") % 5).alias("rule_id"), (F.col("k") % 3).alias("layer"), "seq")
    return merge.fuse_layers(rows).select("path", "line", F.col("tool").alias("rule_id"), F.col("rule_id").alias("rule"), "layer", "seq")


@query(f"WITH {_E} SELECT path, line, rule_id, max(seq) AS seq, arg_max(k, seq) AS k FROM e GROUP BY ALL")
def composed_reviews(t):
    """The last reviewer's finding of each place and rule; one of the reviewers didn't fail."""
    return merge.compose_reviews(_events(t), t("region").select((F.col("r_regionkey") > 0).alias("failed"))).select("path", "line", "rule_id", "seq", "k")


@query(f"""
WITH {_E}, f AS (SELECT *, 'CWE-' || (k % 4) AS cwe, CASE k % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'corroborated' ELSE 'dataflow-verified' END AS vs, k % 3 + (CASE WHEN k % 3 = 2 THEN 1 ELSE k % 3 * 1 END) AS r0 FROM e),
g AS (SELECT *, CASE vs WHEN 'candidate' THEN 0 WHEN 'corroborated' THEN 2 ELSE 3 END AS r FROM f),
best AS (SELECT cwe, path, rule_id, line, vs, 'm' || (k % 2) AS mode, 'k' || (k % 6) AS kind FROM g QUALIFY row_number() OVER (PARTITION BY cwe, path, rule_id, line ORDER BY r DESC, seq) = 1),
ev AS (SELECT cwe, path, rule_id, line, string_agg(x, ',' ORDER BY s) AS evidence FROM (SELECT cwe, path, rule_id, line, 'v' || (k % 7) AS x, min(seq) AS s FROM g GROUP BY ALL) GROUP BY ALL),
agg AS (SELECT cwe, path, rule_id, line, CASE WHEN bool_or(k % 2 = 0) THEN 'ast+flow' ELSE 'ast' END AS source, max(value) AS confidence, CASE max(k % 4) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM g GROUP BY ALL)
SELECT a.cwe, a.path, a.rule_id AS symbol, a.line, source, confidence, severity, b.vs AS verification_state, b.mode AS analysis_mode, b.kind AS evidence_kind, ev.evidence FROM agg a JOIN best b USING (cwe, path, rule_id, line) JOIN ev USING (cwe, path, rule_id, line)""")
def native_findings(t):
    """Findings merged by weakness, path, symbol and line."""
    k = F.col("k")
    state_ = F.when(k % 3 == 0, "candidate").when(k % 3 == 1, "corroborated").otherwise("dataflow-verified")
    severity = F.when(k % 4 == 3, "critical").when(k % 4 == 2, "high").when(k % 4 == 1, "medium").otherwise("low")
    mark = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    rows = _events(t).select(
        "seq", mark("CWE-", 4).alias("cwe"), "path", F.col("rule_id").alias("symbol"), "line", F.when(k % 2 == 0, "flow+ast").otherwise("ast").alias("source"), F.col("value").alias("confidence"),
        state_.alias("verification_state"), mark("m", 2).alias("analysis_mode"), mark("k", 6).alias("evidence_kind"), severity.alias("severity"), mark("v", 7).alias("evidence"),
    )
    return merge.merge_native_findings(rows).select("cwe", "path", "symbol", "line", "source", "confidence", "severity", "verification_state", "analysis_mode", "evidence_kind", F.array_join("evidence_records", ",").alias("evidence"))


_SCAN = """SELECT '{0}' AS part, tp, fn, fp, tn, tp / nullif(tp + fn, 0)::DOUBLE AS recall, tp / nullif(tp + fp, 0)::DOUBLE AS precision, fp * 1000.0::DOUBLE / nullif(fl, 0) AS fp_per_kloc, c / nullif(n, 0)::DOUBLE AS coverage,
  array_to_string(list_filter([CASE WHEN tp + fn = 0 THEN 'recall-denominator-zero' END, CASE WHEN tp + fp = 0 THEN 'precision-denominator-zero' END, CASE WHEN fl = 0 THEN 'fp_per_kloc-denominator-zero' END, CASE WHEN n = 0 THEN 'coverage-denominator-zero' END], lambda x: x IS NOT NULL), ',') AS diagnostics
FROM (SELECT count(*) FILTER (WHERE v AND f) AS tp, count(*) FILTER (WHERE v AND NOT f) AS fn, count(*) FILTER (WHERE NOT v AND f) AS fp, count(*) FILTER (WHERE NOT v AND NOT f) AS tn, coalesce(sum(o_custkey) FILTER (WHERE NOT v), 0)::BIGINT AS fl,
  count(*) FILTER (WHERE o_orderstatus <> 'P') AS c, count(*) AS n FROM (SELECT *, o_orderkey % 2 = 0 AS v, o_orderpriority IN ('1-URGENT', '2-HIGH') AS f FROM orders WHERE {1}))"""


@query(" UNION ALL ".join(_SCAN.format(*x) for x in (("all", "true"), ("fixed", "o_orderkey % 2 = 1"), ("none", "o_orderkey < 0"), ("quiet", "o_orderpriority = '5-LOW'"))))
def scan_quality(t):
    """Confusion over revisions with nulls and diagnostics for empty denominators, for all and for three parts that lack some."""
    rows = t("orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "vulnerable").otherwise("fixed").alias("revision"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("found"), F.col("o_custkey").alias("source_lines"),
        (F.col("o_orderstatus") != "P").alias("completed"),
    )
    parts = {"all": rows, "fixed": rows.where("o_orderkey % 2 = 1"), "none": rows.where("o_orderkey < 0"), "quiet": rows.where("o_orderpriority = '5-LOW'")}
    made = [metrics.scan_quality(df).select(F.lit(name).alias("part"), "tp", "fn", "fp", "tn", "recall", "precision", "fp_per_kloc", "coverage", F.array_join("diagnostics", ",").alias("diagnostics")) for name, df in parts.items()]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


@query(f"WITH {_E} SELECT user_id AS run_id, coalesce(sum(k) FILTER (WHERE rule_id <> 'view'), 0)::BIGINT AS calls, coalesce(sum(seq) FILTER (WHERE rule_id NOT IN ('view', 'error')), 0)::BIGINT AS tokens, count(*) FILTER (WHERE rule_id = 'click') AS completed FROM e GROUP BY user_id")
def experiment_progress(t):
    """Calls, tokens and completed cases of stored results; some results are missing, some lack a field."""
    tokens = F.when(F.col("rule_id") == "error", F.lit("null")).otherwise(F.col("seq").cast("string"))
    result = F.when(F.col("rule_id") != "view", F.concat(F.lit('{"calls": '), F.col("k").cast("string"), F.lit(', "tokens": '), tokens, F.lit("}")))
    return state.progress(_events(t).select(F.col("user_id").alias("run_id"), result.alias("result"), F.when(F.col("rule_id") == "click", "completed").otherwise("running").alias("status")))


@query("""
WITH f AS (SELECT source AS repository, lang, doc_id % 7 = 0 AND source <> 'src3' AS declared, CASE WHEN doc_id % 5 < 2 OR (doc_id % 5 = 2 AND source IN ('src0', 'src1', 'src2')) THEN 'docs' WHEN doc_id % 5 = 3 THEN 'test' WHEN doc_id % 5 = 4 THEN 'build' ELSE '' END AS role, source <> 'src1' AND doc_id % 2 = 0 AS ev FROM documents)
SELECT repository, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (WHERE declared), string_agg(DISTINCT lang, ',' ORDER BY lang)) AS languages,
  concat_ws(',', CASE WHEN count(*) FILTER (WHERE role = 'docs') * 2 > count(*) THEN 'docs' END, CASE WHEN bool_or(role = 'test' AND ev) THEN 'test' END, CASE WHEN bool_or(role = 'build' AND ev) THEN 'build' END) AS kinds FROM f GROUP BY repository""")
def repository_profiles(t):
    """Languages and kinds of each source as a repository."""
    i, source = F.col("doc_id") % 5, F.col("source")
    folder = F.when((i < 2) | ((i == 2) & source.isin("src0", "src1", "src2")), "docs").when(i == 3, "tests").when(i == 4, "scripts").otherwise("lib")
    files = t("documents").select(
        source.alias("repository"), F.concat_ws("/", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("lang").alias("language"), ((F.col("doc_id") % 7 == 0) & (source != "src3")).alias("declared"),
        F.when((source != "src1") & (F.col("doc_id") % 2 == 0), "manifest").alias("evidence"),
    )
    return metrics.repository_profile(files).select("repository", F.array_join("languages", ",").alias("languages"), F.array_join("kinds", ",").alias("kinds"))


@query(f"""
WITH RECURSIVE {_E}, o AS (SELECT user_id, seq, k, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS n FROM e),
w(user_id, seq, n, used, took) AS (SELECT user_id, seq, n, CASE WHEN k <= 500 THEN k ELSE 0 END, k <= 500 FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.seq, o.n, CASE WHEN w.used + o.k <= 500 THEN w.used + o.k ELSE w.used END, w.used + o.k <= 500 FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT user_id, seq FROM w WHERE took""")
def latest_within_budget(t):
    """From the newest event of a user back, those that fit a budget."""
    return ranking.budget_latest(_events(t).select("user_id", "seq", "k"), ["user_id"], ["seq"], "k", 500).select("user_id", "seq")


@query("SELECT doc_id, array_to_string(ls[greatest(len(ls) - 11, 1):len(ls)], '|') AS steps FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def last_steps(t):
    """The last twelve steps of a trace that may have fewer."""
    return t("documents").select("doc_id", F.array_join(ranking.last_steps(F.split("text", "\n")), "|").alias("steps"))


@query("""
SELECT doc_id, array_to_string(ls[greatest(c - 3, 1):least(c + 3, len(ls))], '|') AS body FROM (SELECT doc_id, ls, len(ls) - list_position(list_reverse(ws), list_max(ws)) + 1 AS c FROM
  (SELECT doc_id, ls, list_transform(ls, lambda x: length(x) % 10) AS ws FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))""")
def excerpts(t):
    """Lines around the heaviest one of a text, the last of equals."""
    lines = F.split("text", "\n")
    return t("documents").select("doc_id", F.array_join(ranking.excerpt(lines, F.transform(lines, lambda x: F.length(x) % 10), 3), "|").alias("body"))


_WEIGHTS = "CASE kind WHEN 'eval' THEN 90 WHEN 'sql' THEN 80 WHEN 'path' THEN 70 WHEN 'entrypoint' THEN 60 ELSE 30 END"
_KINDS = {"eval": "click", "sql": "error", "path": "view", "entrypoint": "signup", "unresolved-edge": "purchase"}


@query(f"""
WITH {_E}, r AS (SELECT CASE rule_id {' '.join(f"WHEN '{v}' THEN '{k}'" for k, v in _KINDS.items())} END AS kind, path, 'f' || (k % 9) AS symbol, seq AS line FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY kind, path, symbol ORDER BY line) - 1 AS ordinal FROM r)
SELECT kind, {_WEIGHTS} AS weight, path, symbol, line, ordinal, substr(sha256(kind || chr(0) || path || chr(0) || symbol || chr(0) || ordinal), 1, 24) AS candidate_id FROM o""")
def weighted_inventories(t):
    """Five inventories as one weighted table with ordinals and ids."""
    rows = _events(t).select("rule_id", "path", F.concat(F.lit("f"), (F.col("k") % 9).cast("string")).alias("symbol"), F.col("seq").alias("line"))
    out = review.weighted_inventories({kind: rows.where(F.col("rule_id") == event).drop("rule_id") for kind, event in _KINDS.items()})
    return out.select("kind", "weight", "path", "symbol", "line", F.col("ordinal").cast("long").alias("ordinal"), "candidate_id")


@query(f"""
WITH {_E}, c AS (SELECT user_id, seq AS rank, rule_id AS category, path, 'f' || (k % 9) AS qualname, k % 4 = 0 AND user_id % 3 <> 0 AS anchor, k % 10 AS risk FROM e),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY risk DESC, anchor DESC, rank) AS f, row_number() OVER (PARTITION BY user_id, category ORDER BY risk DESC, anchor DESC, rank) AS n, min(rank) OVER (PARTITION BY user_id, category) AS o, bool_or(anchor) OVER (PARTITION BY user_id) AS any_anchor FROM c),
s AS (SELECT *, CASE WHEN NOT any_anchor THEN 3 WHEN f = 1 THEN 0 WHEN n = 1 THEN 1 WHEN anchor AND n = 2 THEN 2 ELSE 3 END AS stage FROM a),
p AS (SELECT *, CASE WHEN stage IN (1, 2) THEN o ELSE rank END AS place FROM s),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id, path, qualname ORDER BY stage, place, rank) = 1)
SELECT user_id, rank, row_number() OVER (PARTITION BY user_id ORDER BY stage, place, rank) AS position FROM u QUALIFY position <= 8""")
def evidence_packets(t):
    """At most eight candidates of each user; every third user has no anchor."""
    k = F.col("k")
    rows = _events(t).select("user_id", F.col("seq").alias("rank"), F.col("rule_id").alias("category"), "path", F.concat(F.lit("f"), (k % 9).cast("string")).alias("qualname"), ((k % 4 == 0) & (F.col("user_id") % 3 != 0)).alias("anchor"), (k % 10).alias("risk"))
    return review.evidence_packet(rows, ["user_id"]).select("user_id", "rank", F.col("position").cast("long").alias("position"))


@query(f"""
WITH {_E}, f AS (SELECT seq, rule_id, k, least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(value, 100.0) / 100.0::DOUBLE + CASE k % 4 WHEN 0 THEN -0.35::DOUBLE WHEN 1 THEN 0.08::DOUBLE WHEN 2 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END)) AS confidence FROM e)
SELECT seq, confidence, concat_ws(';', CASE WHEN k % 5 = 0 THEN rule_id END, CASE WHEN k % 7 = 0 THEN 'not reproducible' END, CASE WHEN k % 6 IN (0, 1, 3) THEN 'fix not ready' END, CASE WHEN confidence < 0.55::DOUBLE THEN 'low confidence' END) AS reasons,
  NOT (k % 5 = 0 OR k % 7 = 0 OR k % 6 IN (0, 1, 3) OR confidence < 0.55::DOUBLE) AS approved FROM f""")
def verified_findings(t):
    """Adjusted confidence and the reasons against each finding."""
    k = F.col("k")
    fix = F.when(k % 6 == 0, F.lit("")).when(k % 6 == 1, F.lit(None)).when(k % 6 == 3, F.lit("Please Ignore Error here")).otherwise("add a check")
    rows = _events(t).select(
        "seq", (F.least("value", F.lit(100.0)) / 100).alias("confidence"), F.when(k % 4 == 0, -0.35).when(k % 4 == 1, 0.08).when(k % 4 == 2, 0.03).alias("adjustment"), (k % 5 != 0).alias("accepted"),
        F.array("rule_id").alias("objections"), (k % 7 != 0).alias("reproducible"), fix.alias("fix"),
    )
    return review.verify(rows).select("seq", "confidence", F.array_join("reasons", ";").alias("reasons"), "approved")


_TENANT_KEY, _TENANT = b"a fixed key for tests", "tenant-1"
_DERIVED = hmac.new(_TENANT_KEY, b"tenant\x00" + _TENANT.encode(), hashlib.sha256).digest().ljust(64, b"\0")
_INNER, _OUTER = bytes(b ^ 0x36 for b in _DERIVED) + b"value\x00", bytes(b ^ 0x5C for b in _DERIVED)


@query(f"SELECT c_custkey, substr(sha256(unhex('{_OUTER.hex()}') || unhex(sha256(unhex('{_INNER.hex()}') || encode(c_name)))), 1, 32) AS fingerprint, nfc_normalize('e' || chr(769) || c_name || 'A' || chr(778)) AS name FROM customer")
def tenant_fingerprints(t):
    """Names signed with a tenant's derived key, and in normal form C."""
    name = F.concat(F.lit("é"), "c_name", F.lit("Å"))
    return t("customer").select("c_custkey", digests.tenant_fingerprint(F.col("c_name"), _TENANT, _TENANT_KEY).alias("fingerprint"), digests.nfc(name).alias("name"))


@query(f"""
WITH {_E} SELECT seq, CASE k % 4 WHEN 0 THEN '{{"a":[' || k || ',true],"b":{{"x":null,"y":"' || rule_id || '"}}}}' WHEN 1 THEN NULL WHEN 2 THEN '[{{"n":-' || seq || '}},"é"]' ELSE NULL END AS canonical FROM e""")
def canonical_payloads(t):
    """Canonical JSON of payloads with keys out of order, floats (which have none), decomposed letters and repeated keys after normalising."""
    k, s = F.col("k"), F.col("k").cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('{ "b": {"y": "'), "rule_id", F.lit('", "x": null}, "a": [ '), s, F.lit(", true]}"))).when(k % 4 == 1, F.concat(F.lit('{"f": '), s, F.lit(".5}")))
        .when(k % 4 == 2, F.concat(F.lit('[{"n": -'), F.col("seq").cast("string"), F.lit('}, "é"]'))).otherwise(F.lit('{"é": 1, "é": 2}'))
    )
    return _events(t).select("seq", digests.canonical_json(text).alias("canonical"))


_RAW = ["' a\\src\\Tests\\'", "'b/pkg/__init__/'", "'a/lib/'", "'  pkg\\sub/test_'", "'testing/x/'"]


@query(f"""
WITH p AS (SELECT p_partkey, ([{', '.join(_RAW)}])[(p_partkey % 5 + 1)::INT] || p_partkey || '.py ' AS raw, CASE p_partkey % 3 WHEN 0 THEN 'SEC-EVAL' WHEN 1 THEN 'SEC-LOG-FORGING' ELSE 'OTHER-' || p_size END AS rule_id FROM part),
n AS (SELECT *, regexp_replace(trim(replace(raw, '\\', '/')), '^[ab]/', '') AS path FROM p)
SELECT p_partkey, path, CASE rule_id WHEN 'SEC-EVAL' THEN 'CWE-95' WHEN 'SEC-LOG-FORGING' THEN 'CWE-117' ELSE rule_id END AS cwe,
  len(list_filter(string_split(lower(path), '/'), lambda x: x IN ('test', 'tests', 'testing') OR starts_with(x, 'test_'))) > 0 AS is_test, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module FROM n""")
def path_facts(t):
    """Paths made normal, their modules, whether they are of tests, and rules' weaknesses."""
    i = F.col("p_partkey")
    raw = F.concat(F.element_at(F.lit([x.strip("'") for x in _RAW]), (i % 5 + 1).cast("int")), i.cast("string"), F.lit(".py "))
    rule = F.when(i % 3 == 0, "SEC-EVAL").when(i % 3 == 1, "SEC-LOG-FORGING").otherwise(F.concat(F.lit("OTHER-"), F.col("p_size").cast("string")))
    rows = t("part").select(i, T.normal_path(raw).alias("path"), T.rule_cwe(rule).alias("cwe"))
    return rows.select("p_partkey", "path", "cwe", T.test_path(F.col("path")).alias("is_test"), T.module_name(F.col("path")).alias("module"))


@query("""
WITH v AS (SELECT doc_id, substr(sha256(doc_id::VARCHAR) || sha256(lang), 1, (20 + doc_id % 60)::INT) || ([''  , '=', '==', '===', ' ', '-'])[(doc_id % 6 + 1)::INT] AS x FROM documents)
SELECT doc_id, length(x) >= 32 AND length(x) % 4 = 0 AND regexp_matches(x, '^[A-Za-z0-9+/]+={0,2}$') AS bare FROM v""")
def bare_base64_values(t):
    i = F.col("doc_id")
    value = F.concat(F.substring(F.concat(F.sha2(i.cast("string"), 256), F.sha2("lang", 256)), F.lit(1), (20 + i % 60).cast("int")), F.element_at(F.lit(["", "=", "==", "===", " ", "-"]), (i % 6 + 1).cast("int")))
    return t("documents").select("doc_id", T.bare_base64(value).alias("bare"))


_VALUES = ["<token>", "user_name", "Abcdefghijkl", "abc123!", "short-one", "ABCDEFGHIJKLMNOP", "abcdefghijklmnop9", "a|b", "x.y.z.q.r.s.t.u.v.w", "9lives"]


@query(f"""
WITH v AS (SELECT p_partkey, ([{', '.join(f"'{x}'" for x in _VALUES)}])[(p_partkey % {len(_VALUES)} + 1)::INT] || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-' || p_name END AS x FROM part),
f AS (SELECT *, regexp_matches(x, '[0-9]') AS d, x <> lower(x) AND x <> upper(x) AS m, regexp_matches(x, '[^\\p{{L}}\\p{{N}}_-]') AS s FROM v)
SELECT p_partkey, CASE WHEN regexp_matches(x, '[<>|]') THEN 'marker' WHEN regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$') THEN 'identifier' WHEN (length(x) >= 16 AND (d OR m OR s)) OR (d AND (m OR s)) OR (m AND length(x) >= 12) THEN 'strong' ELSE 'identifier' END AS shape FROM f""")
def credential_shapes(t):
    value = F.concat(F.element_at(F.lit(_VALUES), (F.col("p_partkey") % len(_VALUES) + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("-"), "p_name")))
    return t("part").select("p_partkey", T.credential_shape(value).alias("shape"))


@query(f"WITH {_E} SELECT seq, (2 * (k % 5) + least(8.0::DOUBLE, 0.25::DOUBLE * (seq % 60)) + CASE WHEN rule_id = 'error' THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM e")
def hunk_scores(t):
    return _events(t).select("seq", T.hunk_score(F.col("k") % 5, F.col("seq") % 60, F.col("rule_id") == "error").alias("score"))


_AT = "(o_orderkey * 10)"


@query("""
WITH e AS (SELECT o_orderkey AS e, o_orderkey * 10 AS s FROM orders), p AS (SELECT event_id AS p, event_id * 3 AS line FROM events),
x AS (SELECT e, p, greatest(s - line, line - (s + 3), 0) AS distance, e // 50 AS case_id FROM e JOIN p ON e = (line + 2) // 10 WHERE greatest(s - line, line - (s + 3), 0) <= 2)
SELECT case_id, e, p, distance FROM x QUALIFY row_number() OVER (PARTITION BY e ORDER BY distance, p) = 1""")
def matched_truths(t):
    """Largest matchings of truths with predictions within two lines, where each prediction is near one truth only."""
    place = lambda n: F.concat(F.lit("p"), (F.floor(n / 10) % 5).cast("string"))
    n = F.col("o_orderkey")
    expected = t("orders").select(F.floor(n / 50).alias("case_id"), n.alias("e"), place(n).alias("path"), F.lit("cwe-89").alias("cwe"), (n * 10).alias("start_line"), (n * 10 + 3).alias("end_line"))
    line = F.col("event_id") * 3
    m = F.floor((line + 2) / 10)
    predicted = t("events").select(F.floor(m / 50).alias("case_id"), F.col("event_id").alias("p"), F.concat(F.lit("b/"), place(m)).alias("path"), F.lit("SEC-SQL-CONCAT").alias("rule_id"), line.alias("line"))
    return metrics.one_to_one(joins.candidate_edges(expected, predicted)).select("case_id", "e", "p", "distance")


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS line, l_returnflag AS rule_id, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END AS r FROM lineitem),
x AS (SELECT o.o_custkey % 20 AS case_id, o.o_orderkey AS e, p.rule_id, p.r, CASE WHEN o.o_orderstatus = 'F' THEN 2 ELSE 0 END AS least FROM orders o JOIN p ON p.line = o.o_orderkey WHERE o.o_orderstatus <> 'P' OR p.rule_id = 'N')
SELECT case_id, e, rule_id, r >= least AS severity_ok, least >= 2 AS high FROM x QUALIFY row_number() OVER (PARTITION BY e ORDER BY r DESC, rule_id) = 1""")
def greedy_matches(t):
    """Exact matches: the severest prediction at the truth's place, of its rule if it names one."""
    o = t("orders")
    expected = o.select((F.col("o_custkey") % 20).alias("case_id"), F.col("o_orderkey").alias("e"), F.lit("f").alias("path"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderstatus") == "P", "N").alias("rule_id"), F.when(F.col("o_orderstatus") == "F", "high").otherwise("low").alias("min_severity"))
    found = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") % 20).alias("case_id"), F.lit("f").alias("path"), F.col("l_orderkey").alias("line"), F.col("l_returnflag").alias("rule_id"), F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "medium").otherwise("low").alias("severity"))
    return metrics.greedy_match(expected, found).select("case_id", "e", "rule_id", "severity_ok", "high")


_PARTS = "i AS (SELECT p_partkey AS id, p_type AS category, 'f' || p_size AS path, p_brand AS cls, 'n' || (p_partkey % 7) AS name, 'n' || ((p_partkey + 1) % 7) AS call, p_name AS ident, p_retailprice AS score, p_partkey AS line FROM part)"


def _parts(t) -> DataFrame:
    n = lambda d: F.concat(F.lit("n"), ((F.col("p_partkey") + d) % 7).cast("string"))
    return t("part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("path"), F.col("p_brand").alias("cls"), n(0).alias("name"), F.array(n(1)).alias("calls"),
        F.array("p_name").alias("identifiers"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("line"),
    )


@query(f"""
WITH {_PARTS} SELECT a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY b.score DESC, b.path, b.line, b.id) AS rank FROM i a JOIN i b ON a.category = b.category AND a.id <> b.id AND
 ((a.path = b.path AND (a.call = b.name OR b.call = a.name)) OR (a.cls = b.cls AND a.ident = b.ident)) QUALIFY rank <= 4""")
def related_parts(t):
    return joins.related_members(_parts(t)).select("a_id", "b_id", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_PARTS} SELECT a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY b.score DESC, b.line, b.id) AS rank FROM i a JOIN i b ON a.category = b.category AND a.id <> b.id AND a.path = b.path AND a.cls = b.cls AND a.id % 3 > 0 AND b.id % 3 > 0 QUALIFY rank <= 4""")
def pipeline_neighbours(t):
    """Relatives of the same file, class and category that are both steps of a pipeline."""
    return joins.pipeline_neighbours(_parts(t).withColumn("pipeline", F.col("id") % 3 > 0)).select("a_id", "b_id", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_PARTS} SELECT id, row_number() OVER (PARTITION BY category ORDER BY id % 4 = 0, score DESC, path, line, name) AS rank FROM i QUALIFY rank <= 10""")
def signal_ranked_parts(t):
    """The first ten of each category: others before tests, then score, path, line and name."""
    return ranking.by_signal(_parts(t).withColumn("is_test", F.col("id") % 4 == 0), ["category"], 10).select("id", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT c_custkey, 'cwe' AS cwe FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') AND n_regionkey = 2""")
def strict_targets(t):
    """Findings whose weakness, path and symbol all equal a target's."""
    found = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lit("cwe").alias("cwe"), F.col("n_name").alias("path"), F.col("c_mktsegment").alias("symbol"))
    targets = t("nation").where("n_regionkey = 2").select(F.lit("cwe").alias("cwe"), F.col("n_name").alias("path"), F.explode(F.lit(["MACHINERY", "BUILDING"])).alias("symbol"))
    return joins.strict_semi(found, targets.unionByName(targets)).select("c_custkey", "cwe")


@query(f"WITH {_E} SELECT path || ':' || rule_id AS gap, min(seq) AS seq FROM e WHERE k % 2 = 0 GROUP BY ALL")
def first_seen_gaps(t):
    """Distinct gaps in the order in which they were first seen."""
    return merge.first_seen(_events(t).where("k % 2 = 0").select(F.concat_ws(":", "path", "rule_id").alias("gap"), "seq"), "gap")


@query("SELECT DISTINCT path FROM (SELECT 'x/' || (o_custkey % 40) AS path FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'x/' || (c_custkey % 60) FROM customer WHERE c_mktsegment = 'MACHINERY')")
def trust_boundaries(t):
    at = lambda c, n: F.concat(F.lit("x/"), (F.col(c) % n).cast("string")).alias("path")
    return review.trust_boundaries(t("orders").where("o_orderstatus = 'O'").select(at("o_custkey", 40)), t("customer").where("c_mktsegment = 'MACHINERY'").select(at("c_custkey", 60)))


@query("""
SELECT l_orderkey, l_linenumber, o_orderpriority AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def strict_lookups(t):
    """Line items with their order's priority; a missing order raises."""
    known = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return lookups.must_find(t("lineitem").select("l_orderkey", "l_linenumber"), known, "l_orderkey", "priority").select("l_orderkey", "l_linenumber", "priority")


@query("""
WITH l AS (SELECT doc_id, 'src/' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents), a AS (SELECT path, i AS line, ls[i] AS content FROM l, unnest(range(1, len(ls) + 1)) u(i) WHERE NOT (i = len(ls) AND ls[i] = ''))
SELECT f.doc_id, f.line, coalesce(f.evidence <> '' AND contains(a.content, f.evidence), false) AS grounded FROM (SELECT doc_id, path, doc_id % 5 + 1 AS line, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'no such words' ELSE substr(ls[1], 2, 12) END AS evidence FROM l) f LEFT JOIN a ON a.path = f.path AND a.line = f.line""")
def grounded_findings(t):
    """Findings whose evidence is part of the line they name, of another one, empty, or nowhere."""
    from strata.sources import diffs

    files = t("documents").select(F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")
    evidence = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "no such words").otherwise(F.substring(F.split("text", "\n")[0], 2, 12))
    found = files.select("doc_id", "path", (F.col("doc_id") % 5 + 1).alias("line"), evidence.alias("evidence"))
    return joins.quoted_evidence(found, diffs.whole_file_as_added(files)).select("doc_id", "line", "grounded")


@query(f"""
WITH {_E}, c AS (SELECT seq AS candidate_id, 'f' || path AS path, k % 12 AS fn, line FROM e),
v AS (SELECT o_orderkey AS evidence_id, o_custkey * 10 AS candidate_id, o_custkey % 7 AS d, o_orderkey % 5 AS how FROM orders)
SELECT evidence_id, CASE WHEN c.candidate_id IS NULL THEN 'unknown-candidate' WHEN how = 0 THEN 'path-mismatch' WHEN d IN (3, 6) THEN 'line-outside-range' WHEN how = 1 THEN 'symbol-mismatch' ELSE 'bound' END AS reason FROM v LEFT JOIN c USING (candidate_id)""")
def bound_evidence(t):
    """Why evidence doesn't bind to its candidate: no such candidate, another path, a line outside both ranges, another symbol."""
    rng = lambda a, b: F.struct((F.col("line") + a).alias("start"), (F.col("line") + b).alias("end"))
    usr = F.concat(F.lit("ns::fn"), (F.col("k") % 12).cast("string"))
    candidates = _events(t).select(F.col("seq").alias("candidate_id"), F.concat(F.lit("f"), "path").alias("path"), usr.alias("function_usr"), rng(0, 2).alias("release_range"), rng(4, 5).alias("use_range"), "line", "k")
    o = t("orders").select(F.col("o_orderkey").alias("evidence_id"), (F.col("o_custkey") * 10).alias("candidate_id"), (F.col("o_custkey") % 7).alias("d"), (F.col("o_orderkey") % 5).alias("how"))
    known = candidates.select("candidate_id", F.col("path").alias("p"), F.col("line").alias("l"), F.col("k").alias("kk"))
    symbol = F.when(F.col("how") == 1, "fn").otherwise(F.concat(F.lit("fn"), (F.col("kk") % 12).cast("string")))
    evidence = o.join(known, "candidate_id", "left").select("evidence_id", "candidate_id", F.when(F.col("how") == 0, "elsewhere").otherwise(F.col("p")).alias("path"), (F.col("l") + F.col("d")).alias("line"), symbol.alias("symbol"))
    return joins.bind_point(evidence, candidates.drop("line", "k")).select("evidence_id", "reason")


@query(f"""
WITH c AS (SELECT p_partkey AS candidate_id, 'f' || p_size AS path, 'CWE-' || (p_partkey % 2) AS cwe, 'fn' || (p_partkey % 9) AS symbol FROM part),
f AS (SELECT event_id, 'f' || (user_id % 50) AS path, 'a::fn' || (event_id % 9) AS symbol, 'CWE-' || (event_id % 2) AS cwe, event_type AS tool, 'r' || (event_id % 4) AS run_id FROM events WHERE event_id % 3 = 0),
r(run_id, tool, status) AS (VALUES ('r0', 'click', 'completed'), ('r1', 'view', 'completed'), ('r2', 'error', 'failed'), ('r3', 'error', 'completed')),
x AS (SELECT candidate_id, c.cwe = f.cwe AND r.tool IS NOT NULL AND r.tool = f.tool AS good, f.run_id FROM c JOIN f ON c.path = f.path AND f.symbol = 'a::' || c.symbol LEFT JOIN r ON r.run_id = f.run_id AND r.status = 'completed')
SELECT candidate_id, coalesce(bool_or(coalesce(good, false)), false) AS corroborated, coalesce(bool_or(NOT coalesce(good, false)) FILTER (WHERE x.candidate_id IS NOT NULL), false) AS conflict, coalesce(string_agg(DISTINCT run_id, ',' ORDER BY run_id) FILTER (WHERE good), '') AS run_ids FROM c LEFT JOIN x USING (candidate_id) GROUP BY candidate_id""")
def corroborated_candidates(t):
    """Candidates against other tools' findings: corroborated, in conflict, both or neither."""
    s = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    c = t("part").select(F.col("p_partkey").alias("candidate_id"), F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("path"), s("fn", "p_partkey", 9).alias("symbol"), F.lit(1).alias("line"), s("CWE-", "p_partkey", 2).alias("cwe"))
    f = t("events").where("event_id % 3 = 0").select(s("f", "user_id", 50).alias("path"), s("a::fn", "event_id", 9).alias("symbol"), F.lit(1).alias("line"), s("CWE-", "event_id", 2).alias("cwe"), F.col("event_type").alias("tool"), s("r", "event_id", 4).alias("run_id"))
    runs = c.sparkSession.createDataFrame([("r0", "click", "completed"), ("r1", "view", "completed"), ("r2", "error", "failed"), ("r3", "error", "completed")], "run_id string, tool string, status string")
    return joins.bind_corroboration(c, f, runs).select("candidate_id", "corroborated", "conflict", F.array_join("run_ids", ",").alias("run_ids"))


@query("""
WITH ev AS (SELECT o_custkey AS candidate_id, CASE o_orderkey % 2 WHEN 0 THEN 'supports' ELSE 'refutes' END AS polarity, o_orderpriority <> '5-LOW' AS done FROM orders WHERE o_orderkey % 3 = 0),
s AS (SELECT candidate_id, bool_or(done) AS any_done, bool_or(done AND polarity = 'refutes') AS no, bool_or(done AND polarity = 'supports') AS yes FROM ev GROUP BY 1), c AS (SELECT c_custkey AS candidate_id, c_mktsegment = 'MACHINERY' AS refuted FROM customer)
SELECT c.candidate_id, CASE WHEN coalesce(no, false) AND refuted THEN 'contradict' WHEN coalesce(yes, false) AND NOT refuted THEN 'support' ELSE 'no-evidence' END AS verdict, CASE WHEN any_done IS NOT NULL AND NOT any_done THEN 'provenance-incomplete' END AS gap FROM c LEFT JOIN s USING (candidate_id)""")
def provenance_verdicts(t):
    """support, contradict or no evidence, by completed runs and refuted obligations."""
    c = t("customer").select(F.col("c_custkey").alias("candidate_id"), "c_mktsegment")
    ev = t("orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 2 == 0, "supports").otherwise("refutes").alias("polarity"), F.col("o_orderpriority").alias("run_id"))
    runs = t("orders").select(F.col("o_orderpriority").alias("run_id"), F.when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("completed").alias("status")).distinct()
    statuses = c.select("candidate_id", F.when(F.col("c_mktsegment") == "MACHINERY", "REFUTED").otherwise("SATISFIED").alias("status"))
    return review.provenance_verdicts(c, ev, runs, statuses)


@query(f"""
WITH {_E}, f AS (SELECT seq, rule_id, k, path, line FROM e)
SELECT seq AS finding_id, '# ' || 'a''b c ' || k || chr(10) || chr(10) || '- Rule: `' || rule_id || '`' || chr(10) || '- Severity: `low`' || chr(10) || '- Weakness: ``' || chr(10) || '- Place: `' || path || '`' || chr(10) || '- Line: `' || line || '`' || chr(10) || chr(10) || 'see '' note' AS body FROM f""")
def dossier_pages(t):
    """A page for each finding; marks and line ends in its cells are made harmless."""
    rows = _events(t).select(F.col("seq").alias("finding_id"), F.concat(F.lit("a`b\r\nc "), F.col("k").cast("string")).alias("title"), "rule_id", F.lit("low").alias("severity"), F.lit(None).cast("string").alias("cwe"), "path", "line", F.lit("see ` note").alias("explanation"))
    return review.dossiers(rows)
