"""Line scans of documents, merging and ranking of what they find, and text classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import digests
from strata.functions import text as T
from strata.operators import lookups, merge, metrics, privacy, rules
from strata.plans.catalog import query
from strata.sources import corpus

# Rules that the generated documents hit: (id, severity, source, weakness, pattern).
DOCUMENT_RULES = [
    *rules.SOURCE_RULES,
    ("TXT-KEYWORD", "medium", "local-rules", "CWE-200", r"(?i)(password|secret|token)"),
    ("TXT-ASSIGNED-SECRET", "high", "local-rules", "CWE-798", r"(?i)\b(password|token|secret)\s*=\s*\S{8,}"),
    ("TXT-CLOUD-KEY", "critical", "privacy-rules", "CWE-798", r"AKIA[0-9A-Z]{16}"),
    ("TXT-LONG-RUN", "medium", "privacy-rules", "CWE-798", r"[A-Za-z0-9+/]{32,}"),
    ("TXT-EMAIL", "low", "privacy-rules", "CWE-359", r"[a-z0-9.]+@[a-z0-9.]+\.com"),
    ("TXT-CARD", "high", "privacy-rules", "CWE-359", r"[0-9]{16}"),
]


def rule_hits(lines: DataFrame) -> DataFrame:
    return rules.line_hits(lines, DOCUMENT_RULES)


def _lines(t) -> DataFrame:
    return corpus.text_lines(t("documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text"), ["path"])


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_LINES = "lines AS (SELECT path, i AS line, ls[i] AS content FROM (SELECT source || '/' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '') d, unnest(range(1, len(ls) + 1)) u(i) WHERE NOT (i = len(ls) AND ls[i] = ''))"
_HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT path, line, content, {i} AS seq, '{r}' AS rule_id, '{s}' AS severity, '{src}' AS source, '{cwe}' AS cwe FROM lines WHERE regexp_matches(content, '{_quoted(p)}')" for i, (r, s, src, cwe, p) in enumerate(DOCUMENT_RULES)
) + ")"
_RANK = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


@query(f"""
WITH {_LINES}, {_HITS}, merged AS (SELECT path, line, cwe AS weakness, arg_min(rule_id, seq) AS rule_id, count(*) AS n_merged, string_agg(DISTINCT source, '+' ORDER BY source) AS source, max({_RANK}) AS r, count(DISTINCT source) AS k FROM hits GROUP BY ALL)
SELECT path, line, weakness, rule_id, n_merged, source, CASE r WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN k = 1 THEN 0.9::DOUBLE ELSE 0.9::DOUBLE + 0.03::DOUBLE END AS confidence, CASE WHEN k = 1 THEN 'unverified' ELSE 'corroborated' END AS verification_state,
  substr(sha256(rule_id || chr(0) || path || chr(0) || line), 1, 24) AS fingerprint FROM merged""")
def corpus_findings(t):
    """The flagship scan: documents to lines, lines to findings, findings merged by place and weakness."""
    merged = merge.merge_findings(rule_hits(_lines(t)))
    mark = digests.joined_digest(F.col("rule_id"), F.col("path"), F.col("line"), size=24)
    return merged.select("path", F.col("line").cast("long").alias("line"), "weakness", "rule_id", "n_merged", "source", "severity", "confidence", "verification_state", mark.alias("fingerprint"))


@query(f"WITH {_LINES}, {_HITS} SELECT rule_id, severity, count(*) AS hits, count(DISTINCT path) AS files, min(line)::BIGINT AS first_line FROM hits GROUP BY ALL")
def rule_hit_counts(t):
    return rule_hits(_lines(t)).groupBy("rule_id", "severity").agg(F.count("*").alias("hits"), F.count_distinct("path").alias("files"), F.min("line").cast("long").alias("first_line"))


@query(f"WITH {_LINES}, {_HITS} SELECT path, line, rule_id, severity FROM hits ORDER BY {_RANK} DESC, path, line, rule_id LIMIT 100")
def ranked_findings(t):
    """The hundred severest findings in report order."""
    hits = rule_hits(_lines(t)).select("path", F.col("line").cast("long").alias("line"), "rule_id", "severity")
    return hits.orderBy(F.desc(T.severity_rank(F.col("severity"))), "path", "line", "rule_id").limit(100)


@query(f"WITH {_LINES}, {_HITS} SELECT coalesce(max(CASE {_RANK} WHEN 3 THEN 'd' WHEN 2 THEN 'c' WHEN 1 THEN 'b' ELSE 'a' END), 'a') = 'd' AS is_critical, CASE max({_RANK}) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk FROM hits")
def corpus_risk(t):
    return metrics.risk(rule_hits(_lines(t))).select((F.col("risk") == "critical").alias("is_critical"), "risk")


@query(f"""
WITH {_LINES}, {_HITS}, f AS (SELECT rule_id, CASE WHEN severity = 'critical' THEN 'confirmed' WHEN severity = 'low' THEN 'dismissed' ELSE 'needs_review' END AS d FROM hits)
SELECT count(*) FILTER (WHERE d = 'confirmed') AS confirmed, count(*) FILTER (WHERE d = 'needs_review') AS needs_review, count(*) FILTER (WHERE d = 'dismissed') AS dismissed,
  CASE WHEN count(*) FILTER (WHERE d = 'confirmed') > 0 THEN 'alert' WHEN count(*) FILTER (WHERE d = 'needs_review') > 0 THEN 'needs_review' ELSE 'all-clear' END AS outcome FROM f""")
def adjudicated_counts(t):
    hits = rule_hits(_lines(t))
    return metrics.dispositions(hits.withColumn("disposition", F.when(F.col("severity") == "critical", "confirmed").when(F.col("severity") == "low", "dismissed").otherwise("needs_review")))


@query(f"WITH {_LINES}, {_HITS} SELECT path, line, rule_id FROM hits QUALIFY row_number() OVER (PARTITION BY path, cwe ORDER BY {_RANK} DESC, line, seq) = 1")
def arbitrated_findings(t):
    """One finding for each file and weakness: the severest, then the first."""
    hits = rule_hits(_lines(t)).withColumn("rank", -T.severity_rank(F.col("severity")))
    return merge.first_by(hits, ["path", "cwe"], "rank", "line", "seq").select("path", F.col("line").cast("long").alias("line"), "rule_id")


@query(f"WITH {_LINES}, n AS (SELECT path, count(*) AS n_lines, max(length(content)) AS longest, count(*) FILTER (WHERE content = '') AS empty_lines FROM lines GROUP BY path) SELECT * FROM n")
def line_inventory(t):
    return _lines(t).groupBy("path").agg(F.count("*").alias("n_lines"), F.max(F.length("content")).cast("long").alias("longest"), F.count_if(F.col("content") == "").alias("empty_lines"))


@query(f"WITH {_LINES} SELECT path, line, content FROM lines WHERE contains(lower(content), 'licensed under') ORDER BY path, line LIMIT 200")
def code_search(t):
    """The first two hundred lines with a literal, whatever its case."""
    hits = _lines(t).where(F.contains(F.lower("content"), F.lit("licensed under")))
    return hits.orderBy("path", "line").limit(200).select("path", F.col("line").cast("long").alias("line"), "content")


@query(f"WITH {_LINES} SELECT path, line FROM lines WHERE regexp_matches(content, '\\bMIT\\b') ORDER BY path, line LIMIT 200")
def symbol_references(t):
    return _lines(t).where(F.col("content").rlike(r"\bMIT\b")).orderBy("path", "line").limit(200).select("path", F.col("line").cast("long").alias("line"))


_CLASS = """CASE WHEN regexp_matches(x, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(x, '[A-Za-z][A-Za-z0-9+.\\-]*://[^\\s/:@]+:[^\\s/@]+@') THEN 'restricted'
 WHEN contains(lower(x), 'secret') OR contains(lower(x), 'token') OR contains(lower(x), 'key') OR contains(lower(x), 'password') OR contains(lower(x), 'credential') THEN 'sensitive'
 WHEN regexp_matches(x, '[A-Za-z0-9+/]{32,}={0,2}') THEN 'sensitive' ELSE 'internal' END"""


@query(f"SELECT doc_id, {_CLASS.replace('x,', 'text,').replace('(x)', '(text)')} AS classification FROM documents")
def classified_documents(t):
    return t("documents").select("doc_id", T.classify_text(F.col("text")).alias("classification"))


@query(f"SELECT role, {_CLASS.replace('x,', 'text,').replace('(x)', '(text)')} AS classification, count(*) AS n FROM conversations GROUP BY ALL")
def classified_turns(t):
    return t("conversations").select("role", T.classify_text(F.col("text")).alias("classification")).groupBy("role", "classification").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '' ELSE '[REDACTED]' END || ' ' || substr(text, 1, 100) AS text FROM documents""")
def masked_documents(t):
    """Documents behind a secret of one of three well-known forms, or none, with secrets masked."""
    mark = F.sha2(F.col("doc_id").cast("string"), 256)
    secret = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("AKIA"), F.upper(F.substring(mark, 1, 16)))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("ghp_"), mark)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("xoxb-"), mark)).otherwise("")
    return t("documents").select("doc_id", T.masked_secrets(F.concat_ws(" ", secret, F.substring("text", 1, 100))).alias("text"))


_CODE = [
    "result = eval(request)", "run(command, shell=True)", "password = 'correct horse'", "db.execute(f'select {x}')", "except Exception:", "print(value)", "total = a + b", "# a comment",
]
_SUFFIXES = [".py", ".c", ".js", ".lock", ".min.js", ".CPP", ".map", ".txt"]
_SOURCES = f"""files AS (SELECT 'src/' || doc_id || ([{', '.join(f"'{x}'" for x in _SUFFIXES)}])[(doc_id % 8 + 1)::INT] AS path,
  ([{', '.join("'" + _quoted(x) + "'" for x in _CODE)}])[(doc_id % 7 + 1)::INT] || chr(10) || ([{', '.join("'" + _quoted(x) + "'" for x in _CODE)}])[(doc_id // 8 % 8 + 1)::INT] || chr(10) || text AS text FROM documents),
slines AS (SELECT path, i AS line, ls[i] AS content FROM (SELECT path, string_split(text, chr(10)) AS ls FROM files) d, unnest(range(1, len(ls) + 1)) u(i) WHERE NOT (i = len(ls) AND ls[i] = ''))"""


def _source_lines(t) -> DataFrame:
    code = lambda k: F.element_at(F.lit(_CODE), k.cast("int"))
    i = F.col("doc_id")
    path = F.concat(F.lit("src/"), i.cast("string"), F.element_at(F.lit(_SUFFIXES), (i % 8 + 1).cast("int")))
    files = t("documents").select(path.alias("path"), F.concat_ws("\n", code(i % 7 + 1), code(F.floor(i / 8) % 8 + 1), "text").alias("text"))
    return corpus.text_lines(files, ["path"])


_SHITS = " UNION ALL ".join(
    f"SELECT path, line, content, '{r}' AS rule_id, '{s}' AS severity, '{cwe}' AS cwe FROM slines WHERE regexp_matches(content, '{_quoted(p)}') AND NOT regexp_matches(lower(path), '\\.(lock|min\\.js|map)$')"
    + (" AND NOT regexp_matches(lower(path), '\\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$')" if r == "SEC-EVAL" else "") for r, s, src, cwe, p in rules.SOURCE_RULES
)


@query(f"WITH {_SOURCES} SELECT path, line, rule_id, severity, cwe, substr(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), 1, 240) AS evidence, 0.9::DOUBLE AS confidence FROM ({_SHITS})")
def source_rule_findings(t):
    """The six line rules over sources of eight suffixes; locked, generated and, for one rule, native files are passed over."""
    hits = rules.line_hits(_source_lines(t), rules.SOURCE_RULES)
    return hits.select("path", F.col("line").cast("long").alias("line"), "rule_id", "severity", "cwe", "evidence", "confidence")


@query(f"""
WITH {_SOURCES}, r(rule_id, include, exclude, literal, fold) AS (VALUES ('D1', ['src/1', 'src/2'], ['src/11'], 'EVAL(', true), ('D2', []::VARCHAR[], ['src/3'], 'Shell', false), ('D3', ['src/'], []::VARCHAR[], 'shell', false), ('D4', ['lib/'], []::VARCHAR[], 'print', true))
SELECT path, line, rule_id FROM slines, r WHERE (len(include) = 0 OR len(list_filter(include, lambda p: starts_with(path, p))) > 0) AND len(list_filter(exclude, lambda p: starts_with(path, p))) = 0
  AND CASE WHEN fold THEN contains(lower(content), lower(literal)) ELSE contains(content, literal) END""")
def declared_rule_findings(t):
    """Rules that are rows: prefixes to include and exclude, a literal, and whether its case matters."""
    lines = _source_lines(t)
    declared = lines.sparkSession.createDataFrame(
        [("D1", ["src/1", "src/2"], ["src/11"], "EVAL(", True), ("D2", [], ["src/3"], "Shell", False), ("D3", ["src/"], [], "shell", False), ("D4", ["lib/"], [], "print", True)],
        "rule_id string, include array<string>, exclude array<string>, literal string, fold boolean",
    )
    return rules.declared_hits(lines, declared).select("path", F.col("line").cast("long").alias("line"), "rule_id")


@query("SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, ceil(strlen(text) / 4)) END::BIGINT AS tokens, substr(sha256(source || chr(0) || doc_id || chr(0) || lang), 1, 16) AS identity FROM documents")
def token_estimates(t):
    identity = digests.joined_digest(F.col("source"), F.col("doc_id"), F.col("lang"), size=16)
    return t("documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"), identity.alias("identity"))


@query("SELECT user_id, (('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 100)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def hash_buckets(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("bucket", digests.bucket(F.col("user_id")).cast("long"))


@query("SELECT event_id, CASE WHEN regexp_matches(v, '^[=+\\-@\\t]') THEN '''' || v ELSE v END AS cell FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '=' || props ELSE props END AS v FROM events)")
def guarded_cells(t):
    value = F.when(F.col("event_type") == "error", F.concat(F.lit("="), "props")).otherwise(F.col("props"))
    return t("events").select("event_id", T.csv_cell(value).alias("cell"))


@query("SELECT event_type, coalesce(json_extract_string(props, '$.kind'), 'review') AS kind, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY ALL")
def promoted_fields(t):
    kind = F.coalesce(F.get_json_object("props", "$.kind"), F.lit("review"))
    return t("events").groupBy("event_type", kind.alias("kind")).agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count("*").alias("n"))


@query("""
SELECT doc_id, greatest(0.0::DOUBLE, least(3.0::DOUBLE, ((length(c) - length(replace(c, 'tion', ''))) / 4)) * 2.0::DOUBLE + least(3.0::DOUBLE, ((length(c) - length(replace(c, 'password', ''))) / 8)) * 5.0::DOUBLE) AS score
FROM (SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS c FROM documents)""")
def signal_scores(t):
    return t("documents").select("doc_id", T.signal_score(F.col("text"), {"tion": 2.0, "password": 5.0}).alias("score"))


@query("""
SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_./:-]{2,}'), lambda x: lower(x))))::BIGINT AS n_terms FROM documents""")
def term_counts(t):
    return t("documents").select("doc_id", F.size(T.term_set(F.col("text"))).cast("long").alias("n_terms"))


_PATHED = "(SELECT doc_id, (CASE WHEN lang = 'en' THEN 'src/' WHEN lang = 'de' THEN 'docs/' ELSE 'pkg/' END) || source || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size FROM documents)"


@query(f"SELECT priority, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT CASE WHEN path LIKE 'docs/%' THEN 2 WHEN path LIKE 'src/%' THEN 0 ELSE 1 END AS priority, size FROM {_PATHED}) GROUP BY priority")
def scan_priorities(t):
    folder = F.when(F.col("lang") == "en", "src").when(F.col("lang") == "de", "docs").otherwise("pkg")
    files = t("documents").select(F.concat_ws("/", folder, "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.octet_length("text").cast("long").alias("size"))
    return files.groupBy(corpus.priority(F.col("path")).alias("priority")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("SELECT 'file-size-limit' AS reason, count(*) AS n FROM documents WHERE strlen(text) > 8192 HAVING count(*) > 0")
def skipped_files(t):
    return corpus.skips(corpus.document_files(t("documents")), max_file_bytes=8192, suffixes=(".txt",))


@query("SELECT source, sha256(string_agg(source || '/' || lang || '-' || doc_id || '.txt' || chr(0) || strlen(text) || chr(0) || sha256(text) || chr(10), '' ORDER BY source || '/' || lang || '-' || doc_id || '.txt')) AS digest FROM documents GROUP BY source")
def inventory_digests(t):
    files = corpus.document_files(t("documents")).select("path", "size", "sha256", F.substring_index("path", "/", 1).alias("source"))
    return corpus.inventory_digest(files, ["source"])


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


_KEYS = ["userName", "apiKEY", "Session_Token", "city", "passWord", "note", "Credentials", "clientSecret", "id"]


@query(f"SELECT event_type, count(*) FILTER (WHERE regexp_matches(lower(key), 'secret|token|key|password|credential')) AS hits, count(*) AS n FROM (SELECT event_type, ([{', '.join(f"'{k}'" for k in _KEYS)}])[(event_id % {len(_KEYS)} + 1)::INT] AS key FROM events) GROUP BY event_type")
def sensitive_keys(t):
    """Fields of events by name: how many names are sensitive, whatever their case."""
    key = F.element_at(F.lit(_KEYS), (F.col("event_id") % len(_KEYS) + 1).cast("int"))
    return t("events").groupBy("event_type").agg(F.count_if(_flag(T.sensitive_key(key))).alias("hits"), F.count("*").alias("n"))


@query("""
SELECT doc_id, len(s)::BIGINT AS spans, array_to_string(s, ' ') AS body FROM (SELECT doc_id, regexp_extract_all(text, '(?:[A-Za-z0-9+/]{4}){7,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})') AS s FROM documents) WHERE len(s) > 0""")
def base64_runs(t):
    """Aligned base64 spans of all documents."""
    rows = t("documents").select("doc_id", privacy.base64_spans(F.col("text")).alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("spans"), F.array_join("s", " ").alias("body"))


@query("""
SELECT event_type, CASE WHEN k % 5 IN (0, 3) THEN 'sensitive' WHEN k % 5 = 1 THEN 'restricted' WHEN k % 5 = 4 AND k % 2 = 0 THEN 'sensitive' ELSE 'internal' END AS classification, count(*) AS n
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL""")
def structured_payloads(t):
    """Event payloads in five wrappings, by their own number, classified by a walk of their JSON: under a sensitive key, beside an address with a password, plain, broken, and with a long run for even numbers."""
    k = F.get_json_object("props", "$.k").cast("long")
    run = F.when(k % 2 == 0, F.sha2(F.col("event_id").cast("string"), 256)).otherwise(F.lit("short"))
    payload = (
        F.when(k % 5 == 0, F.concat(F.lit('{"meta": {"session_token": '), "props", F.lit("}}"))).when(k % 5 == 1, F.concat(F.lit('[{"url": "http://u:p@h/", "x": '), "props", F.lit("}]")))
        .when(k % 5 == 2, F.col("props")).when(k % 5 == 3, F.concat(F.lit("{"), "props")).otherwise(F.concat(F.lit('{"a": [1, {"b": "'), run, F.lit('"}]}')))
    )
    rows = t("events").select("event_id", "event_type", payload.alias("payload"))
    found = privacy.classified(rows, "event_id", "payload")
    return rows.select("event_id", "event_type").join(found, "event_id").groupBy("event_type", "classification").agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN lower(source) IN ('src0', 'src1') THEN 'docs' ELSE '' END AS roles, count(*) AS files FROM documents GROUP BY ALL""")
def path_role_counts(t):
    folder = F.when(F.col("source").isin("src0", "src1"), "docs").otherwise("pkg")
    paths = t("documents").select(F.concat_ws("/", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    return paths.groupBy(F.array_join(T.path_roles(F.col("path")), ",").alias("roles")).agg(F.count("*").alias("files"))


@query(f"""
WITH {_LINES}, h AS (SELECT path, line, content FROM lines WHERE contains(content, 'Apache') ORDER BY path, line LIMIT 21)
SELECT path, line, substr(content, 1, 500) AS content, (SELECT count(*) FROM h) > 20 AS truncated FROM h ORDER BY path, line LIMIT 20""")
def exact_search(t):
    """The first twenty lines with a text as it is written, and whether there are more."""
    return lookups.search(_lines(t).withColumn("line", F.col("line").cast("long")), "Apache")


@query("""
SELECT o_custkey AS entity, 'priority' AS field, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1""")
def conflicting_fields(t):
    """Customers whose orders state different priorities."""
    values = t("orders").select(F.col("o_custkey").alias("entity"), F.lit("priority").alias("field"), F.col("o_orderkey").cast("string").alias("pointer"), F.col("o_orderpriority").alias("value"))
    return lookups.conflicting_fields(values)
