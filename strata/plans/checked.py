"""Audits of payloads, wire bundles and shortened budgets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import audit, graph, ranking
from strata.plans.catalog import query
from strata.sources import wire

_AUDITED = """a AS (
SELECT event_id, 1 AS seq, 'm0.m0[1]' AS path, 0 AS start, 64 AS length, NULL AS error FROM events WHERE event_id % 6 = 0 UNION ALL
SELECT event_id, unnest([1, 2]), unnest(['m0', 'm1.m1']), unnest([2, 0]), unnest([64, 64]), NULL FROM events WHERE event_id % 6 = 1 UNION ALL
SELECT event_id, NULL, '[0][0][0][0]', NULL, NULL, 'MAX_DEPTH_EXCEEDED' FROM events WHERE event_id % 6 = 2 UNION ALL SELECT event_id, NULL, 'findings', NULL, NULL, 'RESOURCE_LIMIT_EXCEEDED' FROM events WHERE event_id % 6 = 3 AND event_id % 5 > 2 UNION ALL
SELECT event_id, i, '[' || (i - 1) || ']', 0, 64, NULL FROM events, unnest(range(1, 2 + event_id % 5)) u(i) WHERE event_id % 6 = 3 AND event_id % 5 <= 2 UNION ALL
SELECT event_id, NULL, NULL, NULL, NULL, 'NOT_JSON' FROM events WHERE event_id % 6 = 4)"""


def _audited(t) -> DataFrame:
    i = F.col("event_id")
    run = F.sha2(i.cast("string"), 256)
    several = F.array_join(F.array_repeat(F.concat(F.lit('"'), run, F.lit('"')), (1 + i % 5).cast("int")), ", ")
    payload = (
        F.when(i % 6 == 0, F.concat(F.lit('{"meta": {"list": [1, "'), run, F.lit('"], "b": null}}'))).when(i % 6 == 1, F.concat(F.lit('{"z": "x '), run, F.lit(' y", "a": {"q": 1.50, "b": "'), run, F.lit('"}}')))
        .when(i % 6 == 2, F.lit('[[[[["deep"]]]], "x"]')).when(i % 6 == 3, F.concat(F.lit("["), several, F.lit("]"))).when(i % 6 == 4, F.col("props").substr(F.lit(1), F.length("props") - 1)).otherwise(F.lit('"plain"'))
    )
    return audit.audited(t("events").select("event_id", payload.alias("payload")), ["event_id"], max_depth=4, max_items=3)


@query(f"WITH {_AUDITED} SELECT * FROM a")
def audited_payloads(t):
    """Long runs in event payloads by ordinal path, and payloads that are too deep, have too many, or aren't JSON."""
    return _audited(t).select("event_id", "seq", "path", "start", "length", "error")


@query(f"""
WITH {_AUDITED} SELECT event_id // 4 AS report, count(DISTINCT event_id) AS sources, CASE WHEN max(x) IS NULL THEN count(start) END AS findings, max(x) AS error
FROM (SELECT *, CASE WHEN count(DISTINCT event_id % 8 // 7) OVER (PARTITION BY event_id // 4) > 1 THEN 'POLICY_ERROR: report.tenant_mixing' ELSE min(error) OVER (PARTITION BY event_id // 4) END AS x FROM a) GROUP BY ALL""")
def audit_reports(t):
    """Reports over four payloads each; some hold two tenants' payloads, some a payload that can't be audited."""
    rows = _audited(t).withColumns({"report": F.floor(F.col("event_id") / 4), "tenant": F.floor(F.col("event_id") % 8 / 7)})
    return audit.reports(rows, "report", "tenant", "event_id")


@query("""
WITH RECURSIVE n AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS nth FROM part),
r(p_brand, nth, p_partkey, name, shortened, used) AS (
 SELECT p_brand, nth, p_partkey, substr(p_name, 1, 100), strlen(p_name) > 100, least(strlen(p_name), 100) FROM n WHERE nth = 1 UNION ALL
 SELECT n.p_brand, n.nth, n.p_partkey, substr(n.p_name, 1, 100 - r.used), r.used + strlen(n.p_name) > 100, least(r.used + strlen(n.p_name), 100) FROM r JOIN n ON n.p_brand = r.p_brand AND n.nth = r.nth + 1 WHERE NOT r.shortened AND r.used < 100)
SELECT p_brand, p_partkey, name, shortened FROM r""")
def shortened_parts(t):
    """The dearest parts of each brand whose names fill a hundred bytes; the last is cut to what is left."""
    rows = t("part").select("p_brand", "p_partkey", "p_retailprice", F.col("p_name").alias("name"))
    return ranking.budget_shorten(rows, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], "name", 100).select("p_brand", "p_partkey", "name", "shortened")


_WRONG = [
    ("bundle", "bundle-digest"), ("bundle", "unknown-field:note"), ("bundle", "missing-field:diagnostics"), ("bundle", "duplicate-field:request_id"), ("bundle", "schema-version"), ("bundle", "snapshot-hash"), ("unit/0", "unknown-field:x"),
    ("unit/0", "context-hash"), ("unit/0", "coverage-flags"), ("unit/0", "unsafe-path"), ("unit/0/fact/0", "unknown-field:release_api"), ("unit/0/fact/1", "dangling-reference"), ("unit/0/fact/1", "duplicate-id"), ("unit/0/fact/0", "unknown-kind"),
    ("unit/0/fact/1", "unsafe-path"), ("unit/0/fact/0", "source-range"), ("unit/0/fact/1", "unit-mismatch"), ("unit/0/fact/0", "fact-id"), ("unit/0/fact/1", "missing-field:related_fact_ids"), ("unit/0", "missing-field:coverage.semantic_gaps"),
]


@query(f"""
WITH w(i, place, violation) AS (VALUES {', '.join(f"({i + 1}, '{p}', '{v}')" for i, (p, v) in enumerate(_WRONG))}) SELECT o_orderkey AS bundle_id, place, violation FROM orders JOIN w ON o_orderkey % {len(_WRONG) + 3} = i""")
def wire_violations(t):
    """Bundles of an allocation and its release, of which most have one thing wrong, each in its own place."""
    k, form = F.col("o_orderkey"), F.col("o_orderkey") % (len(_WRONG) + 3)
    which = {"unit-path" if (p, v) == ("unit/0", "unsafe-path") else v: i + 1 for i, (p, v) in enumerate(_WRONG)}
    pick = lambda name, wrong, right: F.when(form == which[name], wrong).otherwise(right)
    text = lambda v: F.concat(F.lit('"'), F.lit(v) if isinstance(v, str) else v, F.lit('"'))
    hexed = lambda p: F.sha2(F.concat(F.lit(p), k.cast("string")), 256)

    def made(*fields) -> Column:
        """An object in canonical form of (name, value) in the names' order; a null value leaves its field out."""
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.lit(v) if isinstance(v, str) else v) for n, v in fields]), F.lit("}"))

    none = F.lit(None).cast("string")
    path = F.lit("src/a.c")
    common = lambda fact_id, kind, where, unit, span: [("canonical_path", text(where)), ("cfg_block", "1"), ("fact_id", text(fact_id)), ("function_usr", '"f"'), ("kind", text(kind)), ("source_range", span), ("translation_unit", text(unit))]
    first_id = pick("fact-id", F.lit("abc"), hexed("a"))
    unit_path = pick("unit-path", "/src/a.c", path)
    a = common(first_id, pick("unknown-kind", "odd", "allocation"), path, unit_path, pick("source-range", "[9,3]", "[3,9]")) + [("allocation_api", '"malloc"'), ("pointer_id", '"p"'), ("release_api", pick("unknown-field:release_api", '"x"', none))]
    r = common(pick("duplicate-id", hexed("a"), hexed("r")), "release", pick("unsafe-path", "src/../a.c", path), pick("unit-mismatch", "src/b.c", unit_path), "[12,12]")
    r += [("pointer_id", '"p"'), ("related_fact_ids", pick("missing-field:related_fact_ids", none, F.concat(F.lit("["), text(pick("dangling-reference", hexed("z"), first_id)), F.lit("]")))), ("release_api", '"free"')]
    ordered = lambda fields: made(*sorted(fields, key=lambda f: f[0]))
    context = made(("context_hash", text(pick("context-hash", hexed("d"), hexed("c")))), ("diagnostics", "[]"), ("source_kind", '""'), ("status", '"resolved"'))
    coverage = made(("ast_complete", pick("coverage-flags", '"true"', "true")), ("cfg_complete", "true"), ("semantic_gaps", pick("missing-field:coverage.semantic_gaps", none, "[]")))
    unit = made(("build_context", context), ("coverage", coverage), ("extraction", '"completed"'), ("facts", F.concat(F.lit("["), ordered(a), F.lit(","), ordered(r), F.lit("]"))), ("translation_unit", text(unit_path)), ("x", pick("unknown-field:x", "1", none)))
    digest = F.sha2(F.concat(F.lit('{"translation_units":['), unit, F.lit("]}")), 256)
    raw = made(
        ("translation_units", F.concat(F.lit("[ "), F.replace(unit, F.lit('"cfg_block":1'), F.lit('"cfg_block" : 1')), F.lit("]"))), ("schema_version", pick("schema-version", '"1"', "1")), ("request_id", '"r"'), ("repository_key", '"k"'),
        ("request_id", pick("duplicate-field:request_id", '"r"', none)), ("snapshot_sha256", text(pick("snapshot-hash", hexed("t"), hexed("s")))), ("tool_runs", "[]"), ("bundle_sha256", text(pick("bundle-digest", hexed("b"), digest))),
        ("diagnostics", pick("missing-field:diagnostics", none, "[]")), ("note", pick("unknown-field:note", "{}", none)),
    )
    bundles = graph.dealt(t("orders").select("o_orderkey"), "o_orderkey").select(k.alias("bundle_id"), raw.alias("raw"), hexed("s").alias("snapshot_hash"), hexed("c").alias("context_hash"), F.lit("src").alias("root"))
    return wire.violations(bundles)
