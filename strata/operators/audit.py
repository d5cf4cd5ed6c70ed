"""Audits of structured payloads by levels: ordinal paths, limits on depth and findings, and one tenant a report.

JSON is opened a level at a time in the JVM, each level a reliable checkpoint of its
containers, until none is left. Members are numbered as they stand in the document, so a
path names no key and no value. A payload that is nested too deeply, has too many findings
or isn't JSON gives one error instead of findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators.graph import cut
from strata.operators.privacy import BASE64_SPAN

MAX_DEPTH, MAX_ITEMS = 32, 1000


def _children(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The members of containers: their paths, places, texts and kinds. Texts keep the document's order, which VARIANT doesn't."""
    row = rows.withColumns({"_texts": F.when(F.col("kind") == "OBJECT", F.from_json("text", "map<string,string>")), "_kinds": F.when(F.col("kind") == "OBJECT", F.from_json("text", "map<string,variant>"))})
    row = row.withColumns({"_t": F.when(F.col("kind") == "ARRAY", F.from_json("text", "array<string>")), "_v": F.when(F.col("kind") == "ARRAY", F.from_json("text", "array<variant>"))})
    one = lambda text, value: F.struct(text.alias("text"), value.alias("_value"))
    members = F.coalesce(F.transform(F.map_entries("_texts"), lambda e: one(e["value"], F.col("_kinds")[e["key"]])), F.transform(F.arrays_zip("_t", "_v"), lambda e: one(e["_t"], e["_v"])))
    # One outer explode of both: a union would double the partitions with each level, and Spark filters before other explodes what they explode.
    every = row.select(*keys, "path", "places", "kind", F.posexplode_outer(members).alias("n", "x")).where("n is not null")
    n = F.col("n").cast("string")
    path = F.when(F.col("kind") == "ARRAY", F.concat("path", F.lit("["), n, F.lit("]"))).otherwise(F.concat_ws(".", F.nullif("path", F.lit("")), F.concat(F.lit("m"), n)))
    every = every.select(*keys, path.alias("path"), "places", "n", F.col("x.text").alias("text"), F.col("x._value").alias("_value"))
    return every.select(*keys, "path", F.concat("places", F.array("n")).alias("places"), "text", F.regexp_extract(F.schema_of_variant("_value"), r"^\w+", 0).alias("kind")).where("kind in ('OBJECT', 'ARRAY', 'STRING')")


def _spanned(strings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., path, places, start, end) of each base64 run that may be a secret; a whole such text is one span. Runs are sought once a text, and the explode is outer, as Spark filters before others what they explode."""
    found, between = F.regexp_extract_all("text", F.lit(f"({BASE64_SPAN})"), F.lit(1)), F.split("text", BASE64_SPAN, -1)
    rows = strings.select(*keys, "path", "places", "text", found.alias("_found"), between.alias("_between"))
    upto = lambda parts, i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(x))
    start = lambda i: upto("_between", i) + upto("_found", i - 1)
    each = F.transform(F.sequence(F.lit(1), F.size("_found")), lambda i: F.struct(start(i).alias("start"), F.element_at("_found", i).alias("s")))
    some = F.when(F.size("_found") > 0, F.filter(each, lambda x: T.bare_base64(x["s"])))
    whole = F.when(T.bare_base64(F.col("text")), F.array(F.struct(F.lit(0).alias("start"), F.col("text").alias("s"))))
    spans = rows.select(*keys, "path", "places", F.explode_outer(F.coalesce(whole, some)).alias("x")).where("x is not null")
    return spans.select(*keys, "path", "places", "x.start", (F.col("x.start") + F.length("x.s")).alias("end"))


def audited(payloads: DataFrame, keys: list[str], payload: str = "payload", max_depth: int = MAX_DEPTH, max_items: int = MAX_ITEMS) -> DataFrame:
    """(keys..., path, start, end, length, error): sensitive strings of JSON payloads in document order (``seq``), or the reason why a payload has none.

    The root is at depth 1 and has no path. Spans are counted in characters as they stand. Doubled keys make a payload no JSON.
    """
    parsed = F.try_parse_json(payload)
    roots = payloads.select(*keys, F.lit("").alias("path"), F.array().cast("array<int>").alias("places"), F.col(payload).alias("text"), F.regexp_extract(F.schema_of_variant(parsed), r"^\w+", 0).alias("kind"))
    broken = roots.where("text is not null and kind is null").select(*keys, F.lit("").alias("path"), F.lit("NOT_JSON").alias("error"))
    plain = F.when(F.col("kind") == "STRING", F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")[0]).otherwise(F.col("text"))
    level = cut(roots.where("kind in ('OBJECT', 'ARRAY', 'STRING')").withColumn("text", plain))
    strings, deep, depth = level.where("kind = 'STRING'"), None, 1
    while not (open_ := level.where("kind <> 'STRING'")).isEmpty():
        if depth > max_depth:
            deep = open_.groupBy(*keys).agg(F.min_by("path", "places").alias("path")).withColumn("error", F.lit("MAX_DEPTH_EXCEEDED"))
            break
        level = cut(_children(open_, keys))
        strings, depth = strings.unionByName(level.where("kind = 'STRING'")), depth + 1
    errors = broken if deep is None else broken.unionByName(deep.select(*keys, "path", "error"))
    hits = cut(_spanned(strings, keys).join(errors.select(*keys), keys, "left_anti"))
    over = hits.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > max_items).select(*keys, F.lit("findings").alias("path"), F.lit("RESOURCE_LIMIT_EXCEEDED").alias("error"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("places", "start")).alias("seq")
    kept = hits.join(over.select(*keys), keys, "left_anti").select(*keys, order, F.nullif("path", F.lit("")).alias("path"), "start", "end", (F.col("end") - F.col("start")).alias("length"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("int")
    failed = errors.unionByName(over).select(*keys, none.alias("seq"), F.nullif("path", F.lit("")).alias("path"), none.alias("start"), none.alias("end"), none.alias("length"), "error")
    return kept.unionByName(failed)


def reports(findings: DataFrame, report: str, tenant: str, source: str) -> DataFrame:
    """(report, sources, findings, error): counts of each report's findings; one whose sources belong to several tenants, or hold an error, is refused."""
    several = F.count_distinct(tenant) > 1
    error = F.when(several, "POLICY_ERROR: report.tenant_mixing").otherwise(F.min("error"))
    out = findings.groupBy(report).agg(F.count_distinct(source).alias("sources"), F.count_if(F.col("start").isNotNull()).alias("findings"), error.alias("error"))
    return out.withColumn("findings", F.when(F.col("error").isNull(), F.col("findings")))
