"""Fact bundles as they come over the wire: closed sets of fields, recomputed digests, and every violation as a row.

Fields are read from the raw text, not through a schema that would hide unknown or doubled
ones. Units and facts are exploded from it a level at a time; what each may hold depends on
its level and a fact's kind. A bundle's digest is that of its units in canonical form, made
anew from the text that came. A bundle is small by its own budget, so canonical forms are
made row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.digests import canonical_json

# The fields of each level, values of closed sets, and budgets.
BUNDLE = ("schema_version", "request_id", "repository_key", "snapshot_sha256", "tool_runs", "translation_units", "bundle_sha256", "diagnostics")
UNIT = ("translation_unit", "extraction", "build_context", "coverage", "facts")
CONTEXT = ("status", "source_kind", "context_hash", "diagnostics")
COVERAGE = ("ast_complete", "cfg_complete", "semantic_gaps")
FACT = ("fact_id", "kind", "translation_unit", "canonical_path", "function_usr", "source_range", "cfg_block")
KIND_FIELDS = {
    "allocation": ("allocation_api", "pointer_id"), "release": ("release_api", "pointer_id", "related_fact_ids"), "dereference": ("pointer_id",), "member-access": ("pointer_id",), "alias-copy": ("pointer_id", "source_pointer_id"),
    "points-to": ("pointer_id", "source_pointer_id", "related_fact_ids"), "rebind": ("pointer_id", "source_pointer_id", "related_fact_ids"), "lifetime-restart": (), "cfg-node": (), "cfg-edge": (), "coverage-gap": (),
}
STATUSES = ("resolved", "incomplete", "unavailable")
MOST_FACTS, MOST_BYTES, MOST_PATH_BYTES = 1024, 2 * 1024 * 1024, 4096


def _texts(value: Column) -> Column:
    """The fields of a JSON object, each as text."""
    return F.from_json(value, "map<string,string>")


def _kind(value: Column, name: str) -> Column:
    """VARIANT's name of the kind of a field."""
    return F.schema_of_variant(F.from_json(value, f"struct<{name}: variant>")[name])


def _fields(keys: Column, allowed: Column, label: str = "") -> Column:
    """Violations of a closed set of fields by an object's keys, which are null where there is no object."""
    named = lambda kind, names: F.transform(names, lambda n: F.concat(F.lit(f"{kind}-field:{label}"), n))
    once = F.array_distinct(keys)
    doubled = F.when(F.size(once) < F.size(keys), F.filter(once, lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1)).otherwise(_names(()))
    return F.when(keys.isNull(), F.array(F.lit(f"not-an-object:{label}"))).otherwise(F.concat(named("unknown", F.array_except(keys, allowed)), named("missing", F.array_except(allowed, keys)), named("duplicate", doubled)))


def _if(wrong: Column, name: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def _unsafe(path: Column, root: Column) -> Column:
    """A path that is empty, too long, absolute, leaves its folder, or isn't below the root where there is one."""
    parts = F.split(path, "/")
    bad = (path == "") | (F.octet_length(path) > MOST_PATH_BYTES) | F.contains(path, F.lit("\\")) | F.contains(path, F.lit("\0")) | F.exists(parts, lambda p: p.isin("", ".", ".."))
    return bad | ((root != "") & ~F.startswith(path, F.concat(root, F.lit("/"))))


def _names(values: tuple[str, ...]) -> Column:
    return F.lit(list(values)) if values else F.array().cast("array<string>")


def _objects(bundles: DataFrame) -> DataFrame:
    """A row for each bundle (u and f null), unit (f null) and fact, with its text, fields and keys, from one reading of the raw text.

    Explodes are outer: for others Spark puts a filter before them, which would make all that they explode once more.
    """
    whole = bundles.withColumn("m", _texts(F.col("raw"))).withColumn("units", F.from_json("raw", "struct<translation_units: array<string>>")["translation_units"])
    whole = whole.withColumn("canonical", canonical_json(F.concat(F.lit('{"translation_units":'), F.col("m")["translation_units"], F.lit("}"))))
    whole = whole.withColumns({"digest": F.sha2("canonical", 256), "bytes": F.octet_length("canonical")})
    none = F.array().cast("array<string>")
    kept = ["bundle_id", "snapshot_hash", "context_hash", "root", "digest", "bytes"]
    upper = whole.select(*kept, F.posexplode_outer(F.concat(F.array("raw"), F.coalesce("units", none))).alias("at", "upper"))
    upper = upper.withColumns({"u": F.when(F.col("at") > 0, F.col("at") - 1), "in_unit": F.when(F.col("at") > 0, _texts(F.col("upper"))["translation_unit"])})
    upper = upper.withColumn("facts", F.when(F.col("at") > 0, F.from_json("upper", "struct<facts: array<string>>")["facts"])).withColumn("n_facts", F.size("facts"))
    every = upper.select(*kept, "u", "in_unit", "n_facts", F.posexplode_outer(F.concat(F.array("upper"), F.coalesce("facts", none))).alias("at", "text"))
    every = every.withColumns({"f": F.when(F.col("at") > 0, F.col("at") - 1), "m": _texts(F.col("text")), "keys": F.json_object_keys("text")})
    return every.drop("at")


def violations(bundles: DataFrame, version: int = 1) -> DataFrame:
    """(bundle_id, place, violation): all that is wrong with bundles (bundle_id, raw, snapshot_hash, context_hash, root). A sound bundle has no row."""
    m, text, keys, root = F.col("m"), F.col("text"), F.col("keys"), F.col("root")
    is_unit, is_fact = F.col("u").isNotNull() & F.col("f").isNull(), F.col("f").isNotNull()
    none = F.array().cast("array<string>")
    rows = _objects(bundles).withColumns({"context": F.when(is_unit, m["build_context"]), "coverage": F.when(is_unit, m["coverage"]), "extraction": F.when(is_unit, m["extraction"])})
    related = F.from_json("text", "struct<related_fact_ids: array<string>>")["related_fact_ids"]
    rows = rows.withColumns({
        "context_fields": _texts(F.col("context")), "context_keys": F.json_object_keys("context"), "coverage_keys": F.json_object_keys("coverage"), "ends": F.when(is_fact, F.from_json(m["source_range"], "array<bigint>")),
        "related": F.when(is_fact, F.coalesce(related, none)).otherwise(none),
        "allowed": F.when(is_fact, F.create_map(*[x for k, extra in KIND_FIELDS.items() for x in (F.lit(k), _names((*FACT, *extra)))])[m["kind"]]),
    })
    of_bundle = F.when(keys.isNull(), F.array(F.lit("not-an-object:"))).otherwise(F.concat(
        _fields(keys, _names(BUNDLE)), _if((m["schema_version"] != str(version)) | (_kind(text, "schema_version") != "BIGINT"), "schema-version"), _if(m["snapshot_sha256"] != F.col("snapshot_hash"), "snapshot-hash"),
        _if(F.col("digest") != m["bundle_sha256"], "bundle-digest"), _if(F.col("bytes") > MOST_BYTES, "byte-budget"), _if((m["request_id"] == "") | (m["repository_key"] == ""), "empty-name"),
    ))
    claims = F.col("coverage").rlike(r'"(ast|cfg)_complete"\s*:\s*true')
    of_unit = F.concat(
        _fields(keys, _names(UNIT)), _fields(F.col("context_keys"), _names(CONTEXT), "build_context."), _fields(F.col("coverage_keys"), _names(COVERAGE), "coverage."), _if(_unsafe(m["translation_unit"], root), "unsafe-path"),
        _if(~F.col("extraction").isin("completed", "unavailable"), "extraction"), _if(~F.col("context_fields")["status"].isin(*STATUSES), "context-status"),
        _if((F.col("extraction") == "completed") & (F.col("context_fields")["context_hash"] != F.col("context_hash")), "context-hash"), _if((_kind(F.col("coverage"), "ast_complete") != "BOOLEAN") | (_kind(F.col("coverage"), "cfg_complete") != "BOOLEAN"), "coverage-flags"),
        _if((F.col("extraction") != "completed") & (F.col("n_facts") > 0), "facts-without-extraction"), _if((F.col("extraction") == "unavailable") & claims, "claims-completeness"),
    )
    ends = F.col("ends")
    of_fact = F.concat(
        F.when(F.col("allowed").isNull(), F.array(F.lit("unknown-kind"))).otherwise(_fields(keys, F.col("allowed"))), _if(~m["fact_id"].rlike("^[0-9a-f]{64}$"), "fact-id"), _if(m["translation_unit"] != F.col("in_unit"), "unit-mismatch"),
        _if(_unsafe(m["canonical_path"], root), "unsafe-path"), _if((F.size(ends) != 2) | (ends[0] > ends[1]) | (ends[0] < 1), "source-range"),
    )
    found = rows.select("bundle_id", "u", "f", m["fact_id"].alias("fact_id"), "related", F.when(is_fact, of_fact).when(is_unit, of_unit).otherwise(of_bundle).alias("v"))

    # What a fact declares (0), what it refers to (1), and other places that have something wrong (2), each with a fact's id: they meet by bundle, which is one text and so in one task before.
    one = lambda role, fact_id, v: F.struct(F.lit(role).alias("role"), fact_id.alias("fact_id"), v.alias("v"))
    declared = F.concat(F.array(one(0, F.col("fact_id"), F.col("v"))), F.transform("related", lambda r: one(1, r, none)))
    said = found.select("bundle_id", "u", "f", F.explode_outer(F.when(is_fact, declared).when(F.size("v") > 0, F.array(one(2, F.lit(None).cast("string"), F.col("v"))))).alias("x")).where("x is not null").select("bundle_id", "u", "f", "x.*")
    by_bundle, by_id = Window.partitionBy("bundle_id"), Window.partitionBy("bundle_id", "fact_id")
    order = ["role", "u", "f"]
    met = said.withColumns({
        "facts": F.count_if(F.col("role") == 0).over(by_bundle), "place_nth": F.row_number().over(by_bundle.orderBy("fact_id", *order)), "declared": F.count_if(F.col("role") == 0).over(by_id), "nth": F.row_number().over(by_id.orderBy(*order)),
    })
    place = F.when(F.col("u").isNull(), F.lit("bundle")).otherwise(F.concat(F.lit("unit/"), F.col("u").cast("string"), F.coalesce(F.concat(F.lit("/fact/"), F.col("f").cast("string")), F.lit(""))))
    more = F.when((F.col("role") == 0) & (F.col("nth") > 1), F.array(F.lit("duplicate-id"))).when((F.col("role") == 1) & (F.col("fact_id").isNull() | (F.col("declared") == 0)), F.array(F.lit("dangling-reference"))).otherwise(none)
    placed = lambda where, v: F.transform(v, lambda x: F.struct(where.alias("place"), x.alias("violation")))
    budget = F.when((F.col("facts") > MOST_FACTS) & (F.col("place_nth") == 1), F.array(F.lit("fact-budget"))).otherwise(none)
    met = met.select("bundle_id", place.alias("place"), F.concat("v", more).alias("v"), budget.alias("budget"))
    return met.select("bundle_id", F.explode_outer(F.concat(placed(F.col("place"), F.col("v")), placed(F.lit("bundle"), F.col("budget")))).alias("x")).where("x is not null").select("bundle_id", "x.*")
