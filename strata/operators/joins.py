"""Joins by equality, range, prefix, glob, set overlap and reachability.

Every join here has an equality part for the shuffle; ranges are cut into bins so
that a wide key doesn't meet all of its rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions import text as T


def parent_with_children(parents: DataFrame, key: str, **children: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """Parents with ordered arrays of child structs. Each child is (frame, its key, columns), ordered by the columns as listed.

    Children are grouped before they meet the parents, so no pair of child lists multiplies.
    """
    out = parents
    for name, (frame, child_key, columns) in children.items():
        lists = frame.groupBy(F.col(child_key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(lists, out[key] == lists["_k"], "left").drop("_k")
    return out


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, tolerance: int = 0, bin_size: int = 64) -> DataFrame:
    """Pairs with equal ``keys`` whose point lies within ``tolerance`` of [start, end], with their ``distance``.

    Intervals are repeated for each bin they touch, so points meet only intervals of their own bin.
    """
    low, high = F.floor((F.col(start) - tolerance) / bin_size), F.floor((F.col(end) + tolerance) / bin_size)
    spread = intervals.withColumn("_bin", F.explode(F.sequence(low, high)))
    binned = points.withColumn("_bin", F.floor(F.col(point) / bin_size))
    pairs = binned.join(spread, [*keys, "_bin"])
    distance = F.greatest(F.col(start) - F.col(point), F.col(point) - F.col(end), F.lit(0))
    return pairs.withColumn("distance", distance).where(F.col("distance") <= tolerance).drop("_bin")


def candidate_edges(expected: DataFrame, predicted: DataFrame, tolerance: int = 2) -> DataFrame:
    """Possible matches of predictions (case_id, p, path, rule_id, line) with truths (case_id, e, path, cwe, start_line, end_line)."""
    truths = expected.select("case_id", "e", T.normal_path(F.col("path")).alias("path"), F.upper("cwe").alias("cwe"), "start_line", "end_line")
    found = predicted.select("case_id", "p", T.normal_path(F.col("path")).alias("path"), F.upper(T.rule_cwe(F.col("rule_id"))).alias("cwe"), "line")
    return range_join(found, truths, ["case_id", "path", "cwe"], "line", "start_line", "end_line", tolerance).select("case_id", "e", "p", "distance")


def uncovered_cases(expected: DataFrame, added: DataFrame) -> DataFrame:
    """Expected ranges that cover no added line of the same path; a valid dataset has none."""
    spans = expected.withColumn("_span", F.monotonically_increasing_id())
    covered = range_join(added.select("case_id", "path", "line"), spans, ["case_id", "path"], "line", "start_line", "end_line").select("_span").distinct()
    return spans.join(covered, "_span", "left_anti").drop("_span")


def first_covering(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, seq: str) -> DataFrame:
    """Of all intervals that cover a point, the one that comes first. Points and bounds are whole numbers, and ``seq`` has no ties.

    An interval is cut into at most six cells of each size 1, 4, 16, ..., a point lies in one cell of each size. Of a cell only the
    first interval is kept, so rows grow with points and intervals, never with their pairs.
    """
    whole = intervals.where(F.col(start) <= F.col(end))
    longest = whole.agg(F.max(F.col(end) - F.col(start))).first()[0]
    levels = 1
    while 4 ** (levels - 1) <= (longest or 0):
        levels += 1
    cells = F.flatten(F.array(*[_cells(F.col(start), F.col(end) + 1, n, n == levels - 1) for n in range(levels)]))
    own = [c for c in intervals.columns if c not in keys]
    cut = whole.select(*keys, F.struct(*own).alias("_x"), F.col(seq).alias("_seq"), F.explode(cells).alias("_cell"))
    first = cut.groupBy(*keys, "_cell").agg(F.min_by("_x", "_seq").alias("_x"), F.min("_seq").alias("_seq"))
    at = points.select(*keys, F.col(point).alias("_at")).where("_at is not null").distinct()
    placed = at.withColumn("_cell", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("_at") / 4**n).alias("n")) for n in range(levels)])))
    best = placed.join(first, [*keys, "_cell"]).groupBy(*keys, "_at").agg(F.min_by("_x", "_seq").alias("_x"))
    return points.join(best.withColumnRenamed("_at", point), [*keys, point]).select(*points.columns, *[F.col("_x")[c].alias(c) for c in own])


def _cells(low: Column, high: Column, level: int, last: bool) -> Column:
    """Cells of size 4^level inside [low, high) that no larger cell inside it holds; of the last level all."""
    a, b = F.ceil(low / 4**level).cast("long"), F.floor(high / 4**level).cast("long")
    up_a, up_b = F.ceil(low / 4 ** (level + 1)).cast("long") * 4, F.floor(high / 4 ** (level + 1)).cast("long") * 4
    none = F.array().cast("array<bigint>")
    span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(none)
    left = F.least(b, up_a)
    return F.transform(span(a, b) if last else F.concat(span(a, left), span(F.greatest(up_b, left), b)), lambda n: F.struct(F.lit(level).alias("level"), n.alias("n")))


def symbol_or_near(left: DataFrame, right: DataFrame, near: int = 3) -> DataFrame:
    """Same path; symbols equal or one the other's ``::`` suffix; without symbols on either side, lines at most ``near`` apart.

    Both have path, symbol and line; the right's other columns must differ in name. Pairs with symbols meet by their last
    part, which both kinds of match share; pairs without meet by bins of lines.
    """
    def keyed(df: DataFrame) -> DataFrame:
        s = F.trim(F.coalesce(F.col("symbol"), F.lit("")))
        return df.withColumn("symbol", s).withColumn("_last", F.substring_index(s, "::", -1))

    a, b = keyed(left), keyed(right).withColumnsRenamed({"symbol": "r_symbol", "line": "r_line"})
    named = a.where("symbol <> ''").join(b.where("r_symbol <> ''"), ["path", "_last"])
    named = named.where(
        (F.col("symbol") == F.col("r_symbol")) | F.endswith("symbol", F.concat(F.lit("::"), "r_symbol")) | F.endswith("r_symbol", F.concat(F.lit("::"), "symbol"))
    )
    bare = range_join(a.where("symbol = ''").drop("_last"), b.where("r_symbol = ''").drop("_last").withColumn("r_end", F.col("r_line")), ["path"], "line", "r_line", "r_end", near)
    return named.drop("_last").unionByName(bare.drop("distance", "r_end"))


def match_cves(findings: DataFrame, index: DataFrame) -> DataFrame:
    """Findings (finding_id, component, path, window) with the sorted ids of matching index rows.

    Components must be non-empty prefixes of each other, a glob must match the path, and the commit window must
    touch the entry's commits unless either is unknown. Every prefix of a component is a join key, so both directions
    of the prefix test are equi joins.
    """
    def prefixes(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substr(c, F.lit(1), n))

    f = findings.where("component <> ''")
    x = index.where("component <> ''").withColumnRenamed("component", "entry")
    longer = f.withColumn("_key", F.explode(prefixes(F.col("component")))).join(x.withColumn("_key", F.col("entry")), "_key")
    shorter = f.withColumn("_key", F.col("component")).join(x.withColumn("_key", F.explode(prefixes(F.col("entry")))), "_key").where(F.length("entry") > F.length("component"))
    pairs = longer.unionByName(shorter)
    globbed = F.exists("affected_paths", lambda g: F.rlike(F.col("path"), _glob_expression(g)))
    commits = F.filter(F.array("introduced_commit", "fixed_commit"), lambda c: F.coalesce(c, F.lit("")) != "")
    timely = F.col("window").isNull() | (F.size(commits) == 0) | F.arrays_overlap(commits, F.col("window"))
    hits = pairs.where(globbed & timely).groupBy("finding_id").agg(F.sort_array(F.collect_set("cve_id")).alias("cve_ids"))
    return findings.join(hits, "finding_id", "left").withColumn("cve_ids", F.coalesce("cve_ids", F.array().cast("array<string>")))


def _glob_expression(glob: Column) -> Column:
    """A glob's regular expression as a column: other characters quoted, * any run, ? any character, [!..] negated sets."""
    quoted = F.regexp_replace(glob, r"([\\.+(){}^$|])", r"\\$1")
    sets = F.regexp_replace(quoted, r"\[!", "[^")
    return F.concat(F.lit(r"(?s)\A"), F.regexp_replace(F.regexp_replace(sets, r"\*", ".*"), r"\?", "."), F.lit(r"\z"))


def with_default(left: DataFrame, right: DataFrame, keys: list[str], seq: str, value: str, default: str) -> DataFrame:
    """Left rows with the value of the last right row of equal keys, or a default."""
    last = right.groupBy(*keys).agg(F.max_by(value, seq).alias(value))
    return left.join(last, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def hierarchy_semi(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Found symbols that are an expected one of the same path, or lie under it by a dot. All dotted prefixes are keys."""
    parts = F.split("symbol", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    rows = found.withColumn("_row", F.monotonically_increasing_id())
    keyed = rows.select("_row", "path", F.explode(prefixes).alias("symbol"))
    hits = keyed.join(expected.select("path", "symbol").distinct(), ["path", "symbol"], "left_semi").select("_row").distinct()
    return rows.join(hits, "_row", "left_semi").drop("_row")


def related_members(items: DataFrame, top: int = 4) -> DataFrame:
    """For each item its ``top`` relatives of the same category: same file and a call either way, or same class and a shared identifier.

    Items have a unique id, category, path, cls, name, calls, identifiers, score and line. Each way to be related is an equality of
    keys, and of the items of a key only the first ``top`` and one more can count, so large files and classes don't multiply.
    """
    order = [F.desc("score"), F.asc("path"), F.asc("line"), F.asc("id")]
    ways = [  # the key of the item that asks, and of its relatives
        ("path", F.explode(F.array_distinct("calls")), F.col("name"), items), ("path", F.col("name"), F.explode(F.array_distinct("calls")), items),
        ("cls", F.explode(F.array_distinct("identifiers")), F.explode(F.array_distinct("identifiers")), items.where("cls <> ''")),
    ]
    asks, found = [], []
    for n, (place, wanted, offered, rows) in enumerate(ways):
        group = [F.lit(n).alias("_way"), F.col("category").alias("_category"), F.col(place).alias("_place")]
        asks.append(rows.select(F.col("id").alias("a_id"), *group, wanted.alias("_key")))
        found.append(rows.select("id", "score", "path", "line", *group, offered.alias("_key")))
    return _first_others(asks, found, ["_way", "_category", "_place", "_key"], order, top)


def _first_others(asks: list[DataFrame], found: list[DataFrame], keys: list[str], order: list[Column], top: int) -> DataFrame:
    """(a_id, b_id, rank): of all items found under an asking item's keys the first ``top`` others. Ids are unique."""
    every = reduce(DataFrame.unionByName, found)
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= top + 1).drop("_n")
    pairs = reduce(DataFrame.unionByName, asks).join(first, keys).where(F.col("a_id") != F.col("id")).drop(*keys).distinct()
    rank = Window.partitionBy("a_id").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select("a_id", F.col("id").alias("b_id"), "rank")


def pipeline_neighbours(items: DataFrame, top: int = 4) -> DataFrame:
    """For each pipeline step its ``top`` fellow steps of the same path, class and category, by score and line. Items also have a boolean ``pipeline``."""
    steps = items.where("pipeline and cls <> ''")
    keys = ["path", "cls", "category"]
    return _first_others([steps.select(F.col("id").alias("a_id"), *keys)], [steps.select("id", *keys, "score", "line")], keys, [F.desc("score"), F.asc("line"), F.asc("id")], top)


def strict_semi(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Found rows whose weakness, path and symbol all equal a target's."""
    return found.join(targets.select("cwe", "path", "symbol"), ["cwe", "path", "symbol"], "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, change) of keys that were added, modified or removed between two snapshots."""
    o, n = old.select(key, F.col(digest).alias("_o")), new.select(key, F.col(digest).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def resolve_imports(uses: DataFrame, modules: DataFrame) -> DataFrame:
    """Uses (alias) joined to modules (alias, symbol) whose alias is unambiguous."""
    only = modules.groupBy("alias").agg(F.count("*").alias("_n"), F.first("symbol").alias("symbol")).where("_n = 1").drop("_n")
    return uses.join(only, "alias")


def quoted_evidence(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Findings with ``grounded``: their evidence is part of the added line at their path and line."""
    lines = added.groupBy("path", "line").agg(F.max("content").alias("_content"))
    known = F.coalesce(F.contains("_content", "evidence") & (F.col("evidence") != ""), F.lit(False))
    return findings.join(lines, ["path", "line"], "left").withColumn("grounded", known).drop("_content")


def bind_corroboration(candidates: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Per candidate: corroborated, conflict and matched runs.

    A finding at the same place with another weakness, or without a completed run of its tool, is a conflict.
    """
    usable = runs.where("status = 'completed'").select("run_id", F.col("tool").alias("run_tool")).distinct()
    # Candidates and findings that are alike in all that counts meet once; a line counts only without a symbol.
    name = F.trim(F.coalesce("symbol", F.lit("")))
    line = F.when(name == "", F.col("line")).alias("line")
    tool = findings.select("path", name.alias("symbol"), line, F.col("cwe").alias("f_cwe"), "tool", "run_id").distinct()
    asked = candidates.select("path", name.alias("symbol"), line, "cwe").distinct()
    pairs = symbol_or_near(asked, tool).join(usable, "run_id", "left")
    good = (F.col("cwe") == F.col("f_cwe")) & F.col("run_tool").isNotNull() & (F.col("run_tool") == F.col("tool"))
    keys = ["path", "symbol", "line", "cwe"]
    flags = pairs.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(
        F.bool_or(F.coalesce(good, F.lit(False))).alias("corroborated"), F.bool_or(~F.coalesce(good, F.lit(False))).alias("conflict"),
        F.sort_array(F.collect_set(F.when(good, F.col("run_id")))).alias("run_ids"),
    )
    same = (F.col("path") == F.col("_path")) & (name == F.col("_symbol")) & F.when(name == "", F.col("line")).eqNullSafe(F.col("_line")) & F.col("cwe").eqNullSafe(F.col("_cwe"))
    none = F.array().cast("array<string>")
    return candidates.join(flags, same, "left").drop(*[f"_{c}" for c in keys]).withColumns({
        "corroborated": F.coalesce("corroborated", F.lit(False)), "conflict": F.coalesce("conflict", F.lit(False)), "run_ids": F.coalesce("run_ids", none),
    })


def bind_point(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evidence rows with the first reason why they don't bind to their candidate, or ``bound``.

    The line must lie in the release or the use range, and the last part of the function's name must be the symbol.
    """
    rows = evidence.join(candidates.select("candidate_id", F.col("path").alias("c_path"), "function_usr", "release_range", "use_range"), "candidate_id", "left")
    inside = lambda r: F.col("line").between(F.col(f"{r}.start"), F.col(f"{r}.end"))
    reason = (
        F.when(F.col("c_path").isNull(), "unknown-candidate").when(F.col("path") != F.col("c_path"), "path-mismatch")
        .when(~(inside("release_range") | inside("use_range")), "line-outside-range").when(F.substring_index("function_usr", "::", -1) != F.col("symbol"), "symbol-mismatch").otherwise("bound")
    )
    return rows.withColumn("reason", reason).drop("c_path", "function_usr", "release_range", "use_range")


def dangling_references(subjects: DataFrame, evidence: DataFrame) -> DataFrame:
    """Where declared evidence and evidence rows disagree: (subject_id, evidence_id, problem).

    Subjects have subject_id and evidence_ids; evidence rows name their subject. The two sets of pairs must be equal.
    """
    declared = subjects.select("subject_id", F.explode("evidence_ids").alias("evidence_id")).distinct().withColumn("_d", F.lit(True))
    actual = evidence.select("subject_id", "evidence_id").distinct().withColumn("_a", F.lit(True))
    problem = F.when(F.col("_a").isNull(), "declared-only").when(F.col("_d").isNull(), "undeclared")
    return declared.join(actual, ["subject_id", "evidence_id"], "full_outer").select("subject_id", "evidence_id", problem.alias("problem")).where("problem is not null")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
