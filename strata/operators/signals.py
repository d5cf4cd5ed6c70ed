"""Weighted signals of functions and classes from the facts of their sources: each rule is a condition over call and parameter rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import cut


def _call() -> Column:
    return F.lower("name")


def _leaf() -> Column:
    return F.substring_index(F.lower("name"), ".", -1)


def _part_of(name: Column, *terms: str) -> Column:
    return name.rlike("|".join(terms))


def _call_rules() -> list[tuple[str, str, int, str, Column]]:
    """(category, signal, weight, what its function must hold besides, condition on one call)."""
    call, leaf, keywords = _call(), _leaf(), F.split("detail", ",")
    dynamic, second_dynamic = F.substring_index("target", ",", 1).isin("dynamic", "mixed"), F.substring_index("target", ",", -1).isin("dynamic", "mixed")
    named, shell = F.array_contains(keywords, "shell"), F.array_contains(keywords, "shell=true")
    sent = call.rlike(r"(^|\.)request\.args\.get$")
    # Categories, signals and weights, and the calls that show them.
    return [
        ("command", "dynamic-shell-sink", 44, "", shell),
        ("command", "interpreter-execution-sink", 88, "", call.isin("exec", "eval") & dynamic),
        ("command", "interpreter-template-expansion", 96, "", call.isin("exec", "eval") & F.startswith("target", F.lit("mixed"))),
        ("command", "interpreter-compilation-sink", 48, "", (call == "compile") & dynamic),
        ("command", "structured-platform-open", 80, "", call == "os.startfile"),
        ("command", "dynamic-dispatch-boundary", 160, "parse", (leaf == "getattr") & second_dynamic),
        ("command", "command-execution-sink", 44, "", call.isin("os.system", "os.popen")),
        ("command", "command-execution-sink", 24, "", (call != "os.popen") & leaf.isin("run", "popen", "call", "check_call", "check_output") & (F.contains(call, F.lit("subprocess")) | shell)),
        ("command", "shell-template-expansion", 24, "", leaf.isin("shell_quote", "quote") & named),
        ("path", "lexical-commonprefix", 64, "", leaf == "commonprefix"),
        ("path", "component-commonpath", 48, "", leaf == "commonpath"),
        ("path", "path-normalization", 10, "", leaf.isin("abspath", "realpath", "expanduser", "resolve")),
        ("path", "path-containment-check", 26, "", leaf.isin("relative_to", "is_relative_to")),
        ("path", "path-construction", 12, "", call == "os.path.join"),
        ("path", "path-construction", 12, "words", (call != "os.path.join") & leaf.isin("join", "joinpath")),
        ("path", "path-containment-check", 42, "", leaf.isin("is_within_directory", "is_safe_path", "safe_join")),
        ("path", "request-path-source", 38, "", F.endswith(call, F.lit("match_info.get"))),
        ("path", "path-read-sink", 18, "", leaf.isin("open", "read_text", "read_bytes", "send_file", "sendfile") & dynamic),
        ("path", "file-cache-boundary", 46, "", leaf.isin("async_move_files_to_cache", "move_files_to_cache")),
        ("path", "file-provenance-validation", 46, "", leaf.isin("model_validate", "is_file_obj_with_meta")),
        ("sql", "request-argument-source", 22, "", sent),
        ("path", "request-argument-source", 8, "", sent),
        ("command", "request-argument-source", 8, "", sent),
        ("sql", "dynamic-sql-text", 58, "sql", (leaf == "text") & dynamic),
        ("sql", "dynamic-sql-execute", 30, "", (leaf == "execute") & dynamic),
        ("sql", "dynamic-sql-structure", 16, "", leaf.isin("order_by", "group_by") & dynamic),
    ]


def _parameter_rules() -> list[tuple[str, str, int, str, Column]]:
    call = _call()
    query = _part_of(call, "query", "sql")
    # Fixed values, as above, by the names of parameters.
    return [
        ("path", "path-parameter", 6, "", _part_of(call, "path", "file", "directory", "root", "target")),
        ("command", "command-parameter", 10, "", _part_of(call, "command", "cmd", "shell", "exec")),
        ("sql", "sql-structure-parameter", 8, "", query),
        ("sql", "sql-structure-parameter", 8, "sql", ~query & _part_of(call, "column", "sort", "order")),
        ("sql", "sql-structure-parameter", 28, "", _part_of(call, "partition_clause", "schema", "sql_clause")),
    ]


def _matches(rows: DataFrame, rules: list[tuple[str, str, int, str, Column]]) -> DataFrame:
    hit = lambda c, s, w, needs: F.struct(F.lit(c).alias("category"), F.lit(s).alias("signal"), F.lit(w).alias("weight"), F.lit(needs).alias("needs"))
    found = F.array_compact(F.array(*[F.when(test, hit(c, s, w, needs)) for c, s, w, needs, test in rules]))
    return rows.select("path", "symbol", F.explode(found).alias("hit")).select("path", "symbol", "hit.*")


def symbol_signals(found: DataFrame) -> DataFrame:
    """(path, symbol, category, score, signals) of functions and classes, from ``python_facts.facts``.

    A symbol has the calls of all that is written inside it, and its own parameters. Some rules count only if it also queries
    (a name with query or sql, or a call such as execute), parses structured data, or has names that matter to security.
    Route decorators add to paths. Categories without a signal have no row; rules for single products are not among these.
    """
    found = cut(found)  # read seven times below, parsed once
    inside = F.expr("transform(sequence(1, size(split(scope, '[.]'))), n -> concat_ws('.', slice(split(scope, '[.]'), 1, n)))")
    rows = found.where("scope <> ''").withColumn("symbol", F.explode(inside))
    calls, words = rows.where("kind = 'form'"), rows.where("kind = 'identifier'")
    own = found.where("kind = 'parameter'").withColumn("symbol", F.col("scope"))
    entry = found.where((F.col("kind") == "function") & F.contains(F.lower("detail"), F.lit("route")))
    entry = entry.select("path", F.col("target").alias("symbol"), F.lit("path").alias("category"), F.lit("web-route-handler").alias("signal"), F.lit(12).alias("weight"), F.lit("").alias("needs"))
    shown = _matches(calls, _call_rules()).unionByName(_matches(own, _parameter_rules())).unionByName(entry)
    queries = words.where(_part_of(F.col("name"), "query", "sql")).unionByName(calls.where(_leaf().isin("execute", "executemany", "group_by", "order_by", "query")))
    parses = calls.where(_call().isin("json.loads", "orjson.loads", "ujson.loads", "yaml.safe_load"))
    flags = [df.select("path", "symbol", F.lit(flag).alias("has")) for df, flag in ((queries, "sql"), (parses, "parse"), (words, "words"))]
    every = shown.unionByName(flags[0].unionByName(flags[1]).unionByName(flags[2]), allowMissingColumns=True)
    # Both groupings use one shuffle; a list holds the hits of one symbol.
    whole = every.groupBy("path", "symbol").agg(F.collect_set("has").alias("has"), F.collect_list(F.when(F.col("has").isNull(), F.struct("category", "signal", "weight", "needs"))).alias("hits"))
    counted = whole.select("path", "symbol", "has", F.explode("hits").alias("hit")).where((F.col("hit.needs") == "") | F.array_contains("has", F.col("hit.needs")))
    return counted.groupBy("path", "symbol", F.col("hit.category").alias("category")).agg(F.sum("hit.weight").alias("score"), F.sort_array(F.collect_set("hit.signal")).alias("signals"))
