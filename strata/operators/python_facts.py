"""Facts of Python sources as rows, and questions about them as joins.

Python only parses: each file gives definition, call and assignment rows. Look-ups,
attack surfaces, call edges and the reach of outside data are relational from there.
Reach follows names, not the order of statements: it finds whatever flow a
statement-by-statement walk finds without its kills, so its hits are candidates.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import graph

FACTS = "path string, scope string, kind string, name string, target string, line int, detail string"
# Calls whose results come from outside, request accessors, decorators of entry points, and sinks by family.
SOURCES = {"input": "console input", "builtins.input": "console input", "os.getenv": "environment variable"}
REQUEST_SUFFIXES = {
    "args.get": "request query parameter", "form.get": "request form field", "values.get": "request value", "cookies.get": "request cookie", "headers.get": "request header", "GET.get": "request query parameter",
    "POST.get": "request form field", "get_json": "request JSON body",
}
ENDPOINTS = ("route", "api_route", "get", "post", "put", "patch", "delete", "websocket")
SINKS = {
    "eval": "CWE-95", "exec": "CWE-95", "builtins.eval": "CWE-95", "builtins.exec": "CWE-95", "os.system": "CWE-78", "os.popen": "CWE-78", "commands.getoutput": "CWE-78", "commands.getstatusoutput": "CWE-78",
    "pickle.load": "CWE-502", "pickle.loads": "CWE-502", "dill.load": "CWE-502", "dill.loads": "CWE-502", "marshal.loads": "CWE-502", "yaml.unsafe_load": "CWE-502", "yaml.load": "CWE-502", "open": "CWE-22",
}
SHELL_SINKS = ("subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_call", "subprocess.check_output")
QUERY_METHODS = ("execute", "executemany", "query", "raw")
SANITIZERS = ("int", "float", "bool", "shlex.quote", "html.escape", "len")

# Parts of names that matter to security.
SECURITY_TERMS = (
    "archive", "clause", "column", "command", "cmd", "directory", "exec", "file", "filename", "filter", "meta", "model_path", "option", "order", "partition", "path", "query", "root", "schema", "shell", "sort", "sql",
    "table", "target", "template",
)


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{base}.{node.attr}" if (base := _dotted(node.value)) else node.attr
    return node.id if isinstance(node, ast.Name) else _dotted(node.func) if isinstance(node, ast.Call) else ""


def _names(node: ast.AST) -> Iterator[str]:
    """Names and calls that a value is made of; arguments of sanitizers don't count."""
    if isinstance(node, ast.Call):
        yield f"{_dotted(node.func)}()"
        if _dotted(node.func) in SANITIZERS:
            return
    elif isinstance(node, ast.Name):
        yield node.id
    for child in ast.iter_child_nodes(node):
        yield from _names(child)


def _form(arguments: list[ast.expr]) -> str:
    """How a call's first two arguments are made, apart by a comma: constant, mixed (data inside a text), dynamic or none."""
    out = []
    for a in arguments[:2]:
        mixed = isinstance(a, (ast.JoinedStr, ast.BinOp)) or isinstance(a, ast.Call) and _dotted(a.func).rpartition(".")[2].lower() in ("format", "format_map")
        out.append("constant" if isinstance(a, ast.Constant) else "mixed" if mixed else "dynamic")
    return ",".join((out + ["none", "none"])[:2])


def _file_facts(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield path, "", "broken", "", "", 0, ""
        return
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        node, scope = stack.pop()
        inner = scope
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = f"{scope}.{node.name}" if scope else node.name
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            yield path, scope, kind, node.name, inner, node.lineno, ",".join(_dotted(d) for d in node.decorator_list)
            if kind == "function":
                for i, a in enumerate([*node.args.posonlyargs, *node.args.args]):
                    yield path, inner, "parameter", a.arg, str(i), node.lineno, node.name
                for a in node.args.kwonlyargs:
                    yield path, inner, "parameter", a.arg, "", node.lineno, node.name
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and node.value is not None:
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                for made in ast.walk(t):
                    if isinstance(made, ast.Name):
                        yield path, scope, "definition", made.id, "", node.lineno, ""
                        for name in _names(node.value):
                            yield path, scope, "assign", name, made.id, node.lineno, ""
        elif isinstance(node, ast.Return) and node.value is not None:
            for name in _names(node.value):
                yield path, scope, "assign", name, "return", node.lineno, ""
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                yield path, scope, "import", a.asname or a.name, f"{getattr(node, 'module', None) or ''}.{a.name}".strip("."), node.lineno, ""
        word = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else node.arg if isinstance(node, ast.arg) else ""
        if any(t in word.lower() for t in SECURITY_TERMS):
            yield path, scope, "identifier", word.lower(), "", node.lineno, ""
        if isinstance(node, ast.Call):
            shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
            yield path, scope, "call", _dotted(node.func), scope, node.lineno, "shell" if shell else ""
            yield path, scope, "form", _dotted(node.func), _form(node.args), node.lineno, ",".join([k.arg or "" for k in node.keywords] + ["shell=true"] * shell)
            for i, a in enumerate(node.args):
                for name in _names(a):
                    yield path, scope, "argument", name, _dotted(node.func), node.lineno, f"{i}{'s' if shell else ''}"
        stack += [(child, inner) for child in ast.iter_child_nodes(node)]


def facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, text); only Python sources reach the parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        for b in batches:
            yield pd.DataFrame([row for p, t in zip(b["path"], b["text"]) for row in _file_facts(p, t or "")], columns=columns)

    rows = files.where(F.endswith("path", F.lit(".py"))).select("path", "text")
    return graph.dealt(rows, "path").mapInPandas(run, FACTS)


def definitions(found: DataFrame, symbol: str, most: int = 50) -> DataFrame:
    """Functions, classes and assignments of a name, the first ``most`` by path and line."""
    rows = found.where(F.col("kind").isin("function", "class", "definition") & (F.col("name") == symbol))
    return rows.select("path", "line", "kind").distinct().orderBy("path", "line", "kind").limit(most)


def _own(name: Column) -> Column:
    """The function that a call by a bare name, or through self or cls, names; other calls name none of the file's."""
    return F.regexp_extract(name, r"^(?:(?:self|cls)\.)?(\w+)$", 1)


def call_edges(found: DataFrame) -> DataFrame:
    """(caller, callee, path, line): calls joined to functions of the same file."""
    calls = found.where("kind = 'call'").select("path", F.col("scope").alias("caller"), _own(F.col("name")).alias("name"), "line")
    made = found.where("kind = 'function'").select("path", "name", F.col("target").alias("callee"))
    return calls.join(made, ["path", "name"]).select("caller", "callee", "path", "line").distinct()


def _source(name: Column) -> Column:
    call = F.regexp_replace(name, r"\(\)$", "")
    out = T.literal_map(SOURCES)[call]
    for suffix, label in REQUEST_SUFFIXES.items():
        out = F.coalesce(out, F.when(F.endswith(call, F.lit(suffix)), F.lit(label)))
    return F.when(F.endswith(name, F.lit("()")), out)


def _sink(name: Column, detail: Column) -> Column:
    return F.coalesce(
        T.literal_map(SINKS)[name], F.when(name.isin(*SHELL_SINKS) & F.endswith(detail, F.lit("s")), "CWE-78"), F.when(F.contains(name, F.lit(".")) & F.substring_index(name, ".", -1).isin(*QUERY_METHODS), "CWE-89")
    )


def attack_surface(found: DataFrame) -> DataFrame:
    """(path, line, kind, name): entry points, sources, sinks and calls that no file resolves."""
    rows = found.select("path", "line", "kind", "name", "detail", "scope")
    entry = rows.where((F.col("kind") == "function") & F.exists(F.split("detail", ","), lambda d: F.substring_index(d, ".", -1).isin(*ENDPOINTS))).select("path", "line", F.lit("entrypoint").alias("kind"), "name")
    calls = rows.where("kind = 'call'")
    source = calls.where(_source(F.concat("name", F.lit("()"))).isNotNull()).select("path", "line", F.lit("source").alias("kind"), "name")
    sink = calls.where(_sink(F.col("name"), F.when(F.col("detail") == "shell", "s").otherwise("")).isNotNull()).select("path", "line", F.lit("sink").alias("kind"), "name")
    known = found.where("kind in ('function', 'class', 'import')").select("path", F.col("name").alias("_n"))
    loose = calls.where("name <> ''").withColumn("_n", F.substring_index("name", ".", 1)).join(known, ["path", "_n"], "left_anti").select("path", "line", F.lit("unresolved").alias("kind"), "name")
    return entry.unionByName(source).unionByName(sink).unionByName(loose).distinct()


def trust_boundaries(surface: DataFrame) -> DataFrame:
    """(path): files through which outside data comes in, by an entry point or a source."""
    return surface.where(F.col("kind").isin("entrypoint", "source")).select("path").distinct()


def tainted_sinks(found: DataFrame, rounds: int = 16) -> DataFrame:
    """(path, line, sink, cwe, origin): sinks whose first argument outside data reaches through assignments, calls and returns of a file.

    Nodes are names in their scope. Arguments flow to parameters of functions of the same file, their returns back to the caller.
    """
    found = graph.cut(found)  # read in every round below, parsed once
    node = lambda scope, name: F.concat_ws("|", "path", scope, name)
    assign = found.where("kind = 'assign'")
    plain = assign.select("path", node("scope", "name").alias("src"), node("scope", "target").alias("dst"))
    functions = found.where("kind = 'function'").select("path", F.col("name").alias("f"), F.col("target").alias("inner"))
    parameters = found.where("kind = 'parameter'").select("path", F.col("scope").alias("inner"), F.col("name").alias("p"), F.col("target").alias("nth"))
    passed = found.where("kind = 'argument'").select("path", "scope", "name", _own(F.col("target")).alias("f"), F.regexp_replace("detail", "s$", "").alias("nth"))
    into = passed.join(functions, ["path", "f"]).join(parameters, ["path", "inner", "nth"]).select("path", node("scope", "name").alias("src"), node("inner", "p").alias("dst"))
    used = assign.select("path", "scope", _own(F.regexp_replace("name", r"\(\)$", "")).alias("f"), "name").unionByName(passed.select("path", "scope", _own(F.regexp_replace("name", r"\(\)$", "")).alias("f"), "name")).where(F.endswith("name", F.lit("()"))).distinct()
    back = used.join(functions, ["path", "f"]).select("path", node("inner", F.lit("return")).alias("src"), node("scope", "name").alias("dst"))
    edges = graph.cut(plain.unionByName(into).unionByName(back).distinct())
    named = found.where("kind in ('assign', 'argument')").withColumn("origin", _source(F.col("name"))).where("origin is not null")
    starts = named.select("path", "origin", node("scope", "name").alias("node")).distinct()
    reached = graph.reach(starts, edges, ["path"], rounds=rounds)
    sinks = found.where("kind = 'argument'").withColumn("cwe", _sink(F.col("target"), F.col("detail"))).where(F.col("cwe").isNotNull() & F.startswith("detail", F.lit("0")))
    return sinks.withColumn("node", node("scope", "name")).join(reached, ["path", "node"]).select("path", "line", F.col("target").alias("sink"), "cwe", "origin").distinct()
