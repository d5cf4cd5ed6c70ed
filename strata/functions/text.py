"""Scalar text expressions. All are JVM-side columns; none needs a Python worker."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rule ids, severities, patterns and confidences of the line rules.
LINE_RULES = [
    ("SEC-EVAL", "critical", r"\b(eval|exec)\s*\("),
    ("SEC-SUBPROCESS-SHELL", "high", r"\bshell\s*=\s*True\b"),
    ("SEC-HARDCODED-SECRET", "high", r"(?i)\b(password|passwd|api[_-]?key|secret|token)\b\s*=\s*['\"][^'\"]{4,}['\"]"),
    ("SEC-SQL-CONCAT", "high", r"(?i)(execute|query)\s*\(\s*(f['\"]|['\"].*(\+|%))"),
    ("REL-EMPTY-EXCEPT", "medium", r"^\s*except\s*(Exception\s*)?:\s*(pass)?\s*$"),
    ("REL-DEBUG-PRINT", "low", r"\b(print\s*\(|console\.log\s*\()"),
]
RULE_CONFIDENCE = 0.9
SKIPPED_SUFFIXES = (".lock", ".min.js", ".map")
NATIVE_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")

# Weakness identity of each rule; a rule that isn't listed stands for itself.
RULE_TO_CWE = {
    "SEC-EVAL": "CWE-95",
    "SEC-SUBPROCESS-SHELL": "CWE-78",
    "SEC-HARDCODED-SECRET": "CWE-798",
    "SEC-SQL-CONCAT": "CWE-89",
    "REL-EMPTY-EXCEPT": "CWE-703",
    "REL-DEBUG-PRINT": "CWE-532",
    "SEC-PATH-TRAVERSAL": "CWE-22",
    "SEC-YAML-LOAD": "CWE-502",
    "SEC-WEAK-HASH": "CWE-328",
    "SEC-INSECURE-TEMPFILE": "CWE-377",
    "SEC-WEAK-RANDOM": "CWE-330",
    "REL-UNBOUNDED-RETRY": "CWE-835",
    "SEC-ASSERT-AUTH": "CWE-617",
    "SEC-INSECURE-COOKIE": "CWE-614",
    "SEC-PICKLE-LOAD": "CWE-502",
    "REL-FLOAT-MONEY": "CWE-682",
    "REL-NAIVE-DATETIME": "CWE-367",
    "REL-BLOCKING-ASYNC": "CWE-400",
    "REL-NONATOMIC-WRITE": "CWE-362",
    "SEC-OPEN-REDIRECT": "CWE-601",
    "SEC-LOG-FORGING": "CWE-117",
}
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}

# Words that make a key or text sensitive, and forms that make a value restricted.
SENSITIVE_TOKENS = ("secret", "token", "key", "password", "credential", "private_key")
PEM_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
URL_CREDENTIAL = r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@]+:[^\s/@]+@"
# Credential forms of progress records, their replacement, and the fields of a summary.
PROGRESS_KEY = r"(?:token|secret|password|passwd|authorization|api[_-]?key|bearer)"
PROGRESS_CREDENTIAL = r"(?:Bearer\s+\S+|(?:token|secret|password|api[_-]?key)\s*[=:]\s*\S+)"
PROGRESS_MARK = "[redacted]"
PROGRESS_FIELDS = "stage string, stage_index int, stage_total int, message string, attempt int, max_attempts int, current double, total double, unit string"
#: Line ends as Python's splitlines knows them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
TERM = r"[A-Za-z0-9_./:-]{2,}"
#: Unicode white space that strip removes at either end.
STRIP = r"^[\s\x1C-\x1F\x85   -     　]+|[\s\x1C-\x1F\x85   -     　]+$"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity_rank(severity: Column) -> Column:
    return literal_map(SEVERITY_RANK)[severity]


def severity_label(rank: Column) -> Column:
    """The label of a rank; null or unknown is low."""
    return F.coalesce(literal_map({v: k for k, v in SEVERITY_RANK.items()})[rank], F.lit("low"))


def rule_cwe(rule_id: Column) -> Column:
    return F.coalesce(literal_map(RULE_TO_CWE)[rule_id], rule_id)


def normal_path(path: Column) -> Column:
    """Forward slashes, no outer spaces, no diff prefix."""
    return F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"^[ab]/", "")


def lines(text: Column) -> Column:
    """Lines without their ends; a trailing end makes no further line, and empty text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def evidence_clip(text: Column, size: int = 240) -> Column:
    return F.substring(stripped(text), 1, size)


def term_set(text: Column) -> Column:
    """Distinct lower-case terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TERM})"), F.lit(1)), lambda t: F.lower(t)))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text has one of some lower-case words, whatever their case. The lower-case text is made once, as the only element of an array."""
    def found(low: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    return F.exists(F.array(F.lower(text)), found)


def sensitive_key(key: Column) -> Column:
    return has_any(key, SENSITIVE_TOKENS)


def restricted(text: Column) -> Column:
    """Searched only where a plain text that every match holds is found."""
    return (F.contains(text, F.lit("-----BEGIN ")) & text.rlike(PEM_HEADER)) | (F.contains(text, F.lit("://")) & text.rlike(URL_CREDENTIAL))


def bare_base64(text: Column) -> Column:
    """A whole value of base64 form: 32 characters or more, a multiple of four, at most two pads at the end."""
    return (F.length(text) >= 32) & (F.length(text) % 4 == 0) & text.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z")


def has_base64_run(text: Column) -> Column:
    """A run of 32 characters or more; it is tried only where a run begins."""
    return text.rlike(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}")


def classify_text(text: Column) -> Column:
    """restricted, else sensitive by keyword or by a base64 run, else internal. Null is internal."""
    return (
        F.when(restricted(text), "restricted").when(has_any(text, SENSITIVE_TOKENS), "sensitive").when(has_base64_run(text), "sensitive").otherwise("internal")
    )


def test_path(path: Column) -> Column:
    """Whether a part of a path is a test folder or starts like a test file."""
    return F.exists(F.split(F.lower(path), "/"), lambda p: p.isin("test", "tests", "testing") | F.startswith(p, F.lit("test_")))


def signal_score(text: Column, weights: dict[str, float], is_test: Column | None = None) -> Column:
    """Sum of weight times occurrences (three at most, not overlapping) in the lower-case text without spaces; 80 less on test paths, never below 0."""
    compact = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    total = F.lit(0.0)
    for signal, weight in weights.items():
        count = (F.length(compact) - F.length(F.replace(compact, F.lit(signal), F.lit("")))) / len(signal)
        total = total + F.least(F.lit(3.0), count) * weight
    if is_test is not None:
        total = total - F.when(is_test, 80.0).otherwise(0.0)
    return F.greatest(total, F.lit(0.0))


def glob_pattern(glob: str) -> str:
    """A regular expression for a case-exact glob: * any run, ? any character, [..] a set, [!..] its complement."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2 if glob[i + 1: i + 2] in ("!", "]") else i + 1)) > 0:
            body = glob[i + 1: end].replace("\\", "\\\\")
            out.append(f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def credential_shape(value: Column) -> Column:
    """marker for markup, identifier for a plain name, strong if length and mixed classes make a secret plausible, else identifier."""
    digit, mixed = value.rlike("[0-9]"), (value != F.lower(value)) & (value != F.upper(value))
    symbol = value.rlike(r"[^\p{L}\p{N}_-]")
    strong = ((F.length(value) >= 16) & (digit | mixed | symbol)) | (digit & (mixed | symbol)) | (mixed & (F.length(value) >= 12))
    return F.when(value.rlike("[<>|]"), "marker").when(value.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), "identifier").when(strong, "strong").otherwise("identifier")


def masked_secrets(text: Column) -> Column:
    """Well-known secret forms replaced by a mask."""
    for pattern in (r"AKIA[0-9A-Z]{16}", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", r"gh[pousr]_[A-Za-z0-9]{20,}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"):
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def module_name(path: Column) -> Column:
    """Dotted module of a source path; a package's own file stands for the package."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def token_estimate(text: Column) -> Column:
    """About four bytes a token, at least one for any text."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(size / 4).cast("int")))


def csv_cell(value: Column) -> Column:
    """A string that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(value.rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), value)).otherwise(value)


def path_roles(path: Column) -> Column:
    """Which of test, docs, example, generated and build a path speaks for."""
    parts = F.split(F.lower(path), "/")

    def role(name: str, test: Column) -> Column:
        return F.when(test, F.lit(name))

    return F.array_compact(F.array(
        role("test", test_path(path)), role("docs", F.exists(parts, lambda p: p.isin("doc", "docs", "documentation")) | F.lower(path).rlike(r"\.(md|rst|adoc)$")),
        role("example", F.exists(parts, lambda p: p.isin("example", "examples", "sample", "samples", "demo"))), role("generated", F.exists(parts, lambda p: p.isin("generated", "gen", "dist", "vendor")) | F.lower(path).rlike(r"(_pb2\.py|\.min\.js)$")),
        role("build", F.exists(parts, lambda p: p.isin("build", "cmake", "scripts")) | F.lower(path).rlike(r"(^|/)(makefile|cmakelists\.txt|build\.gradle)$")),
    ))


def clamped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def hunk_score(term_hits: Column, added: Column, risky: Column) -> Column:
    return 2 * term_hits + F.least(F.lit(8.0), 0.25 * added) + F.when(risky, 6.0).otherwise(0.0)
