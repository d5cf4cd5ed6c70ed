"""Reports of analyzers as a data source: batches of report files become partitions, findings and failed reports become rows.

A folder has a sub-folder of JSON files for each tool, one file a run over a batch of
sources; nothing is started here. Files are dealt a hundred to a partition, those of tools
that a pushed filter excludes not at all, and findings outside a pushed path prefix are not
made into rows. A report that can't be taken is a row of its own with status ``failed`` and
the reason, and so is a run that reported errors, whose findings don't count.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from strata.sources.ledger import _opened, _read

BATCH = 100
FINDINGS = "tool string, report string, status string, path string, line int, rule_id string, severity string, confidence double, cwe string, title string, evidence string, symbol string, reason string"
NAMES = [c.split()[0] for c in FINDINGS.split(", ")]
# What the fields of the reports mean.
BANDIT_SEVERITY = {"LOW": "low", "MEDIUM": "medium", "HIGH": "high"}
BANDIT_CONFIDENCE = {"LOW": 0.62, "MEDIUM": 0.78, "HIGH": 0.9}
OTHER_CONFIDENCE = 0.72
BANDIT_CWE = {"B307": "CWE-95"}
SEMGREP_RULES = {"cxx.source.oob-write": "CWE-787", "cxx.source.oob-read": "CWE-125", "cxx.source.use-after-free": "CWE-416", "cxx.source.double-free": "CWE-415"}
SEMGREP_CONFIDENCE = 0.5
MOST_ERRORS, MOST_ERROR_BYTES = 64, 4096
C_SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")


def _inside(path: str, root: str) -> str | None:
    """A path below the root, made relative, or None for one outside."""
    whole = posixpath.normpath(posixpath.join(root or "/", path))
    below = posixpath.relpath(whole, root or "/")
    return None if below == ".." or below.startswith("../") else below


def bandit_rows(text: str, root: str = "") -> Iterator[dict]:
    """Findings of a report with a list of results; files outside the root are left out."""
    for r in json.loads(text or "{}").get("results") or []:
        path = _inside(str(r.get("filename") or ""), root)
        if path is None:
            continue
        test, cwe = str(r.get("test_id") or "UNKNOWN"), (r.get("issue_cwe") or {}).get("id")
        yield {
            "path": path, "line": max(1, int(r.get("line_number") or 1)), "rule_id": f"BANDIT-{test}", "severity": BANDIT_SEVERITY.get(str(r.get("issue_severity") or "MEDIUM").upper(), "medium"),
            "confidence": BANDIT_CONFIDENCE.get(str(r.get("issue_confidence") or "MEDIUM").upper(), OTHER_CONFIDENCE), "cwe": BANDIT_CWE.get(test, f"CWE-{cwe}" if cwe else ""),
            "title": str(r.get("issue_text") or "Bandit security finding")[:160], "evidence": " ".join(str(r.get("code") or "").split())[:240],
        }


def _need(holds: object, reason: str) -> None:
    if not holds:
        raise ValueError(reason)


def semgrep_rows(text: str, root: str = "") -> Iterator[dict]:
    """Findings of a report of results and errors over C and C++ sources. One result that isn't as it should be refuses the whole report."""
    report = json.loads(text)
    _need(isinstance(report, dict) and isinstance(report.get("results"), list) and isinstance(report.get("errors"), list), "no lists of results and errors")
    errors = report["errors"]
    _need(len(errors) <= MOST_ERRORS, f"semgrep-error-limit-exceeded:{len(errors)}")
    for e in errors:
        _need(isinstance(e, dict), "an error is invalid")
        kind, message = e.get("type"), e.get("message")
        kind = kind if isinstance(kind, str) else kind[0] if isinstance(kind, list) and kind and isinstance(kind[0], str) else json.dumps(kind, sort_keys=True)
        _need(kind and isinstance(message, str) and message and max(len(kind.encode()), len(message.encode())) <= MOST_ERROR_BYTES, "an error is invalid")
    _need(not errors, "semgrep-reported-errors")
    rows = []
    for r in report["results"]:
        extra = r.get("extra") if isinstance(r, dict) else None
        _need(isinstance(extra, dict), "a result lacks its metadata")
        rule, meta, path, start = r.get("check_id"), extra.get("metadata"), r.get("path"), r.get("start")
        _need(isinstance(rule, str) and isinstance(meta, dict), "rule metadata is invalid")
        family = next((c for p, c in SEMGREP_RULES.items() if rule == p or rule.startswith(f"{p}.")), None)
        _need(family and meta.get("cwe") == family and meta.get("candidate") is True, "a rule is outside the fixed set")
        _need(isinstance(path, str) and path and not path.startswith("/") and not set(path) & set("\\\0") and not set(path.split("/")) & {"", ".", ".."}, "a path leaves the sources")
        _need(path.lower().endswith(C_SUFFIXES), "a path is no C or C++ source")
        line = start.get("line") if isinstance(start, dict) else None
        _need(type(line) is int and line >= 1, "a line is invalid")
        evidence = extra.get("lines", "")
        _need(isinstance(evidence, str) and evidence and evidence.strip().lower() != "requires login", "a result lacks its evidence")
        title = extra.get("message", rule)
        function = (r.get("extra", {}).get("metavars") or {}).get("$FUNC") if isinstance(extra.get("metavars"), dict) else None
        name = function.get("abstract_content") if isinstance(function, dict) else None
        rows.append({
            "path": path, "line": line, "rule_id": rule, "severity": "high", "confidence": SEMGREP_CONFIDENCE, "cwe": family, "title": title if isinstance(title, str) and title else rule, "evidence": evidence,
            "symbol": name.strip() if isinstance(name, str) and name.strip() else "unknown",
        })
    yield from rows


FORMS = {"bandit": bandit_rows, "semgrep": semgrep_rows}


@dataclass
class Reports(InputPartition):
    tool: str
    paths: list[str]


class ReportReader(DataSourceReader):
    def __init__(self, uri: str, root: str):
        self.uri, self.root = uri, root
        self.tools: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("tool",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.tools = asked if self.tools is None else self.tools & asked
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            else:
                yield f

    def partitions(self) -> list[Reports]:
        files, folder = _opened(self.uri)
        out: list[Reports] = []
        for tool in sorted(set(FORMS) & (self.tools if self.tools is not None else set(FORMS))):
            found = sorted(f.path for f in files.get_file_info(fs.FileSelector(f"{folder}/{tool}", allow_not_found=True)) if f.base_name.endswith(".json"))
            out += [Reports(tool, found[i : i + BATCH]) for i in range(0, len(found), BATCH)]
        return out or [Reports("", [])]

    def read(self, part: Reports) -> Iterator[tuple]:
        files, _ = _opened(self.uri)
        for path in part.paths:
            row = {"tool": part.tool, "report": path.rpartition("/")[2]}
            try:
                rows = list(FORMS[part.tool](_read(files, path).decode(), self.root))
                made = [row | {"status": "finding"} | r for r in rows if r["path"].startswith(self.prefix)]
            except (ValueError, AttributeError, TypeError) as e:
                made = [] if self.prefix else [row | {"status": "failed", "reason": "not JSON" if isinstance(e, json.JSONDecodeError) else str(e)[:500]}]
            for r in made:
                yield tuple(r.get(n) for n in NAMES)


class AnalyzerReports(DataSource):
    """``strata_reports``: option ``path`` is the folder, option ``root`` the folder that absolute paths are made relative to."""

    @classmethod
    def name(cls) -> str:
        return "strata_reports"

    def schema(self) -> str:
        return FINDINGS

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options["path"], self.options.get("root", ""))


def read_reports(spark: SparkSession, folder: str, root: str = "") -> DataFrame:
    """Findings and failed reports of all tools under a folder. Filters reach the source where the session allows it, which this turns on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnalyzerReports)
    return spark.read.format("strata_reports").option("path", folder).option("root", root).load()
