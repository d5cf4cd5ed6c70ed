"""Rules over lines: the fixed line rules with their path gates, and rules that are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T

#: A text that every match of a rule holds; lines without it aren't searched.
GATES = {
    "SEC-EVAL": "(", "SEC-SUBPROCESS-SHELL": "shell", "SEC-HARDCODED-SECRET": "=", "SEC-SQL-CONCAT": "(", "REL-EMPTY-EXCEPT": "except", "REL-DEBUG-PRINT": "(", "TXT-ASSIGNED-SECRET": "=", "TXT-CLOUD-KEY": "AKIA", "TXT-EMAIL": "@",
}

Rule = tuple[str, str, str, str, str]
#: The fixed rules as (id, severity, source, weakness, pattern).
SOURCE_RULES: list[Rule] = [(rule, severity, "local-rules", T.RULE_TO_CWE[rule], pattern) for rule, severity, pattern in T.LINE_RULES]


def applies(rule: str, path: Column) -> Column:
    """Whether a rule reads files of a path: none reads generated or locked ones, and evaluation is no risk in native code."""
    def ends(suffixes: tuple[str, ...]) -> Column:
        return path.rlike("(?i)(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z")

    gate = ~ends(T.SKIPPED_SUFFIXES)
    return gate & ~ends(T.NATIVE_SUFFIXES) if rule == "SEC-EVAL" else gate


def faster(pattern: str) -> str:
    """The same condition on a line, without a new try inside every long run of letters."""
    run = r"[A-Za-z0-9+/]{32,}"
    return rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{32}}" if pattern == run else pattern


def line_hits(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """A finding for each line (path, line, content) and rule that match; rules are literals, so the scan stays one narrow stage."""
    content = F.col("content")

    def hit(i: int, rule: str, severity: str, source: str, cwe: str, pattern: str) -> Column:
        found = content.rlike(faster(pattern))
        if rule in GATES:
            found = F.contains(content, F.lit(GATES[rule])) & found
        return F.when(found & applies(rule, F.col("path")), F.struct(F.lit(i).alias("rule_seq"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(source).alias("source"), F.lit(cwe).alias("cwe")))

    hits = F.array_compact(F.array(*[hit(i, *rule) for i, rule in enumerate(rules)]))
    found = lines.select("*", F.explode(hits).alias("hit")).select(*lines.columns, "hit.*")
    return found.withColumns({"confidence": F.lit(T.RULE_CONFIDENCE), "evidence": T.evidence_clip(content), "seq": F.col("rule_seq").cast("long"), "verification_state": F.lit("unverified"), "evidence_kind": F.lit("rule")})


def declared_hits(lines: DataFrame, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """Lines (path, line, content) joined to the rules (rule_id, include, exclude, literal, fold) that match them.

    A rule reads paths with an included prefix (all, if it lists none) and none with an excluded one, and wants its literal
    in the line, whatever its case if ``fold``. There are at most ``most`` rules, which is counted; they go to every task.
    """
    if rules.count() > most:
        raise ValueError(f"more than {most} declared rules")
    path, content = F.col("path"), F.col("content")
    under = lambda prefixes: F.exists(prefixes, lambda p: F.startswith(path, p))
    wanted = (F.size("include") == 0) | under("include")
    same = F.when(F.col("fold"), F.contains(F.lower(content), F.lower("literal"))).otherwise(F.contains(content, F.col("literal")))
    return lines.join(F.broadcast(rules), wanted & ~under("exclude") & same & (F.col("literal") != "")).select(*lines.columns, "rule_id")
