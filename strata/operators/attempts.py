"""Plug-in functions over rows: a mapping whose failures are rows, and scanners as table functions of SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.graph import cut


def attempted(df: DataFrame, fn: Callable[[object], object], value: str, returns: str, result: str = "result", failure: str = "failure") -> DataFrame:
    """All rows with ``fn`` of a column: its result, or the failure as "Type: message"; one failing row stops no other.

    Spark deals the rows, so there is no limit on workers to give. ``fn`` gets nulls, too. The result is a reliable checkpoint,
    so that ``fn`` runs once a row (twice only where a task is lost), however often the frame is used.
    """

    def one(v: object) -> tuple[object, str | None]:
        try:
            return fn(v), None
        except Exception as e:  # each failure becomes a row
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf(f"result {returns}, failure string")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["result", "failure"], dtype=object)

    # Not deterministic as far as Spark knows: otherwise both fields may call it, and filters be pushed below it.
    out = df.withColumn("_tried", run.asNondeterministic()(value))
    return cut(out.withColumns({result: F.col("_tried.result"), failure: F.col("_tried.failure")}).drop("_tried"))


def results_and_failures(tried: DataFrame, order: list[str], result: str = "result", failure: str = "failure") -> tuple[DataFrame, DataFrame]:
    """Results and failures of ``attempted``, each in the order of its items."""
    return tried.where(F.col(failure).isNull()).drop(failure).orderBy(*order), tried.where(F.col(failure).isNotNull()).drop(result).orderBy(*order)


def register_scanner(spark: SparkSession, name: str, scan: Callable[[str, str], Iterable[tuple[str, int, str]]]) -> None:
    """Make ``scan(path, text)`` a table function of SQL: rule_id, line, evidence. Null texts give no rows."""

    class Scanner:
        def eval(self, path: str, text: str):
            if text is not None:
                yield from scan(path, text)

    spark.udtf.register(name, F.udtf(Scanner, returnType="rule_id string, line int, evidence string"))
