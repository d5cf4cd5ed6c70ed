"""Writers: guarded CSV, checksums, metric text, and appends that refuse to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose string cells no spreadsheet takes for a formula; fails if the path exists."""
    guarded = df.select(*[T.csv_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    guarded.write.mode("errorifexists").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """One column ``line`` with a table row for each row; bars, backslashes and line ends are escaped."""
    cells = [F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([\\|])", r"\\$1"), r"\r?\n", "<br>") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def checksums(df: DataFrame) -> DataFrame:
    """``digest  path`` lines of files (path, content)."""
    return df.select(F.concat_ws("  ", F.sha2("content", 256), "path").alias("line"))


def metric_text(samples: DataFrame, prefix: str = "strata") -> DataFrame:
    """Counter and duration lines (name, seconds) in the usual text format, sorted by name."""
    t = samples.groupBy("name").agg(F.count("*").alias("n"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("s"))
    line = F.array(
        F.concat(F.lit(f"{prefix}_"), "name", F.lit("_total "), F.col("n").cast("string")), F.concat(F.lit(f"{prefix}_"), "name", F.lit("_seconds_sum "), F.format_string("%.6f", "s")),
        F.concat(F.lit(f"{prefix}_"), "name", F.lit("_seconds_count "), F.col("n").cast("string")),
    )
    return t.select("name", F.posexplode(line).alias("part", "line")).orderBy("name", "part").select("line")
