"""Unified diffs to added lines. Every line of every diff is a row, and positions come from windows over a diff's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions import text as T

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def added_lines(diffs: DataFrame, key: str = "id", diff: str = "diff") -> DataFrame:
    """(key, path, line, content) of lines that diffs add.

    The path is that of the last ``+++`` header, the line number counts added and context lines since the last hunk header.
    """
    w = Window.partitionBy(key).orderBy("pos")
    rows = diffs.select(key, F.posexplode(T.lines(F.col(diff))).alias("pos", "raw"))
    header = F.regexp_extract("raw", r"^\+\+\+ (?:b/)?([^\t]*)", 1)
    rows = rows.withColumn("is_file", F.startswith("raw", F.lit("+++ "))).withColumn("is_hunk", F.col("raw").rlike(HUNK))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("path", F.last(F.when(F.col("is_file"), header), ignorenulls=True).over(upto))
    rows = rows.withColumn("files", F.sum(F.col("is_file").cast("int")).over(upto)).withColumn("hunk", F.sum((F.col("is_hunk") | F.col("is_file")).cast("int")).over(upto))
    rows = rows.withColumn("start", F.last(F.when(F.col("is_hunk"), F.regexp_extract("raw", HUNK, 1).cast("int")).when(F.col("is_file"), F.lit(0)), ignorenulls=True).over(upto))
    body = ~F.col("is_file") & ~F.col("is_hunk")
    counts = body & (F.startswith("raw", F.lit("+")) | ~F.col("raw").rlike(r"^(-|\\)"))
    inside = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("nth", F.sum(counts.cast("int")).over(inside))
    kept = rows.where(body & F.startswith("raw", F.lit("+")) & (F.col("start") > 0) & F.col("path").isNotNull() & (F.col("path") != "/dev/null"))
    return kept.select(key, "path", (F.col("start") + F.col("nth") - 1).cast("long").alias("line"), F.substring("raw", F.lit(2), F.length("raw")).alias("content"))


def changed_files(diffs: DataFrame, key: str = "id", diff: str = "diff") -> DataFrame:
    """(key, path) of each file that a diff has a new side for, in first-seen order (``seq``)."""
    rows = diffs.select(key, F.posexplode(T.lines(F.col(diff))).alias("pos", "raw"))
    paths = rows.where(F.startswith("raw", F.lit("+++ "))).select(key, "pos", F.regexp_extract("raw", r"^\+\+\+ (?:b/)?([^\t]*)", 1).alias("path")).where("path <> '/dev/null'")
    return paths.groupBy(key, "path").agg(F.min("pos").alias("seq"))


def whole_file_as_added(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Every line of a file as an added line."""
    rows = files.select(F.col(path).alias("path"), F.posexplode(T.lines(F.col(text))).alias("pos", "content"))
    return rows.select("path", (F.col("pos") + 1).cast("long").alias("line"), "content")


def search_diff(diffs: DataFrame, needle: str, limit: int = 20, key: str = "id", diff: str = "diff") -> DataFrame:
    """(key, diff_line, content): the first ``limit`` (1 to 50) lines of each diff with a text, whatever its case; contents end at 500 characters."""
    wanted = needle.strip().lower()
    if not wanted:
        raise ValueError("a search needs a text")
    rows = diffs.select(key, F.posexplode(T.lines(F.col(diff))).alias("pos", "raw")).where(F.contains(F.lower("raw"), F.lit(wanted)))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= max(1, min(limit, 50))).select(key, (F.col("pos") + 1).alias("diff_line"), F.substring("raw", 1, 500).alias("content"))


def changed_line(asked: DataFrame, added: DataFrame, key: str = "id") -> DataFrame:
    """Asked lines (key, path, line) with ``found`` and the content of the added line at that place."""
    hits = added.groupBy(key, "path", "line").agg(F.first("content").alias("content"), F.lit(True).alias("_hit"))
    return asked.join(hits, [key, "path", "line"], "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")
