"""Searches with a truncation flag, look-ups that must succeed, and fields gathered from several documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def search(lines: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` (1 to 50) lines (path, line, content) with a text, case kept, and ``truncated``: was there one more."""
    if not needle or not 1 <= limit <= 50:
        raise ValueError("a search needs a text and a limit of 1 to 50")
    hits = lines.where(F.contains("content", F.lit(needle))).orderBy("path", "line").limit(limit + 1)
    order = Window.orderBy("path", "line")  # over at most 51 rows
    numbered = hits.withColumn("_n", F.row_number().over(order)).withColumn("truncated", F.max("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit)
    return numbered.where(F.col("_n") <= limit).select("path", "line", F.substring("content", 1, 500).alias("content"), "truncated")


def must_find(rows: DataFrame, known: DataFrame, key: str, found: str) -> DataFrame:
    """Rows with the ``found`` column of the known row of their key; a missing one raises when the row is read."""
    side = known.select(F.col(key), F.col(found).alias("_found"), F.lit(True).alias("_hit"))
    joined = rows.join(side, key, "left")
    value = F.when(F.col("_hit"), F.col("_found")).otherwise(F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))))
    return joined.withColumn(found, value).drop("_found", "_hit")


def comparable(value: Column) -> Column:
    """A form of a JSON text by which equal values are equal: numbers by value, whatever their spelling; anything else as it is.

    A boolean is never a number.
    """
    # Whole numbers beyond what a double holds exactly are compared digit by digit.
    whole = value.rlike(r"\A-?[1-9]\d{15,36}\z")
    number = value.rlike(r"\A-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\z")
    return F.when(number, F.concat(F.lit("n:"), F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise((value.cast("double") + F.lit(0.0)).cast("string")))).otherwise(F.concat(F.lit("v:"), value))


def conflicting_fields(values: DataFrame) -> DataFrame:
    """(entity, field, n) of fields that documents state differently. Values: entity, field, pointer, value as JSON text."""
    return values.groupBy("entity", "field").agg(F.count_distinct(comparable(F.col("value"))).alias("n")).where("n > 1")


def projected_fields(values: DataFrame, wanted: DataFrame, priority: str = "priority", tie: str | None = None) -> DataFrame:
    """Each wanted (entity, field) with the value of its first document, all pointers to it, and a reason where there is none.

    ``tie`` is a column that tells rows of one priority and pointer apart: the least one's value counts. A row without a value
    gives none, one without a pointer is no source; a missing priority or pointer comes last.
    """
    place = [F.isnull(priority).alias("_late"), priority, F.isnull("pointer").alias("_lost"), "pointer"]
    order = F.when(F.col("value").isNotNull(), F.struct(*place, *([tie] if tie else [])))
    pointers = F.transform(F.sort_array(F.collect_list(F.when(F.col("pointer").isNotNull(), F.struct(*place)))), lambda x: x["pointer"])
    first = values.groupBy("entity", "field").agg(F.min_by("value", order).alias("value"), pointers.alias("sources"), F.lit(True).alias("_stated"))
    out = wanted.join(first, ["entity", "field"], "left")
    note = F.when(F.col("_stated").isNull(), "not stated").when(F.col("value") == "null", "stated as null")
    return out.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).withColumn("note", note).drop("_stated")


def clipped(text: Column, limit: int | Column) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that cuts no character.

    A cut character leaves one to three of its bytes at the end, so at most three shorter prefixes are tried.
    """
    raw = text.cast("binary")
    most = F.lit(limit) if isinstance(limit, int) else limit
    tries = [F.substring(raw, F.lit(1), F.greatest(most - k, F.lit(0)).cast("int")) for k in range(4)]
    return F.coalesce(*[F.when(F.is_valid_utf8(t), t.cast("string")) for t in tries])
