"""Exact token-length histogram and what follows from its suffix sums.

One pass encodes every text and keeps only its length. The histogram (one row a
distinct length) answers, for every context limit, how many documents fit, how
many tokens remain after truncation, and every quantile of the lengths.

Defined results: null and empty texts have zero tokens and are counted; repeated
rows count once each; ties (equal lengths) are one row; very long texts are encoded
whole; an empty table gives an empty histogram; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import tokens
from strata.llm.common import stored

#: Lengths in a block of the two-level suffix sums.
BLOCK = 256


def _lengths(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(path).encode
        for batch in batches:
            yield pd.DataFrame({"n_tokens": [len(encode(x)) // 4 for x in batch["text"]]}).astype("int64")
        tokens.encoder(path).forget()

    return run


def histogram(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length. Map-side counts, then one small shuffle.

    The few rows are stored, as every report reads them more than once and texts are to be encoded once.
    """
    lengths = documents.select(F.col("text").cast("string").alias("text")).mapInPandas(_lengths(tokenizer or tokens.default_path()), "n_tokens long")
    return stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")


def suffix_report(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L of a histogram: documents and tokens below, at and above L, and totals when all texts are cut at L.

    ``truncated_tokens`` is the sum of min(length, L). Sums run within blocks of
    lengths and over the totals of blocks, so no task sees the whole histogram.
    """
    base = counts.select(
        F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_docs").cast("long").alias("n_docs"),
        F.floor(F.col("n_tokens") / block).cast("long").alias("b"), (F.col("n_tokens") * F.col("n_docs")).cast("long").alias("tokens_here"),
    )
    blocks = base.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("tokens_here").alias("bt"))
    # One row a block: at most the longest length over the block size.
    prior = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "b", F.coalesce(F.sum("bd").over(prior), F.lit(0)).alias("before_docs"), F.coalesce(F.sum("bt").over(prior), F.lit(0)).alias("before_tokens"),
        F.sum("bd").over(whole).alias("total_docs"), F.sum("bt").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("b").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens_here").over(inside)).join(blocks, "b")
    docs_to, tokens_to = F.col("before_docs") + F.col("d"), F.col("before_tokens") + F.col("t")
    longer = F.col("total_docs") - docs_to
    return rows.select(
        "n_tokens", "n_docs", docs_to.alias("docs_fitting"), longer.alias("docs_longer"), tokens_to.alias("tokens_in_fitting"),
        (tokens_to + longer * F.col("n_tokens")).alias("truncated_tokens"), "total_docs", "total_tokens",
        (docs_to / F.col("total_docs")).alias("quantile"),
    )


def limits(counts: DataFrame, context_limits: list[int]) -> DataFrame:
    """(context_limit, docs_fitting, truncated_tokens, total_tokens) for any limits, in one aggregation of a histogram."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    sums = [
        F.struct(
            F.lit(limit).cast("long").alias("context_limit"), F.coalesce(F.sum(F.when(n <= limit, d)), F.lit(0)).alias("docs_fitting"),
            F.coalesce(F.sum(F.least(n, F.lit(limit)) * d), F.lit(0)).alias("truncated_tokens"), F.coalesce(F.sum(n * d), F.lit(0)).alias("total_tokens"),
        )
        for limit in context_limits
    ]
    return counts.agg(F.array(*sums).alias("answers")).select(F.inline("answers"))
