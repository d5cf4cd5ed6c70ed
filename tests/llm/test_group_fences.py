"""Fences follow the spread of each group of language and source."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strata.llm import quality


def text(rng, words, symbols, length=5):
    made = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(length - 2, length + 2))) for _ in range(words)]
    for k in rng.sample(range(words), symbols):
        made[k] += "#"
    return " ".join(made)


def corpus(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, 100, 0), "en", "plain") for i in range(900)]
    rows += [(1000 + i, text(rng, 100, rng.randint(0, 20)), "en", "code") for i in range(300)]
    rows += [(2000 + i, text(rng, 100, 0, 9), "de", "plain") for i in range(300)]
    same = text(rng, 100, 9)
    rows += [(1, same, "en", "plain"), (2, same, "en", "code")]
    lengthy = text(rng, 100, 0, 9)
    rows += [(3, lengthy, "en", "plain"), (4, lengthy, "de", "plain"), (5, lengthy, None, None)]
    return spark.createDataFrame([(100_000 + a if i < 900 else a, *rest) for i, (a, *rest) in enumerate(rows)], "doc_id long, text string, lang string, source string")


def test_a_verdict_flips_with_the_group(spark):
    got = {r["doc_id"]: r for r in quality.filter_quality(corpus(spark).withColumn("high_symbol_rate", F.lit(1))).collect()}
    assert not got[1]["kept"] and got[2]["kept"]
    assert not got[3]["kept"] and got[4]["kept"]
    assert got[5]["high_word_length"] is not None
    assert got[1]["high_symbol_rate"] < got[2]["high_symbol_rate"]


def test_small_groups_lean_on_their_language(spark):
    docs = corpus(spark)
    few = docs.where("doc_id between 1000 and 1004").withColumn("source", F.lit("tiny")).withColumn("doc_id", F.col("doc_id") + 50_000)
    got = {r["source"]: r["high_symbol_rate"] for r in quality.filter_quality(docs.unionByName(few)).join(docs.unionByName(few).select("doc_id", "source"), "doc_id").where("not base_failed").collect()}
    assert got["plain"] < got["tiny"]


def test_fences_of_the_given_table_differ(spark, sf_dir):
    got = quality.filter_quality(spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet"))
    n = got.agg(*[F.countDistinct(c).alias(c) for c in ("high_word_length", "high_repeat_rate")]).first()
    assert n["high_word_length"] > 2 and n["high_repeat_rate"] > 2
