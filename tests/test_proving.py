from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.operators import graph, proving
from strata.plans import proofs
from strata.plans.catalog import QUERIES, table

FACT = (
    "fact_id string, kind string, translation_unit string, canonical_path string, function_usr string, source_range struct<start:int,end:int>, pointer_id string, related_fact_ids array<string>, api string, source_pointer_id string, cfg_block int"
)


def some_facts(units: int, seed: int = 5) -> list[tuple]:
    """Facts of small functions that share units and pointers, with nulls, empty names, cycles, and releases from other functions."""
    rng = random.Random(seed)
    pointers = ["p", "q", "r", "s", "", None]
    out = []
    for u in range(units):
        made = [f"{u}-a{i}" for i in range(4)]
        kinds = ["allocation"] * 4 + rng.choices(["release", "dereference", "member-access", "alias-copy", "points-to", "rebind", "lifetime-restart", "cfg-node"], [6, 6, 2, 8, 1, 3, 1, 1], k=26)
        for i, kind in enumerate(kinds):
            line = rng.randint(1, 12) + (10 if kind in ("dereference", "member-access") else 0)
            span = None if rng.random() < 0.03 else (None if rng.random() < 0.05 else line, None if rng.random() < 0.05 else line + rng.randint(0, 1))
            related = rng.choices([*made, "x"], k=rng.randint(0, 3)) if kind == "release" else []
            pick = lambda most: rng.choices(pointers, [8, 6, 4, 2, most, most])[0]
            out.append((made[i] if i < 4 else f"{u}-{i}", kind, None if rng.random() < 0.02 else f"u{u}", "x.c", rng.choices(["f", "", None], [20, 4, 1])[0], span, pick(0.5), related, rng.choice(["malloc", "own", None]), pick(0.3), rng.choice([0, 0, 1, None])))
    return out


def gaps(spark, units: int):
    rows = [(f"u{u}", [True, True, False, None][u % 4], [[], ["cfg-loop"], [], ["lifetime-restart"], None][u % 5]) for u in range(1, units)]
    return spark.createDataFrame(rows, "translation_unit string, cfg_complete boolean, semantic_gaps array<string>")


@pytest.fixture(scope="module", autouse=True)
def no_broadcasts(spark):
    """The joins have dozens of small sides, each of which would take a page of memory as long as the driver keeps it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def case(spark):
    facts = spark.createDataFrame(some_facts(120), FACT).repartition(3).cache()
    complete, coverage = graph.graph_complete(facts), gaps(spark, 120)
    return facts, complete, coverage, Counter(map(tuple, graph.obligations(graph.candidates(facts), facts, complete, coverage).collect()))


@pytest.mark.parametrize("most", [proving.HELD, 16])
def test_same_as_by_joins(case, most):
    """In one pass, and by joins for larger functions only."""
    facts, complete, coverage, want = case
    assert len(want) > 700 and len({s for _, o, s in want if o in ("P2", "P6", "P7")}) == 3
    assert Counter(map(tuple, proving.proved(facts, complete, coverage, most).collect())) == want


def test_same_without_coverage(case):
    facts, complete, _, _ = case
    want = Counter(map(tuple, graph.obligations(graph.candidates(facts), facts, complete).collect()))
    assert Counter(map(tuple, proving.proved(facts, complete).collect())) == want


def shuffled(spark, build) -> int:
    """Rows that the stages of a frame shuffle, with those that are run to build it."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, none, None))}
    before = stages()
    build().write.format("noop").mode("overwrite").save()
    return sum(v for k, v in stages().items() if k not in before)


def test_a_fact_is_shuffled_once(spark, sf_dir):
    """Of the facts that the query reads: one row a fact, and those of allocations and releases once more."""
    read = lambda name: table(spark, sf_dir, name)
    n = proofs._facts(read).count()
    assert shuffled(spark, lambda: proofs._statuses(read)) < 3 * n


def test_a_verdict_is_shuffled_once(spark, sf_dir):
    """No more than the facts and a row for each verdict."""
    n = proofs._facts(lambda name: table(spark, sf_dir, name)).count()
    verdicts = QUERIES["proof_verdicts"](spark, sf_dir)
    assert shuffled(spark, lambda: QUERIES["proof_verdicts"](spark, sf_dir)) < 3 * n + verdicts.count()


def test_one_large_function(spark):
    """Objects of one function: each root meets what it reaches."""
    i = F.col("id").cast("string")
    made = lambda p, kind, line, pointer, related=None, source=None: spark.range(3_000).select(
        F.concat(F.lit(p), i).alias("fact_id"), F.lit(kind).alias("kind"), F.lit("u").alias("translation_unit"), F.lit("x.c").alias("canonical_path"), F.lit("").alias("function_usr"), F.struct(F.lit(line).alias("start"), F.lit(line).alias("end")).alias("source_range"),
        F.concat(F.lit(pointer), i).alias("pointer_id"), (F.array(F.concat(F.lit(related), i)) if related else F.array().cast("array<string>")).alias("related_fact_ids"), F.lit("malloc").alias("api"), (F.concat(F.lit(source), i) if source else F.lit(None).cast("string")).alias("source_pointer_id"),
        F.lit(1).alias("cfg_block"),
    )
    facts = made("a", "allocation", 10, "p").unionByName(made("r", "release", 20, "p", "a")).unionByName(made("e", "alias-copy", 15, "q", source="p")).unionByName(made("d", "dereference", 30, "q"))
    for most in (proving.HELD, 2_000):
        got = proving.proved(facts, graph.graph_complete(facts), most=most).groupBy("obligation", "status").count().where("obligation in ('P2', 'P6')").collect()
        assert sorted(map(tuple, got)) == [("P2", "SATISFIED", 3_000), ("P6", "SATISFIED", 3_000)]
