"""Audits by levels, shortened budgets and wire bundles."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from strata.operators import audit, ranking
from strata.sources import wire

RUN = "A1" * 20


def test_audit(spark):
    payloads = {
        1: '{"b": {"y": "%s", "x": ["-", {"k": "é %s."}]}, "a": "%s"}' % (RUN, RUN, RUN), 2: f'"{RUN}"', 3: None, 4: "", 5: '{"a": 1, "a": 2}', 6: "[]", 7: '{"a": "{\\"b\\": \\"%s\\"}"}' % RUN, 8: "[" * 6 + "]" * 6, 9: '["%s %s", "%sX"]' % (RUN, RUN, RUN),
        10: "null", 11: '{"": "%s"}' % RUN,
    }
    df = spark.createDataFrame(list(payloads.items()), "id int, payload string").repartition(3)
    rows = audit.audited(df, ["id"], max_depth=5).orderBy("id", "seq").collect()
    got = {i: [(r["path"], r["start"], r["end"]) if r["error"] is None else r["error"] for r in rows if r["id"] == i] for i in payloads}
    assert got == {
        1: [("m0.m0", 0, 40), ("m0.m1[1].m0", 2, 42), ("m1", 0, 40)], 2: [(None, 0, 40)], 3: [], 4: ["NOT_JSON"], 5: ["NOT_JSON"], 6: [], 7: [("m0", 7, 47)], 8: ["MAX_DEPTH_EXCEEDED"], 9: [("[0]", 0, 40), ("[0]", 41, 81), ("[1]", 0, 40)], 10: [], 11: [("m0", 0, 40)],
    }
    assert audit.audited(df.limit(0), ["id"]).count() == 0
    over = audit.audited(df.where("id = 1"), ["id"], max_items=2).collect()
    assert [(r["path"], r["error"]) for r in over] == [("findings", "RESOURCE_LIMIT_EXCEEDED")]


def test_shortened(spark):
    rows = [("g", 1, "ab"), ("g", 2, "é€"), ("g", 3, "zz"), ("h", 1, "abcdef"), ("h", 2, "x"), ("i", 1, "𝄞𝄞"), ("k", 1, None), ("k", 2, "abcde"), ("k", 3, "x")]
    got = ranking.budget_shorten(spark.createDataFrame(rows, "g string, n int, text string"), ["g"], ["n"], "text", 5).orderBy("g", "n").collect()
    assert [tuple(r) for r in got] == [("g", 1, "ab", False), ("g", 2, "é", True), ("h", 1, "abcde", True), ("i", 1, "𝄞", True), ("k", 1, None, False), ("k", 2, "abcde", False)]


def test_wire_of_odd_texts(spark):
    rows = [(1, "", "s", "c", ""), (2, None, "s", "c", ""), (3, "[1]", "s", "c", ""), (4, "{}", "s", "c", ""), (5, '{"translation_units": [3, {"facts": [7]}]}', "s", "c", "")]
    found = wire.violations(spark.createDataFrame(rows, "bundle_id int, raw string, snapshot_hash string, context_hash string, root string")).groupBy("bundle_id").agg(F.collect_set(F.concat_ws("|", "place", "violation")).alias("v"))
    got = {r["bundle_id"]: set(r["v"]) for r in found.collect()}
    assert got[1] == got[2] == got[3] == {"bundle|not-an-object:"}
    assert {f"bundle|missing-field:{n}" for n in wire.BUNDLE} <= got[4]
    assert {"unit/0|not-an-object:", "unit/1/fact/0|unknown-kind"} <= got[5]


def test_a_bundle_is_made_and_read_once(spark):
    # Each level and check used to make the raw texts anew, and filters before explodes made them again.
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def raw(n):
        made.add(1)
        facts = [{"fact_id": f"{i % 3:064d}", "kind": "release", "related_fact_ids": [f"{2:064d}", f"{7:064d}", None]} for i in range(n)]
        return json.dumps({"translation_units": [{"facts": facts}, {"facts": []}, None], "note": 1, "diagnostics": []})

    bundles = spark.createDataFrame([(1, 4), (2, 0), (3, wire.MOST_FACTS + 1)], "bundle_id int, n int").select("bundle_id", raw("n").alias("raw"), F.lit("s").alias("snapshot_hash"), F.lit("c").alias("context_hash"), F.lit("").alias("root"))
    rows = wire.violations(bundles).collect()
    assert made.value == 3
    of = lambda b, v: sorted(r.place for r in rows if (r.bundle_id, r.violation) == (b, v))
    assert of(1, "duplicate-id") == ["unit/0/fact/3"] and of(1, "dangling-reference") == sorted([f"unit/0/fact/{i}" for i in range(4)] * 2)
    assert of(3, "fact-budget") == ["bundle"] and of(1, "fact-budget") == of(2, "fact-budget") == [] and len(of(3, "duplicate-id")) == wire.MOST_FACTS - 2
    assert of(2, "unknown-field:note") == ["bundle"] and of(2, "not-an-object:") == ["unit/2"] and of(1, "missing-field:coverage") == ["unit/0", "unit/1"]


def test_levels_keep_their_partitions(spark):
    # Objects and arrays were a union, so partitions doubled with each level.
    rows = spark.createDataFrame([(1, "", [], '{"b": ["x"], "a": "y"}', "OBJECT"), (1, "m0", [0], '["x", 1, {}]', "ARRAY")], "id int, path string, places array<int>, text string, kind string")
    inner = audit._children(audit.cut(rows.repartition(2)), ["id"])
    assert inner.rdd.getNumPartitions() == 2
    assert sorted((r.path, r.places, r.text, r.kind) for r in inner.collect()) == [("m0", [0], '["x"]', "ARRAY"), ("m0[0]", [0, 0], "x", "STRING"), ("m0[2]", [0, 2], "{}", "OBJECT"), ("m1", [1], "y", "STRING")]
