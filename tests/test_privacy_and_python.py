from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import dataflow, privacy, python_facts


def test_base64_spans_and_redaction(spark):
    texts = ["x " + "A" * 33 + " y", "B" * 30 + "== z", "C" * 31, "D" * 32 + "=E", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(privacy.base64_spans(F.col("t"))).collect()]
    assert got == [["A" * 32], ["B" * 30 + "=="], [], ["D" * 32], None]
    out = [r[0] for r in df.select(privacy.redacted(F.col("t"), "tenant", b"key")).collect()]
    assert out[0].startswith("x [REDACTED:") and out[0].endswith("]A y") and out[2] == "C" * 31 and out[4] is None
    other = df.select(privacy.redacted(F.col("t"), "other", b"key")).first()[0]
    assert other != out[0]


def test_structured_walk(spark):
    rows = [
        ("a", '{"user": {"api_key": {"x": 1}}, "note": "fine"}'), ("b", '["ok", "ftp://me:pw@host"]'), ("c", '{"deep": {"list": [{"note": "' + "Q" * 32 + '"}]}}'), ("d", '{"n": 1}'), ("e", "{broken"), ("f", None),
    ]
    df = spark.createDataFrame(rows, "id string, payload string")
    got = {r["id"]: (r["classification"], r["flagged"]) for r in privacy.classified(df, "id", "payload").collect()}
    assert got == {"a": ("sensitive", 1), "b": ("restricted", 1), "c": ("sensitive", 1), "d": ("internal", 0), "e": ("sensitive", 1), "f": ("internal", 0)}
    assert privacy.structured_entries(df, "id", "payload").where("id = 'c'").first()["path"] == "0.0.0.0"
    assert privacy.classified(df.where("id = 'c'"), "id", "payload", depth=2).first()["classification"] == "sensitive"


SOURCE = '''
import os, subprocess
from flask import request

@app.route("/run")
def run():
    raw = request.args.get("cmd")
    cleaned = raw.strip()
    go(cleaned)
    count = int(request.args.get("n"))
    os.system(count)
    return helper()

def go(command):
    subprocess.run("x " + command, shell=True)
    subprocess.run(["x", command])

def helper():
    return os.getenv("HOME")

def use(cursor):
    value = helper()
    cursor.execute("select " + value)
    eval("1")
'''


def test_python_facts(spark):
    files = spark.createDataFrame([("app.py", SOURCE), ("bad.py", "def ("), ("x.js", "eval(x)")], "path string, text string")
    found = python_facts.facts(files).cache()
    assert [(r["line"], r["kind"]) for r in python_facts.definitions(found, "helper").collect()] == [(18, "function")]
    assert found.where("kind = 'broken'").count() == 1
    edges = {(r["caller"], r["callee"]) for r in python_facts.call_edges(found).collect()}
    assert edges == {("run", "go"), ("run", "helper"), ("use", "helper")}
    surface = {(r["kind"], r["name"]) for r in python_facts.attack_surface(found).collect()}
    assert {("entrypoint", "run"), ("source", "request.args.get"), ("source", "os.getenv"), ("sink", "os.system"), ("sink", "eval"), ("sink", "cursor.execute"), ("sink", "subprocess.run"), ("unresolved", "cursor.execute")} <= surface
    sinks = {(r["line"], r["sink"], r["cwe"], r["origin"]) for r in python_facts.tainted_sinks(found).collect()}
    assert sinks == {(15, "subprocess.run", "CWE-78", "request query parameter"), (23, "cursor.execute", "CWE-89", "environment variable")}


def test_parsing_is_dealt(spark):
    """A table that is read in one split is parsed by as many tasks as a shuffle has."""
    files = spark.createDataFrame([(f"m{k}.py", f"p{k}", "x = input()\neval(x)\n") for k in range(40)], "path string, project string, text string").coalesce(1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for found in (python_facts.facts(files), dataflow.flows(files)):
        assert found.rdd.getNumPartitions() == parts > 1
        assert found.select("path").distinct().count() == 40
