"""Searches over the trigram index against full scans."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from strata.operators import code_search as C

TEXTS = {
    "a.py": "import os\nos.system('rm')\nresult = eval(x)\n" + "\n".join(f"filler number {i}" for i in range(250)) + "\nLAST Eval ( y )",
    "b.py": "Ｋ KELVIN ſtrange ıstanbul İSTANBUL\nkelvin strange istanbul\n\n  \nab",
    "c.py": "abc|def\nfoo.bar\nfoobar\nfoo+bar\nfooooobar\n[x] (y)\nStraße STRASSE ΣΑΣ σας",
}
PATTERNS = [
    r"eval\s*\(", r"os\.system|subprocess", r"fo+bar", r"foo(\+|\.)bar", r"(abc|xyz)\|def", r"filler number 24[0-9]", r"a", r"", r"^$", r"kelvin", r"strange", r"istanbul", r"straße", r"(?:foo)?bar", r"(foo){1,2}(?!\.)bar", r"foo(?=bar)", r"[a-f]{3}\|",
    r"last eval \( y \)", r"number (12|240)$", r"x{0}foo", r"fo{2,}bar", r"\[x\] \(y\)", r"nothing here", r"\bimport\b", r"σας", r"filler.*249", r"(?<!x)result", r"resu(l)?t", r"foob?.?ar", r"a\x62c", r"[[a]b]c", r"(filler) (number) 7",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index")) + "/i"
    C.write_index(spark.createDataFrame(list(TEXTS.items()), "path string, text string"), folder, page_lines=20)
    return folder


def test_same_as_a_full_scan(spark, index):
    cases = [(p, True) for p in PATTERNS] + [(p, False) for p in ("eval", "foo.bar", "a", "İSTANBUL", "strasse", "filler number 24", "σας", "ab")]
    quoted = lambda p: p.replace("\\", "\\\\").replace("'", "\\'")
    hits = [f"text rlike '(?iu){quoted(p)}' as h{i}" if regex else f"contains(lower(text), lower('{quoted(p)}')) as h{i}" for i, (p, regex) in enumerate(cases)]
    lines = spark.read.parquet(f"{index}/pages").selectExpr("path", "explode(lines) as x").selectExpr("path", "x.line", "x.content as text").selectExpr("*", *hits).orderBy("path", "line").collect()
    for i, (p, regex) in enumerate(cases):
        assert C.search(spark, index, p, regex).collect() == [tuple(r)[:3] for r in lines if r[f"h{i}"]][:30], p


def test_literals_of_patterns():
    assert C.alternatives(r"eval\s*\(") == [["eval"]]
    assert C.alternatives(r"os\.system|subprocess") == [["os.system"], ["subprocess"]]
    assert C.alternatives(r"fo+bar") == [["bar"]] and C.alternatives(r"abcd?efg") == [["abc", "efg"]]
    assert C.alternatives(r"(abc|xyz)def") == [["def"]] and C.alternatives(r"(abc)def") == [["abc", "def"]]
    for p in ("a|bcd", "(?x) a b c", "[abc]", "(abc)?", "(?!abc)", "(abc)*d", r"\d\w+", "[a[b]cde]fgh"):
        assert C.alternatives(p) == [[]], p


def test_pages_are_pruned(spark, index):
    plan = C.pages_to_read(spark, index, C.alternatives("filler number 24[0-9]"))
    assert 0 < plan.count() < spark.read.parquet(f"{index}/pages").count()
    text = plan._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text) and re.search(r"PushedFilters: \[[^\]]*(In|EqualTo|GreaterThan)[^\]]*page", text)
    posts = C.candidates(spark, index, [["system"]])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", posts) and re.search(r"PushedFilters: \[[^\]]*trigram", posts)


def test_many_pages_are_joined(spark, index, monkeypatch):
    want = C.search(spark, index, "filler", limit=100).collect()
    monkeypatch.setattr(C, "NAMED_PAGES", 2)
    assert C.search(spark, index, "filler", limit=100).collect() == want and len(want) == 100


def test_long_lines_and_letters_of_two_units(spark, tmp_path):
    # Each trigram of a line used to split the whole line anew, so the work grew with the square of its length; 60,000 characters took minutes.
    long = "".join(chr(97 + i * i * 7 % 26) for i in range(60_000)) + "a𝄞b"
    files = spark.createDataFrame([("long", f"{long}\n\nxy"), ("end", "q" * C.PIECE + "zw"), ("empty", ""), ("null", None)], "path string, text string")
    start = time.perf_counter()
    C.write_index(files, f"{tmp_path}/i")
    assert time.perf_counter() - start < 60
    posts = spark.read.parquet(f"{tmp_path}/i/postings").join(spark.read.parquet(f"{tmp_path}/i/pages"), "page").groupBy("path").agg(F.collect_list("trigram").alias("t"))
    got = {r.path: sorted(r.t) for r in posts.collect()}
    assert got == {"long": sorted({long[i : i + 3] for i in range(len(long) - 2)}), "end": ["qqq", "qqz", "qzw"]}
    assert [(r.path, r.line) for r in C.search(spark, f"{tmp_path}/i", "QQZW").collect()] == [("end", 1)]
