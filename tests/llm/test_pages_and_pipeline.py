"""Page extraction against the pages' own parts, and the pipeline stage by stage."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import html_extract, registry


def page(rng, i, article, extra=""):
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "About", "Contact"))
    return (
        f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body><header><p>Site name</p></header><nav><ul>{nav}</ul></nav>'
        f'<!-- <p>hidden</p> --><div class="ad banner">Buy now &amp; here</div>{article}<aside><p>Side</p></aside><section id="comments"><p>First!</p></section><form><p>Your mail</p></form>{extra}<footer>&copy; site</footer></body></html>'
    )


def extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    return {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}


def test_article_text(spark):
    rng = random.Random(1)
    body = '<article><header><h1>Tom &amp;amp; Jerry</h1></header><p>One\n  two<br>three <b>bold</b>&#33;<p>Next &lt;p&gt;&nbsp;x</p><ul><li>a</li><li>b</li></ul></article>'
    rows = [(1, "http://h/1", page(rng, 1, body)), (2, "http://h/2", page(rng, 2, "<main><p>Only <i>this</i></p></main>")), (3, None, None), (4, "x", ""), (5, "http://h/5", "<article><p>cut &am"), (6, "http://h/6", "<article><p>a < b</p><p cl")]
    got = extract(spark, rows)
    assert got[1] == "Tom &amp; Jerry\n\nOne two three bold!\n\nNext <p> x\n\na\n\nb"
    assert got[2] == "Only this"
    assert (got[3], got[4], got[5], got[6]) == ("", "", "cut &am", "a < b")


def test_odd_pages(spark):
    big = (1 << 60) + 1
    rows = [(big, "http://h/1", "<article>a</article>"), (None, "http://h/1", "<article>b</article>"), (None, None, None), (big, "http://h/1", "<article>a</article>"), (7, "http://h/" + "x" * 9000, "<div><span>" * 30_000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in html_extract.extract(df).collect())
    assert got == [(0, "", 0), (0, "b", 1), (7, "deep", 4), (big, "a", 1), (big, "a", 1)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_unmarked_boilerplate_goes(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(40):
        words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        rows.append((i, "http://host.example/x", f"<body><div>Welcome to our fine web site</div><div>{words}</div><div>All about cookies and more things</div></body>"))
        want[i] = words
    assert extract(spark, rows) == want


def plain_texts(rows):
    """Texts by trying every run of every page of a host: pages are lists of blocks of words, all open."""
    n = html_extract.REPEAT_WORDS
    filled = [(host, [[*b, *[""] * (n - len(b))] for b in blocks]) for host, blocks in rows]
    runs = {}
    for host, blocks in {(h, tuple(map(tuple, bs))) for h, bs in filled}:  # equal pages are one
        for run in {(host, b[i : i + n]) for b in blocks for i in range(len(b) - n + 1)}:
            runs[run] = runs.get(run, 0) + 1
    out = []
    for (host, blocks), (_, plain) in zip(filled, rows):
        kept = []
        for b, words in zip(blocks, plain):
            covered = {k for i in range(len(b) - n + 1) if runs[host, tuple(b[i : i + n])] >= html_extract.REPEAT_PAGES for k in range(i, i + n)}
            if len(covered) < html_extract.COVERED * len(b):
                kept.append(" ".join(words))
        out.append("\n\n".join(kept))
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    """Pages without markup, in several shards a host: whole blocks, parts of blocks, short blocks and equal pages repeat."""
    monkeypatch.setattr(html_extract, "SHARD_PAGES", 4)
    rng = np.random.default_rng(3)
    pool = [[f"p{k}x{i}" for i in range(rng.integers(1, 22))] for k in range(12)]
    rows = []
    for i in range(60):
        blocks = []
        for _ in range(rng.integers(1, 6)):
            own, shared = [f"w{rng.integers(0, 6)}" for _ in range(rng.integers(1, 25))], pool[rng.integers(0, len(pool))]
            blocks.append([own, shared, [*own, *shared], [*shared[: rng.integers(0, 12)], *own]][rng.integers(0, 4)])
        rows.append((f"h{i % 3}", [b for b in blocks if b]))
    rows += [rows[5], rows[6]]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", "<body>" + "".join(f"<div>{' '.join(b)}</div>" for b in blocks) + "</body>") for i, (h, blocks) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages.repartition(5)).collect()}
    want = plain_texts(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert 0 < sum(len(t) == 0 for t in want) + sum(len(t.split("\n\n")) < len(b) for t, (_, b) in zip(want, rows)) < len(rows) + 30


def test_given_pages(spark, sf_dir):
    """The generated pages' articles are their headings and paragraphs, and nothing of what stands around them."""
    import html
    import re

    got = {r["page_id"]: r["text"] for r in registry.op9_html_extraction(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", inside[1] if inside else "")]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = set(seen)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(out.collect(), out.schema)
        now = [r["doc_id"] for r in docs.collect()]
        assert len(now) == len(set(now)) and set(now) <= ids and len(now) > 0.7 * len(ids), name
        ids = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_stored_tables_can_be_cleared(spark):
    from strata.llm.common import clear_stored, stored

    clear_stored(spark)
    assert stored(spark.range(5), "x").count() == 5
    assert (clear_stored(spark), clear_stored(spark)) == (1, 0)


def test_queries_with_sql(spark, sf_dir):
    import os

    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, sf_dir)
        columns = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql}) x").fetchall()
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want)), name
