"""Repeats decide the blocks outside articles on every page."""

from __future__ import annotations

from strata.llm import html_extract


def test_unique_blocks_outside_an_article_stay(spark):
    rows = [(i, f"http://host.example/{i}", f"<body><div>lead{i} a{i} b{i} c{i} d{i}</div><div>Welcome to our fine web site</div><article><p>text {i}</p></article><nav>n{i}</nav></body>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {i: f"lead{i} a{i} b{i} c{i} d{i}\n\ntext {i}" for i in range(5)}
