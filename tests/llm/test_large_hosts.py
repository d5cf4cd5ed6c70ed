"""Repeats are found over all pages of a host, whatever its size."""

from __future__ import annotations

from strata.llm import html_extract


def test_a_rare_repeat_of_a_large_host_goes(spark):
    n = 400
    notice = "Our offices are closed on Monday"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(8))
    pages = []
    for i in range(n):
        extra = f"<div>{notice}</div>" if i in (3, n - 2) else f"<div>Quoted passage of one page {i // n}</div>" if i == 7 else ""
        aside = "<aside>Quoted passage of one page 0</aside>" if i == n - 5 else ""
        pages.append((i, "http://hot.example/x", f"<body><div>{body(i)}</div>{extra}{aside}</body>"))
    pages.append((n, "http://other.example/x", f"<body><div>{notice}</div></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(8, "page_id")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {**{i: body(i) for i in range(n)}, n: notice}
