"""Repeats on pages without markup, and markup that is easily misread."""

from __future__ import annotations

from strata.llm import html_extract


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}


def own(i):
    return " ".join(f"w{i}x{k}" for k in range(12))


def test_equal_pages_count_as_one(spark):
    page = f"<body><div>{own(1)}</div></body>"
    assert texts(spark, [("http://h/1", page), ("http://h/2", page), ("http://h/3", f"<body><div>{own(2)}</div></body>")]) == {0: own(1), 1: own(1), 2: own(2)}


def test_short_blocks_that_repeat_go(spark):
    rows = [("http://h/1", f"<body><div>Home Contact</div><div>{own(i)}</div><div>Only {i}</div></body>") for i in range(4)]
    assert texts(spark, rows) == {i: f"{own(i)}\n\nOnly {i}" for i in range(4)}


def test_whole_maximal_repeats_go_and_common_phrases_stay(spark):
    notice = "we use cookies on this site to give you the best experience that we can"
    rows = [("http://h/1", f"<body><div>{notice}</div><div>{own(i)} as one of the most {own(i + 50)}</div></body>") for i in range(3)]
    assert texts(spark, rows) == {i: f"{own(i)} as one of the most {own(i + 50)}" for i in range(3)}


def test_without_the_array_repeats_would_stay(spark, monkeypatch):
    rows = [("http://h/1", f"<body><div>{own(7)}</div><div>{own(i)}</div><article>a{i}</article></body>") for i in range(3)]
    found = texts(spark, rows)
    assert found == {i: f"{own(i)}\n\na{i}" for i in range(3)}
    monkeypatch.setattr(html_extract, "REPEAT_PAGES", 100)
    assert texts(spark, rows) != found


def test_tags_and_class_names(spark):
    rows = [
        ("http://h/1", '<article><p title="a > b">Hello</p></article>'),
        ("http://h/2", '<body class="has-sidebar"><article><p>Text</p></article></body>'),
        ("http://h/3", '<article class="post menu"><div class="post-header"><h1>Title</h1></div><p>Body</p><div class="share-buttons">Share</div></article>'),
        ("http://h/4", '<body><div class="site-header">Top</div><div class="ad-slot">Buy</div><p class=note title=\'it > is\'>Kept</p></body>'),
        ("http://h/5", '<article><p title="open>Rest</p><p>More</p>'),
    ]
    assert {k: v for k, v in texts(spark, rows).items() if k < 4} == {0: "Hello", 1: "Text", 2: "Title\n\nBody", 3: "Kept"}


def test_hostile_markup_takes_its_length():
    import time

    begun = time.time()
    for page in ('<p a="' * 50_000, "<p a='\"" * 50_000, "<p =" * 100_000, "<" * 200_000, "<p " + "a=b " * 100_000):
        html_extract.blocks_of(page)
    assert time.time() - begun < 30
