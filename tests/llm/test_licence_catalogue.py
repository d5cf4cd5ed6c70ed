"""Whole licence texts in other forms, and catalogues read from files."""

from __future__ import annotations

import re
import textwrap

from test_text_operators import frame

from strata.llm import licenses


def restyled(text, n):
    body = text.replace("<year>", "2021").replace("<owner>", "Some One").replace("<copyright holders>", "Some One")
    if n % 3 == 0:
        body = "\n\n".join("\n".join(textwrap.wrap(p, 60)) for p in body.split("\n\n"))
    if n % 3 == 1:
        body = "\r\n".join(f" * {line}" for line in body.upper().split("\n"))
    if n % 3 == 2:
        body = re.sub(r"\b(sub)?license\b", r"\1licence", body).replace("noninfringement", "non-infringement").replace('"', "''")
    return f"\n{body}\n\n"


def test_every_whole_text_is_found_whatever_its_form(spark):
    cases = [(k, restyled(x, n)) for k, x in licenses.FULL_TEXTS.items() for n in range(3)]
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan(frame(spark, [x for _, x in cases]), licenses.catalog(spark)).collect()}
    assert got == {i: k for i, (k, _) in enumerate(cases)}
    changed = [x.replace(" the ", " a ", 1) for _, x in cases]
    assert all(r["text_license"] is None for r, (_, x), y in zip(licenses.scan(frame(spark, changed), licenses.catalog(spark)).orderBy("doc_id").collect(), cases, changed) if x != y)


def test_catalogues_of_files(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do this.\nBut not that.")
    known = licenses.catalog_of_files(spark, str(tmp_path))
    got = [r["text_license"] for r in licenses.scan(frame(spark, ["YOU MAY DO THIS; but not that", "You may do that."]), known).orderBy("doc_id").collect()]
    assert got == ["Own-1.0", None]
