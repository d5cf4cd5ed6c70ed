"""What a Python worker holds of texts: each once, in slices, and no memory of them for the stages that follow."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pytest

from strata.llm import common, decontamination, packing, pii, tokens, toxicity

DOCS = "doc_id long, text string, lang string"


def test_a_task_leaves_no_pieces_behind():
    encoder = tokens.encoder(tokens.default_path())
    texts = [f"word{i} part{i}, and rest{i}" for i in range(50)]
    batch = pd.DataFrame({"doc_id": [str(i) for i in range(50)], "text": texts})
    made = pd.concat(packing._pieces(tokens.default_path(), 2048, 1, False)(iter([batch, batch])))
    assert not encoder.ids and not encoder.words and not encoder.runs
    assert made["doc_tokens"].tolist() == [len(encoder.encode(t)) // 4 + 1 for t in texts] * 2


@pytest.mark.parametrize("module", [toxicity, decontamination, pii])
def test_texts_go_to_the_workers_once(spark, monkeypatch, module):
    seen = []
    real = common.per_row
    monkeypatch.setattr(module, "per_row", lambda df, *rest: seen.append(df.columns) or real(df, *rest))
    docs = spark.createDataFrame([(1, "one two three four five 7", "en"), (2, None, "en")], DOCS)
    if module is toxicity:
        out = toxicity.score(docs, toxicity.fit([], []))
    elif module is pii:
        monkeypatch.setattr(pii, "fit", lambda documents: None)
        out = pii.redact(docs)
    else:
        out = decontamination.score(docs, spark.createDataFrame([(5, "two three four five")], "item_id long, text string"))
    assert seen and not any("whole_text" in columns for columns in seen)
    assert out.columns[:3] == docs.columns
    if module is not pii:
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_texts_that_are_no_strings_are_cast(spark):
    given, name = common.whole_text(spark.range(2).selectExpr("id as text", "'x' as whole_text"))
    assert name == "_whole_text" and [r[name] for r in given.orderBy("text").collect()] == ["0", "1"]


def test_slices_are_bounded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10_000)
    texts = ["x"] * 3000 + ["y" * 6000] * 7 + ["z" * 50_000] + [None, ""]
    parts = list(common.slices(pa.record_batch({"text": pa.array(texts)})))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.num_rows <= common.SLICE_ROWS and p.nbytes <= 10_000 for p in parts)
    assert any(p.num_rows == 1 for p in parts)


def test_functions_of_frames_get_slices(spark):
    rows = common.SLICE_ROWS * 2 + 10

    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"n": [len(f)], "first": [f["text"].iloc[0]]})

    docs = spark.range(rows).selectExpr("if(id = 0, null, cast(id as string)) as text").coalesce(1)
    got = common.map_slices(docs, sizes, "n long, first string").collect()
    assert sum(r["n"] for r in got) == rows and max(r["n"] for r in got) <= common.SLICE_ROWS
    assert sum(r["first"] is None for r in got) == 1
