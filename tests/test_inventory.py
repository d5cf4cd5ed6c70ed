"""Digests over sorted inventories."""

from __future__ import annotations

from hashlib import sha256

from strata.sources import corpus


def test_digests_are_streamed(spark):
    rows = [(f"{g}/{i * 7919 % 3000:05d}", i, f"{i:x}", g) for g in ("a", "b", None) for i in range(3000)]
    files = spark.createDataFrame(rows, "path string, size long, sha256 string, source string")
    plain = lambda part: sha256("".join(f"{p}\0{n}\0{d}\n" for p, n, d, _ in sorted(part, key=lambda r: r[0])).encode()).hexdigest()
    out = corpus.inventory_digest(files, ["source"])
    assert {r["source"]: r["digest"] for r in out.collect()} == {g: plain([r for r in rows if r[3] == g]) for g in ("a", "b", None)}
    assert corpus.inventory_digest(files).first()["digest"] == plain(rows)
    assert corpus.inventory_digest(files.limit(0)).first()["digest"] == sha256(b"").hexdigest()
    assert corpus.inventory_digest(files.limit(0), ["source"]).count() == 0
    assert "collect_list" not in out._jdf.queryExecution().toString()
