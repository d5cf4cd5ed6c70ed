"""Obligations of all use-after-release candidates of a table of facts, in one pass over each function's facts.

``graph.candidates`` and ``graph.obligations`` answer the same for any candidates, by joins; here a fact is shuffled once, to
its function, and releases once more, to the allocations they name.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.operators import graph

#: Facts of one function that a task holds: its edges, moves and uses. Larger functions are answered by joins.
HELD = 500_000
_BUCKETS = 1 << 16
_ROWS_A_TASK = 1_000_000
_BATCH = 4_096
_UNITS, _UNIT_BYTES = 100_000, 16 << 20
_EDGE, _REBIND, _RESTART, _USE, _FREED = range(5)
_SCOPE = ["translation_unit", "function_usr"]
_ROWS = [*_SCOPE, "what", "pointer", "source", "start", "end", "block", "id", "path", "api", "release_id"]
_PAIRS = (
    "translation_unit string, function_usr string, canonical_path string, allocation_fact_id string, release_fact_id string, use_fact_id string, a_api string, a_pointer string, r_block int, u_block int, "
    "bound boolean, rebound boolean, renewed boolean"
)


def _since(root: str, edges: dict[str, list[tuple[str, int]]], latest: int) -> dict[str, float]:
    """The nodes that a root reaches by edges up to a line, each with the least line by which all edges of some way are made."""
    best, heap = {root: float("-inf")}, [(float("-inf"), root)]
    while heap:
        at, node = heapq.heappop(heap)
        if at == best[node]:
            for dst, line in edges.get(node, ()):
                then = max(at, line)
                if line <= latest and then < best.get(dst, float("inf")):
                    best[dst] = then
                    heapq.heappush(heap, (then, dst))
    return best


def _place(start: int | None, end: int | None) -> tuple:
    """A range as Spark compares it: nulls come first."""
    return start is not None, start or 0, end is not None, end or 0


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of ``_PAIRS`` from rows of ``_ROWS``, sorted by function, what they are, and pointer. Held is one function without its released objects."""
    held = root = since = None
    for batch in batches:
        for unit, function, what, pointer, source, start, end, block, id_, path, api, release in zip(*[c.to_pandas(integer_object_nulls=True).tolist() for c in batch.columns]):
            if held != (unit, function):
                held, root, since, latest = (unit, function), None, None, None
                edges, rebinds, restarts, uses = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
            if what in (_EDGE, _REBIND) and source and pointer:
                edges[source].append((pointer, start))
            if what == _REBIND:
                rebinds[pointer].append((start, source or ""))
            elif what == _RESTART:
                restarts[pointer].append(start)
            elif what == _USE:
                uses[pointer].append((_place(start, end), start, id_, block))
                latest = start if latest is None or start is not None and start > latest else latest
            if what != _FREED or not uses:
                continue
            if since is None or pointer != root:
                root, since = pointer, _since(pointer, edges if latest is not None else {}, latest)
            freed = _place(start, end)
            tied = lambda name, line: name == root or name in since and line is not None and since[name] <= line
            for target, made in since.items():
                for at, line, use, u_block in uses.get(target, ()):
                    if at > freed and (target == root or line is not None and made <= line):
                        window = start is not None and line is not None
                        rebound = window and any(start < n <= line and not tied(s, n) for n, s in rebinds.get(target, ()))
                        renewed = window and any(start < n <= line for n in restarts.get(root, ()))
                        yield unit, function, path, id_, release, use, api, root, block, u_block, tied(source, start), rebound, renewed


def _proofs(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), schema.types)], schema=schema)

        for row in _pairs(batches):
            made.append(row)
            if len(made) == _BATCH:
                yield batch()
                made.clear()
        if made:
            yield batch()

    return run


def _parts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, moves and uses; released objects) as ``_ROWS``."""
    start, end, none = F.col("source_range.start"), F.col("source_range.end"), F.lit(None).cast("string")
    kind = F.col("kind")
    moves = kind.isin(*graph.ALIAS_KINDS, "lifetime-restart") & start.isNotNull()
    anchored = kind.isin("rebind", "lifetime-restart") | ((F.coalesce("source_pointer_id", F.lit("")) != "") & (F.col("pointer_id") != ""))
    used = kind.isin(*graph.USE_KINDS)
    what = F.when(used, _USE).when(kind == "rebind", _REBIND).when(kind == "lifetime-restart", _RESTART).otherwise(_EDGE).cast("byte")
    kept = facts.where("translation_unit is not null and function_usr is not null and pointer_id is not null").where((moves & anchored) | (used & F.col("source_range").isNotNull()))
    held = kept.select(
        *_SCOPE, what.alias("what"), F.col("pointer_id").alias("pointer"), F.when(used, none).otherwise(F.col("source_pointer_id")).alias("source"), start.alias("start"), F.when(used, end).alias("end"), F.when(used, F.col("cfg_block")).cast("int").alias("block"),
        F.when(used, F.col("fact_id")).alias("id"), none.alias("path"), none.alias("api"), none.alias("release_id"),
    )
    alloc = facts.where("kind = 'allocation' and function_usr is not null and pointer_id is not null").select(*_SCOPE, F.col("fact_id").alias("id"), F.col("pointer_id").alias("pointer"), F.col("canonical_path").alias("path"), "api")
    release = facts.where("kind = 'release' and source_range is not null").select(
        "translation_unit", F.explode(F.array_distinct("related_fact_ids")).alias("id"), F.col("fact_id").alias("release_id"), F.col("pointer_id").alias("source"), start.alias("start"), end.alias("end"), F.col("cfg_block").cast("int").alias("block"),
    )
    return held, alloc.join(release, ["translation_unit", "id"]).select(*[F.lit(_FREED).cast("byte").alias(c) if c == "what" else c for c in _ROWS])


def _large(facts: DataFrame, large) -> DataFrame:
    """All facts of large functions, and the releases that name their allocations."""
    named = facts.where(large & (F.col("kind") == "allocation")).select("translation_unit", F.col("fact_id").alias("_a"))
    ids = facts.where("kind = 'release'").select("translation_unit", "fact_id", F.explode("related_fact_ids").alias("_a")).join(named, ["translation_unit", "_a"], "left_semi").select("translation_unit", "fact_id").distinct()
    return graph.cut(facts.where(large & (F.col("kind") != "release")).unionByName(facts.where("kind = 'release'").join(ids, ["translation_unit", "fact_id"], "left_semi").select(*facts.columns)))


def _known_units(complete: DataFrame, coverage: DataFrame | None) -> DataFrame:
    """(translation_unit, complete, cfg_complete, semantic_gaps), to be broadcast where it is small."""
    none = F.array().cast("array<string>")
    if coverage is None:
        return complete.withColumns({"cfg_complete": F.lit(False), "semantic_gaps": none})
    units = graph.cut(complete.join(coverage.select("translation_unit", "cfg_complete", "semantic_gaps"), "translation_unit", "full"))
    size = F.octet_length("translation_unit") + F.octet_length(F.array_join(F.coalesce("semantic_gaps", none), " ")) + 64
    got = units.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(units) if got["n"] <= _UNITS and (got["bytes"] or 0) <= _UNIT_BYTES else units


def proved(facts: DataFrame, complete: DataFrame, coverage: DataFrame | None = None, most: int = HELD) -> DataFrame:
    """``graph.obligations`` of ``graph.candidates``: (candidate_id, obligation, status). A fact's id is its own within its unit.

    Functions meet in buckets of their hash, of which the facts are counted first; a bucket with over ``most`` of them goes to the joins.
    """
    bucket = F.pmod(F.xxhash64(*_SCOPE), F.lit(_BUCKETS))
    held, freed = _parts(facts)
    counts = held.groupBy(bucket.alias("b")).count()
    got = counts.agg(F.collect_list(F.when(F.col("count") > most, F.col("b"))).alias("large"), F.sum("count").alias("n")).first()
    large = bucket.isin(got["large"]) if got["large"] else None
    rows = held.unionByName(freed)
    rows = rows if large is None else rows.where(~large)
    tasks = max(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (got["n"] or 0) // _ROWS_A_TASK)
    schema = StructType.fromDDL(_PAIRS)
    pairs = rows.repartition(tasks, *_SCOPE).sortWithinPartitions(*_SCOPE, "what", "pointer").mapInArrow(_proofs(to_arrow_schema(schema)), schema)
    found = pairs.withColumn("candidate_id", graph.candidate_id()).join(_known_units(complete, coverage), "translation_unit", "left")
    known = {"a_kind": F.lit("allocation"), "r_kind": F.lit("release"), "u_kind": F.lit(graph.USE_KINDS[0]), "named": F.lit(True), "later": F.lit(True)}
    out = graph.judged(found.withColumns(known))
    if large is None:
        return out
    rest = _large(facts, large)
    return out.unionByName(graph.obligations(graph.candidates(rest), rest, complete, coverage))
