"""Bounded reachability, proofs over it, and checks of dependency graphs.

Frontiers advance one hop a round as joins; each round is a reliable checkpoint of
distinct states, so cycles end by themselves and lineage stays short.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIAS_KINDS = ("alias-copy", "points-to", "rebind")
USE_KINDS = ("dereference", "member-access")
# Allocation calls whose effect is known, and gaps of an extraction that break the order of its blocks.
ALLOCATION_APIS = ("new", "malloc", "calloc", "realloc")
CFG_GAPS = (
    "cfg-loop", "cfg-switch", "cfg-goto", "cfg-exception", "short-circuit-side-effect", "destructor-control-flow", "lambda-body", "coroutine", "indirect-call", "template-instantiation", "macro-expansion", "cfg-unsupported",
)
UNREACHABLE_GAP, RESTART_GAP = "clang-constant-unreachable", "lifetime-restart"


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the configured folder. In local mode, as in tests, one is made where none is; on a cluster that is an error."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strata-checkpoint-"))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by a hash of keys to as many tasks as a shuffle has: for costly work on the rows of a table that is read in few splits."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _grown(parts: list[DataFrame], more: DataFrame, most: int = 16) -> tuple[list[DataFrame], DataFrame]:
    """Checkpoints with one more, and their union. Many are written as one, so that rows are not written anew in each round."""
    whole = reduce(DataFrame.unionByName, [*parts, more])
    if len(parts) < most:
        return [*parts, more], whole
    whole = cut(whole)
    return [whole], whole


def reach(starts: DataFrame, edges: DataFrame, scope: list[str], allowed: Column | None = None, rounds: int = 64) -> DataFrame:
    """All (scope..., node) reachable from ``starts`` (scope..., node, further columns kept per start) over edges (scope..., src, dst, ...).

    ``allowed`` is a condition over a state and an edge. Ends when a round finds nothing new; raises if ``rounds`` don't suffice.
    """
    state = [c for c in starts.columns if c != "node"]
    hops = edges.withColumnRenamed("src", "node")
    seen = frontier = cut(starts.select(*state, "node").distinct())
    parts = [seen]
    for _ in range(rounds):
        step = frontier.join(hops, [*scope, "node"])
        step = (step.where(allowed) if allowed is not None else step).select(*state, F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, [*state, "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        parts, seen = _grown(parts, frontier)
    raise ValueError(f"reachability needs more than {rounds} rounds")


def reach_since(starts: DataFrame, edges: DataFrame, scope: list[str], rounds: int = 64) -> DataFrame:
    """(scope..., root, node, since): the nodes that roots reach, and the least line by which all edges of some way are made; null at the root itself.

    Starts are (scope..., root, latest), one row a root; edges (scope..., src, dst, edge_line) after ``latest`` don't count. A root's
    states are its nodes, however many lines ask for them. A round writes what it improves, so little is written twice.
    """
    key = [*scope, "root", "node"]
    hops = edges.select(*scope, F.col("src").alias("node"), "dst", "edge_line").where("edge_line is not null")
    frontier = cut(starts.select(*scope, "root", F.col("root").alias("node"), F.lit(None).cast("int").alias("since"), "latest"))
    found = frontier
    for _ in range(rounds):
        step = frontier.join(hops, [*scope, "node"]).where(F.col("edge_line") <= F.col("latest"))
        step = step.groupBy(*scope, "root", F.col("dst").alias("node")).agg(F.min(F.greatest("since", "edge_line")).cast("int").alias("since"), F.first("latest").alias("latest"))
        best = found.groupBy(*key).agg(F.min(F.coalesce("since", F.lit(-(2**31)))).alias("_best"))
        frontier = cut(step.join(best, key, "left").where(F.col("_best").isNull() | (F.col("since") < F.col("_best"))).drop("_best"))
        if frontier.isEmpty():
            least = F.min(F.coalesce("since", F.lit(-(2**31))))
            return found.groupBy(*key).agg(F.nullif(least, F.lit(-(2**31))).alias("since"))
        found = found.unionByName(frontier)
    raise ValueError(f"reachability needs more than {rounds} rounds")


def reach_back(starts: DataFrame, edges: DataFrame, scope: list[str], allowed: Column | None = None, rounds: int = 64) -> DataFrame:
    """As ``reach``, with ``parent`` and ``edge``: the node and the edge (column ``edge`` of ``edges``) by which each node is first reached, null at a start."""
    state = [c for c in starts.columns if c != "node"]
    hops = edges.withColumnRenamed("src", "node")
    kinds = dict(hops.dtypes)
    seen = frontier = cut(starts.select(*state, "node").distinct().select("*", F.lit(None).cast(kinds["node"]).alias("parent"), F.lit(None).cast(kinds["edge"]).alias("edge")))
    parts = [seen]
    for _ in range(rounds):
        step = frontier.drop("parent", "edge").join(hops, [*scope, "node"])
        step = (step.where(allowed) if allowed is not None else step).groupBy(*state, F.col("dst").alias("_dst")).agg(F.min(F.struct("node", "edge")).alias("_by"))
        step = step.select(*state, F.col("_dst").alias("node"), F.col("_by.node").alias("parent"), F.col("_by.edge").alias("edge"))
        frontier = cut(step.join(seen, [*state, "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        parts, seen = _grown(parts, frontier)
    raise ValueError(f"reachability needs more than {rounds} rounds")


def witnesses(reached: DataFrame, targets: DataFrame, rounds: int = 64) -> DataFrame:
    """(state..., node, path): the edges that lead from a start to each target that ``reach_back`` reached, walked back by its pointers."""
    state = [c for c in reached.columns if c not in ("node", "parent", "edge")]
    kind = dict(reached.dtypes)["edge"]
    back = reached.withColumnRenamed("node", "_at")
    ends = targets.select(*state, "node").distinct()
    now = cut(ends.join(reached, [*state, "node"]).select(*state, "node", F.col("parent").alias("_at"), F.when(F.col("edge").isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array("edge")).alias("path")))
    for _ in range(rounds):
        if now.where("_at is not null").isEmpty():
            return now.drop("_at")
        step = now.join(back, [*state, "_at"], "left")
        now = cut(step.select(*state, "node", F.col("parent").alias("_at"), F.when(F.col("edge").isNull(), F.col("path")).otherwise(F.concat(F.array("edge"), "path")).alias("path")))
    raise ValueError(f"a path is longer than {rounds} edges")


def alias_edges(facts: DataFrame) -> DataFrame:
    """(translation_unit, function_usr, src, dst, edge_line, fact_id) of alias facts with both anchors."""
    anchored = facts.where(F.col("kind").isin(*ALIAS_KINDS) & (F.coalesce("source_pointer_id", F.lit("")) != "") & (F.coalesce("pointer_id", F.lit("")) != ""))
    return anchored.select("translation_unit", "function_usr", F.col("source_pointer_id").alias("src"), F.col("pointer_id").alias("dst"), F.col("source_range.start").alias("edge_line"), "fact_id")


def graph_complete(facts: DataFrame) -> DataFrame:
    """(translation_unit, complete): no alias fact of the unit lacks an anchor."""
    lacks = F.col("kind").isin(*ALIAS_KINDS) & ((F.coalesce("source_pointer_id", F.lit("")) == "") | (F.coalesce("pointer_id", F.lit("")) == ""))
    return facts.groupBy("translation_unit").agg((~F.bool_or(lacks)).alias("complete"))


def candidates(facts: DataFrame) -> DataFrame:
    """Use-after-release candidates: an allocation, a release that names it, and a later use of the same pointer or of one it reaches.

    An alias edge counts only if it isn't assigned after the use; states are keyed by unit, function and root.
    """
    rng = F.col("source_range")
    alloc = facts.where("kind = 'allocation'").select("translation_unit", "function_usr", "canonical_path", F.col("fact_id").alias("allocation_fact_id"), F.col("pointer_id").alias("root"), "api", rng.alias("allocation_range"))
    release = facts.where("kind = 'release'").select("translation_unit", F.col("fact_id").alias("release_fact_id"), rng.alias("release_range"), F.explode("related_fact_ids").alias("allocation_fact_id"))
    use = facts.where(F.col("kind").isin(*USE_KINDS)).select("translation_unit", "function_usr", F.col("fact_id").alias("use_fact_id"), F.col("pointer_id").alias("target"), rng.alias("use_range"))
    scope = ["translation_unit", "function_usr"]
    freed = alloc.join(release.distinct(), ["translation_unit", "allocation_fact_id"])
    # A function may hold many objects: roots meet their uses by what they reach, never each use of the function.
    latest = use.groupBy(*scope).agg(F.max("use_range.start").alias("latest"))
    starts = freed.select(*scope, "root").distinct().join(latest, scope)
    reached = reach_since(starts, alias_edges(facts).drop("fact_id"), scope).withColumnRenamed("node", "target")
    pairs = freed.join(reached, [*scope, "root"]).join(use, [*scope, "target"])
    both = pairs.where((F.col("use_range") > F.col("release_range")) & (F.col("since").isNull() | (F.col("since") <= F.col("use_range.start"))))
    columns = ["canonical_path", "function_usr", "translation_unit", "allocation_fact_id", "release_fact_id", "use_fact_id", "release_range", "use_range", "root", "target"]
    return both.select(*columns).withColumn("candidate_id", candidate_id())


def candidate_id() -> Column:
    return F.sha2(F.concat_ws("|", "canonical_path", "function_usr", "allocation_fact_id", "release_fact_id", "use_fact_id"), 256)


def candidate_paths(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates with ``alias_path``: the ids of alias facts that bind the used pointer to the released root, none where they are the same."""
    scope = ["translation_unit", "function_usr"]
    asked = found.where("root <> target").select(*scope, "root", F.col("use_range.start").alias("use_line"), F.col("target").alias("node")).distinct()
    starts = asked.select(*scope, "root", "use_line", F.col("root").alias("node")).distinct()
    reached = reach_back(starts, alias_edges(facts).withColumnRenamed("fact_id", "edge"), scope, F.col("edge_line") <= F.col("use_line"))
    paths = witnesses(reached, asked).withColumnsRenamed({"node": "target", "path": "alias_path"})
    out = found.withColumn("use_line", F.col("use_range.start")).join(paths, [*scope, "root", "use_line", "target"], "left").drop("use_line")
    return out.withColumn("alias_path", F.when(F.col("root") == F.col("target"), F.array().cast("array<string>")).otherwise(F.col("alias_path")))


def generation_stats(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Units, allocations, candidate pairs, and releases that name no allocation of their own unit."""
    units = facts.agg(F.count_distinct("translation_unit").alias("tu_count"), F.count_if(F.col("kind") == "allocation").alias("allocation_count"))
    releases = facts.where("kind = 'release'").select("translation_unit", "fact_id", F.explode_outer("related_fact_ids").alias("_a"))
    known = facts.where("kind = 'allocation'").select("translation_unit", F.col("fact_id").alias("_a"))
    attached = releases.join(known, ["translation_unit", "_a"], "left_semi").select("translation_unit", "fact_id").distinct()
    loose = releases.select("translation_unit", "fact_id").distinct().join(attached, ["translation_unit", "fact_id"], "left_anti").agg(F.count("*").alias("unattached_release_count"))
    return units.join(found.agg(F.count("*").alias("pair_count")), F.lit(True)).join(loose, F.lit(True))


def bound(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """The questions (translation_unit, function_usr, root, pointer, line, ...) whose pointer is the root or reached from it by alias facts up to the line."""
    starts = questions.where("root <> pointer").select("translation_unit", "function_usr", "root", F.col("line").alias("use_line"), F.col("root").alias("node")).distinct()
    reached = reach(starts, alias_edges(facts).drop("fact_id"), ["translation_unit", "function_usr"], F.col("edge_line") <= F.col("use_line"))
    hits = reached.select("translation_unit", "function_usr", "root", F.col("use_line").alias("line"), F.col("node").alias("pointer"))
    return questions.where("root = pointer").unionByName(questions.where("root <> pointer").join(hits, ["translation_unit", "function_usr", "root", "line", "pointer"], "left_semi").select(*questions.columns))


def obligations(found: DataFrame, facts: DataFrame, complete: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Three-valued obligations of each candidate, in long form (candidate_id, obligation, status).

    P1: a known allocation call with a whole identity. P2: the release's and the use's pointers are bound to the object.
    P3: the release names the allocation. P4: a use comes after the release. P5: blocks lead from the release to the use,
    feasibly: both in one block of a whole, plain flow graph. P6: the use's pointer isn't rebound in (release, use] to what
    isn't bound to the object. P7: the object isn't made anew there. Absence of a binding refutes only where the unit's
    alias facts are whole. ``coverage`` has translation_unit, cfg_complete and semantic_gaps; units without a row aren't covered.
    """
    unit = ["translation_unit"]
    fact = lambda key, **columns: facts.select("translation_unit", F.col("fact_id").alias(key), *[F.expr(x).alias(c) for c, x in columns.items()])
    rows = found.join(fact("allocation_fact_id", a_kind="kind", a_api="api", a_pointer="pointer_id"), [*unit, "allocation_fact_id"], "left")
    rows = rows.join(fact("release_fact_id", r_kind="kind", r_related="related_fact_ids", r_pointer="pointer_id", r_block="cfg_block"), [*unit, "release_fact_id"], "left")
    rows = rows.join(fact("use_fact_id", u_kind="kind", u_block="cfg_block"), [*unit, "use_fact_id"], "left").join(complete, "translation_unit", "left")
    if coverage is None:
        rows = rows.withColumns({"cfg_complete": F.lit(False), "semantic_gaps": F.array().cast("array<string>")})
    else:
        rows = rows.join(coverage.select("translation_unit", "cfg_complete", "semantic_gaps"), "translation_unit", "left")
    scope = ["candidate_id", "translation_unit", "function_usr", "root"]
    asked = found.join(fact("release_fact_id", pointer="pointer_id"), [*unit, "release_fact_id"]).select(*scope, "pointer", F.col("release_range.start").alias("line"), F.lit("release").alias("what"))
    moves = facts.where(F.col("kind").isin("rebind", "lifetime-restart")).select("translation_unit", "function_usr", F.col("kind").alias("m_kind"), F.col("pointer_id").alias("m_pointer"), F.col("source_pointer_id").alias("m_source"), F.col("source_range.start").alias("m_line"))

    def inside(kind: str, pointer: str) -> DataFrame:
        """Candidates with the facts of a kind on one of their pointers between release and use."""
        own = moves.where(F.col("m_kind") == kind).withColumnRenamed("m_pointer", pointer)
        return found.join(own, ["translation_unit", "function_usr", pointer]).where((F.col("m_line") > F.col("release_range.start")) & (F.col("m_line") <= F.col("use_range.start")))

    rebinds = inside("rebind", "target").select(*scope, F.coalesce("m_source", F.lit("")).alias("pointer"), F.col("m_line").alias("line"), F.lit("rebind").alias("what"))
    answers = bound(asked.unionByName(rebinds), facts).groupBy("candidate_id").agg(F.count_if(F.col("what") == "release").alias("n_release"), F.count_if(F.col("what") == "rebind").alias("n_kept"))
    moved = rebinds.groupBy("candidate_id").agg(F.count("*").alias("n_rebinds"))
    renewed = inside("lifetime-restart", "root").select("candidate_id", F.lit(True).alias("renewed")).distinct()
    for side in (answers, moved, renewed):
        rows = rows.join(side, "candidate_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return judged(rows.withColumns({
        "named": F.expr("array_contains(r_related, allocation_fact_id)"), "later": F.col("use_range") > F.col("release_range"), "bound": n("n_release") > 0, "rebound": n("n_rebinds") > n("n_kept"),
    }))


def judged(rows: DataFrame) -> DataFrame:
    """(candidate_id, obligation, status) of candidates with what is known of each."""
    yes, no, maybe = F.lit("SATISFIED"), F.lit("REFUTED"), F.lit("UNKNOWN")
    true = lambda c: F.coalesce(c, F.lit(False))
    whole, flow, gaps = true(F.col("complete")), true(F.col("cfg_complete")), F.coalesce("semantic_gaps", F.array().cast("array<string>"))
    plain = flow & ~F.arrays_overlap(gaps, F.lit(list(CFG_GAPS)))
    known = true(F.col("a_api").isin(*ALLOCATION_APIS)) & true(F.col("a_pointer") != "") & true(F.col("function_usr") != "")
    path = F.when((plain & true(F.col("u_block") < F.col("r_block"))) | F.array_contains(gaps, UNREACHABLE_GAP), no).when(plain & true(F.col("u_block") == F.col("r_block")), yes).otherwise(maybe)
    statuses = {
        "P1": F.when(~true(F.col("a_kind") == "allocation"), no).when(known, yes).otherwise(maybe),
        "P2": F.when(true(F.col("bound")), yes).when(whole, no).otherwise(maybe),
        "P3": F.when(true(F.col("r_kind") == "release") & true(F.col("named")), yes).otherwise(no),
        "P4": F.when(true(F.col("u_kind").isin(*USE_KINDS)) & true(F.col("later")), yes).otherwise(no),
        "P5": path,
        "P6": F.when(~whole, maybe).when(true(F.col("rebound")), no).otherwise(yes),
        "P7": F.when(F.array_contains(gaps, RESTART_GAP), maybe).when(true(F.col("renewed")), no).otherwise(yes),
    }
    return rows.select("candidate_id", F.inline(F.array(*[F.struct(F.lit(p).alias("obligation"), x.alias("status")) for p, x in statuses.items()])))


def verdicts(statuses: DataFrame, ready: Column | None = None) -> DataFrame:
    """REFUTED if any obligation is, PASS if all are satisfied (and the caller is ready), else UNKNOWN."""
    ready = F.lit(True) if ready is None else ready
    return statuses.groupBy("candidate_id").agg(
        F.when(F.bool_or(F.col("status") == "REFUTED"), "REFUTED").when(F.bool_and(F.col("status") == "SATISFIED") & F.bool_and(ready), "PASS").otherwise("UNKNOWN").alias("verdict")
    )


def ancestry(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, node): all commits that a tip contains, itself included. Parents are (commit, parent), tips (tip, commit)."""
    starts = tips.select("tip", F.col("commit").alias("node"))
    return reach(starts, parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst")), [], rounds=10_000)


def dependency_problems(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, dst, problem): self edges, unknown targets, targets of a higher level, and edges on a cycle. Nodes are (id, level)."""
    ends = edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("src"), F.col("level").alias("s")), "src", "left").join(nodes.select(F.col("id").alias("dst"), F.col("level").alias("d")), "dst", "left")
    plain = F.when(F.col("src") == F.col("dst"), "self-edge").when(F.col("d").isNull(), "unknown-target").when(F.col("d") > F.col("s"), "level-inversion")
    first = ends.select("src", "dst", plain.alias("problem")).where("problem is not null")
    real = edges.where("src <> dst").select("src", "dst").distinct()
    closure = reach(real.select(F.col("src").alias("origin"), F.col("dst").alias("node")), real, [], rounds=rounds)
    cyclic = real.join(closure.select(F.col("origin").alias("dst"), F.col("node").alias("src")), ["src", "dst"], "left_semi")
    return first.unionByName(cyclic.select("src", "dst", F.lit("cycle").alias("problem")))
