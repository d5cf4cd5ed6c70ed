"""Flows through programs, witnesses, histories and code searches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import code_search, dataflow, graph, history, python_facts
from strata.plans import proofs, scans
from strata.plans.catalog import query
from strata.streaming import timers


@query("""
WITH d AS (SELECT doc_id AS i, 1 + doc_id % 6 AS deep, doc_id % 3 AS look, doc_id // 4 % 3 AS killed FROM documents)
SELECT 'p' || i AS project, 'lib/run.py' AS path, CAST(2 AS INTEGER) AS line, 'COMMAND' AS family, 'console input' AS origin, CAST(1 AS INTEGER) AS calls FROM d WHERE i % 4 = 0
UNION ALL SELECT 'p' || i, 'main.py', CAST(look + 2 AS INTEGER), 'EVAL', 'environment variable', 0 FROM d WHERE i % 4 = 1 AND look <= killed
UNION ALL SELECT 'p' || i, 'main.py', 6, 'EVAL', 'untrusted mapping value', 0 FROM d WHERE i % 4 = 2 AND look > 0
UNION ALL SELECT 'p' || i, 'main.py', CAST(2 * deep AS INTEGER), 'EVAL', 'console input', CAST(deep AS INTEGER) FROM d WHERE i % 4 = 3 AND deep <= 4""")
def ordered_flows(t):
    """Flows of outside data by statement order: through an import, before or after an assignment, past a branch, and down a chain of calls of some depth."""
    i, look = F.col("doc_id"), (F.col("doc_id") % 3).cast("int")
    form, deep = i % 4, (1 + i % 6).cast("int")
    project = F.concat(F.lit("p"), i.cast("string"))
    kept = F.when(look == 0, "    x = int(x)\n").when(look == 1, "    x = x.strip()\n").otherwise("    pass\n")
    # Form 1 looks at x at line look + 2; line killed + 2 makes it a constant, unless it is that line. Form 2 keeps x on one branch, but for look 0.
    looks = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.when(n == look, "eval(x)\n").when(n == F.floor(i / 4) % 3, "x = 'fixed'\n").otherwise("y = x\n")))
    chain = F.concat_ws("", F.transform(F.sequence(F.lit(1), deep), lambda n: F.concat(F.lit("def f"), n.cast("string"), F.lit("(a):\n    "), F.when(n == deep, "eval(a)\n").otherwise(F.concat(F.lit("f"), (n + 1).cast("string"), F.lit("(a)\n"))))))
    main = (
        F.when(form == 0, "from lib.run import go\ngo(input())\n").when(form == 1, F.concat(F.lit("x = os.getenv('A')\n"), looks))
        .when(form == 2, F.concat(F.lit("x = os.environ['A']\nif c:\n"), kept, F.lit("else:\n    x = 1\neval(x)\n"))).otherwise(F.concat(chain, F.lit("f1(input())\n")))
    )
    files = t("documents").select(project.alias("project"), F.lit("main.py").alias("path"), main.alias("text"))
    lib = t("documents").where("doc_id % 4 = 0").select(project.alias("project"), F.lit("lib/run.py").alias("path"), F.lit("def go(v):\n    os.system('x ' + v)\n").alias("text"))
    return dataflow.tainted_flows(files.unionByName(lib)).select("project", "path", "line", "family", "origin", "calls")


@query(f"""WITH {proofs._O}, {proofs._FOUND} SELECT candidate_id, CASE target WHEN 's' THEN 'e' || k || ',g' || k WHEN 'q' THEN 'e' || k ELSE '' END AS alias_path FROM c""")
def candidate_witnesses(t):
    """The alias facts that bind each candidate's used pointer to its released one."""
    facts = proofs._facts(t)
    return graph.candidate_paths(graph.candidates(facts), facts).select("candidate_id", F.array_join("alias_path", ",").alias("alias_path"))


@query("""
WITH RECURSIVE n AS (SELECT c_custkey // 64 AS block, CAST(c_custkey % 64 AS INTEGER) AS src, c_custkey % 11 AS line FROM customer),
e AS (SELECT block, src, (2 * src + 1) % 64 AS dst, line FROM n UNION ALL SELECT block, src, (src + 5) % 64, 9 - line % 3 FROM n UNION ALL SELECT block, src, (3 * src + 2) % 64, line + 1 FROM n WHERE src % 2 = 0),
r(block, node, hops) AS (SELECT DISTINCT block, 0, 0 FROM n UNION SELECT r.block, e.dst, r.hops + 1 FROM r JOIN e ON e.block = r.block AND e.src = r.node WHERE e.line <= 4 + r.block % 5 AND r.hops < 63)
SELECT block, node, CAST(min(hops) AS INTEGER) AS hops, true AS holds FROM r GROUP BY ALL""")
def witness_paths(t):
    """A shortest path of edge numbers from node 0 to every node that it reaches in a block of 64 customers, checked edge by edge."""
    c = t("customer").select(F.floor(F.col("c_custkey") / 64).alias("block"), (F.col("c_custkey") % 64).cast("int").alias("src"), F.col("c_custkey").alias("k"))
    line = F.col("k") % 11
    ways = [(0, (2 * F.col("src") + 1) % 64, line, c), (1, (F.col("src") + 5) % 64, 9 - line % 3, c), (2, (3 * F.col("src") + 2) % 64, line + 1, c.where("src % 2 = 0"))]
    parts = [rows.select("block", "src", dst.alias("dst"), at.alias("line"), (F.col("k") * 3 + nth).alias("edge")) for nth, dst, at, rows in ways]
    edges = parts[0].unionByName(parts[1]).unionByName(parts[2])
    starts = c.select("block", (4 + F.col("block") % 5).alias("latest"), F.lit(0).alias("node")).distinct()
    reached = graph.reach_back(starts, edges, ["block"], F.col("line") <= F.col("latest"))
    paths = graph.witnesses(reached, reached.select("block", "latest", "node"))
    steps = paths.select("block", "latest", "node", F.posexplode_outer("path").alias("pos", "edge")).join(edges, ["block", "edge"], "left")
    inside = F.sort_array(F.collect_list(F.when(F.col("edge").isNotNull(), F.struct("pos", "src", "dst", "line"))))
    ordered = steps.groupBy("block", "latest", "node").agg(inside.alias("s"))
    joined = F.forall(F.sequence(F.lit(1), F.size("s")), lambda i: (F.col("s")[i - 1]["line"] <= F.col("latest")) & (F.col("s")[i - 1]["src"] == F.when(i == 1, 0).otherwise(F.col("s")[F.greatest(i - 2, F.lit(0))]["dst"])))
    holds = F.when(F.size("s") == 0, F.col("node") == 0).otherwise(joined & (F.element_at("s", -1)["dst"] == F.col("node")))
    return ordered.select("block", "node", F.size("s").alias("hops"), holds.alias("holds"))


# Each customer is a repository with one file. c1 has seven lines; c2 changes line j; c3 puts a line on top; c4 takes line 5 of c1 to the end
# and gives line j its first text again; d3, beside c3, adds a line at the end; m5 merges c4 and d3.
_HISTORY = [("c1", None, 0, 1), ("c2", "c1", 0, 2), ("c3", "c2", 0, 3), ("c4", "c3", 0, 4), ("d3", "c2", 0, 3), ("m5", "c4", 0, 5), ("m5", "d3", 1, 5)]


@query("""
WITH r AS (SELECT c_custkey AS repo, CAST(1 + c_custkey % 4 AS INTEGER) AS j FROM customer),
l AS (SELECT repo, j, unnest([0, 1, 2, 3, 4, 6, 7, 5, 8]) AS place, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) AS line FROM r),
b AS (SELECT repo, line, CASE WHEN place = 0 THEN 'c3' WHEN place = 8 THEN 'd3' WHEN place = j OR place = 5 THEN 'c4' ELSE 'c1' END AS found FROM l)
SELECT repo, line, CASE WHEN repo % 3 = 0 AND found = 'c1' THEN NULL ELSE found END AS introduced,
 CASE WHEN repo % 3 = 0 AND found = 'c1' THEN '' WHEN found = 'c1' THEN 'main,old,side' WHEN found = 'd3' THEN 'main,side' ELSE 'main' END AS branches,
 CASE WHEN repo % 3 = 0 AND found = 'c1' THEN '' WHEN found = 'c1' THEN 'v1,v2' ELSE 'v2' END AS versions,
 CASE WHEN repo % 3 = 0 AND found = 'c1' THEN NULL WHEN found = 'c1' THEN 'c1,c2,d3,m5' WHEN found = 'd3' THEN 'd3,m5' ELSE found || ',m5' END AS known_commits FROM b""")
def line_origins(t):
    """The commits that introduced the lines of a merged file in which lines were changed, moved, restored and added, and the branches and versions that have them."""
    repos = t("customer").select(F.col("c_custkey").alias("repo"), (1 + F.col("c_custkey") % 4).cast("int").alias("j"))
    first = lambda p: F.concat(F.lit(f"line {p} of "), F.col("repo").cast("string"))
    plain, changed = {p: first(p) for p in range(1, 8)}, {p: F.when(F.col("j") == p, F.concat(F.lit("changed "), first(p))).otherwise(first(p)) for p in range(1, 8)}
    top, end = F.lit("on top"), F.lit("at the end")
    texts = {
        "c1": plain.values(), "c2": changed.values(), "c3": [top, *changed.values()], "c4": [top, *[plain[p] for p in (1, 2, 3, 4, 6, 7, 5)]], "d3": [*changed.values(), end], "m5": [top, *[plain[p] for p in (1, 2, 3, 4, 6, 7, 5)], end],
    }
    versions = repos.select("repo", F.lit("a.txt").alias("path"), F.explode(F.create_map(*[x for c, ls in texts.items() for x in (F.lit(c), F.concat_ws("\n", *ls))])).alias("commit", "text"))
    rows = lambda names, data: repos.select("repo", F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in data])))
    commits = rows(("commit", "parent", "nth"), [h[:3] for h in _HISTORY])
    times = rows(("commit", "time"), sorted({(c, x) for c, _, _, x in _HISTORY}))
    refs = rows(("kind", "name", "tip"), [("branch", "main", "m5"), ("branch", "side", "d3"), ("branch", "old", "c2"), ("tag", "v1", "c2"), ("tag", "v2", "m5"), ("tag", "nightly", "m5")])
    asked = repos.select("repo", F.lit("a.txt").alias("path"), F.lit("m5").alias("commit"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("line"), F.when(F.col("repo") % 3 == 0, 2).alias("since"))
    found = history.impact(asked, commits, versions, refs, times)
    return found.select("repo", "line", "introduced", F.array_join("branches", ",").alias("branches"), F.array_join("versions", ",").alias("versions"), F.array_join("known_commits", ",").alias("known_commits"))


def _index(t) -> tuple:
    files = t("documents").where("text <> ''").select(F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    folder = proofs._folder(files, "index")
    code_search.write_index(files, folder)
    return files.sparkSession, folder


@query(f"WITH {scans._LINES} SELECT path, line, substr(content, 1, 300) AS text FROM lines WHERE regexp_matches(content, '(licen[cs]ed? under (the )?(MIT|apache)|copyright +\\(c\\) [0-9]{{4}})', 'i') ORDER BY path, line LIMIT 100")
def regex_search(t):
    """The first hundred lines that match an expression, by an index of trigrams."""
    spark, folder = _index(t)
    return code_search.search(spark, folder, r"(licen[cs]ed? under (the )?(MIT|apache)|copyright +\(c\) [0-9]{4})", regex=True, limit=100).withColumn("line", F.col("line").cast("long"))


@query(f"WITH {scans._LINES} SELECT path, line, substr(content, 1, 300) AS text FROM lines WHERE contains(lower(content), 'licensed under the') ORDER BY path, line LIMIT 30")
def indexed_literal(t):
    spark, folder = _index(t)
    return code_search.search(spark, folder, "Licensed under THE").withColumn("line", F.col("line").cast("long"))


_MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


@query("""
WITH RECURSIVE m AS (SELECT 'q' || user_id % 7 AS queue, 'm' || event_id AS message_id, CAST(1 + event_id % 3 AS INTEGER) AS attempt, epoch_us(ts) // 1000 + 60000 * (event_id % 5) AS due_at FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY due_at, message_id) - 1 AS place FROM m), c AS (SELECT *, CAST(ceil(due_at / 600000) AS BIGINT) AS first FROM n),
s(queue, place, sweep) AS (SELECT queue, place, first FROM c WHERE place < 10 UNION ALL SELECT c.queue, c.place, greatest(c.first, s.sweep + 1) FROM s JOIN c ON c.queue = s.queue AND c.place = s.place + 10)
SELECT message_id, c.queue, attempt, s.sweep * 600000 AS sweep_at FROM s JOIN c ON c.queue = s.queue AND c.place = s.place""")
def deferred_sweeps(t):
    """The sweep, one every ten minutes with ten messages a queue at most, that emits each deferred message."""
    e, i = t("events"), F.col("event_id")
    due = (F.expr(_MILLIS) + 60_000 * (i % 5)).alias("due_at")
    messages = e.select(F.concat(F.lit("q"), (F.col("user_id") % 7).cast("string")).alias("queue"), F.concat(F.lit("m"), i.cast("string")).alias("message_id"), (1 + i % 3).cast("int").alias("attempt"), due)
    return timers.swept(messages, 600_000).select("message_id", "queue", "attempt", "sweep_at")


@query("""
WITH l AS (SELECT 'u' || user_id AS message_id, 'w' || event_id % 4 AS owner, event_type = 'purchase' AS ack, epoch_us(ts) // 1000 AS t0 FROM events),
d AS (SELECT message_id, t0, max(owner) AS owner, bool_or(ack) AS ack FROM l GROUP BY message_id, t0), f AS (SELECT message_id, min(t0) FILTER (WHERE ack) AS done FROM d GROUP BY message_id), e AS (SELECT max(t0) AS t1 FROM l),
k AS (SELECT d.*, least(coalesce((SELECT min(x.t0) FROM d x WHERE x.message_id = d.message_id AND x.t0 > d.t0) - 1, e.t1), e.t1) AS until FROM d JOIN f USING (message_id), e WHERE NOT ack AND (done IS NULL OR d.t0 < done))
SELECT message_id, owner, t0 + n * 7200000 AS reclaimed_at FROM k, unnest(generate_series(1, (until - t0) // 7200000)) u(n)""")
def lapsed_leases(t):
    """Each time that two hours pass without an event of a user, up to the last event of all; a purchase acknowledges."""
    i = F.col("event_id")
    log = t("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("message_id"), F.concat(F.lit("w"), (i % 4).cast("string")).alias("owner"), (F.col("event_type") == "purchase").alias("ack"), F.expr(_MILLIS).alias("at"))
    log = log.groupBy("message_id", "at").agg(F.max("owner").alias("owner"), F.bool_or("ack").alias("ack")).withColumn("kind", F.when(F.col("ack"), "ack").otherwise("heartbeat"))
    now = log.agg(F.max("at")).first()[0]
    return timers.reclaims(log, 7_200_000, now)


@query("""
WITH d AS (SELECT 'm' || doc_id || '.py' AS path, doc_id % 4 AS form, CAST(doc_id % 3 AS INTEGER) AS gap FROM documents), r AS (
SELECT path, 2 + gap AS line, 'entrypoint' AS kind, 'view' AS name FROM d WHERE form = 0 UNION ALL SELECT path, 3 + gap, 'sink', 'eval' FROM d WHERE form = 0 UNION ALL SELECT path, 2 + gap, 'source', 'input' FROM d WHERE form = 1 UNION ALL
SELECT path, 2 + gap, 'sink', 'os.system' FROM d WHERE form = 2)
SELECT * FROM r UNION ALL SELECT DISTINCT path, NULL, 'boundary', '' FROM r WHERE kind IN ('entrypoint', 'source')""")
def attack_surface(t):
    """Entry points, sources, sinks and the files through which outside data comes in; plain calls of known names are none."""
    form, gap = F.col("doc_id") % 4, F.repeat(F.lit("\n"), (F.col("doc_id") % 3).cast("int"))
    body = F.when(form == 0, "@app.get('/x')\ndef view(q):\n    eval(q)\n").when(form == 1, "x = input()\n").when(form == 2, "os.system('ls')\n").otherwise("y = 1\n")
    head = F.when(form == 0, "").otherwise("import os\n")
    files = t("documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(head, gap, body).alias("text"))
    surface = graph.cut(python_facts.attack_surface(python_facts.facts(files)).where("kind <> 'unresolved'"))
    edges = python_facts.trust_boundaries(surface).select("path", F.lit(None).cast("int").alias("line"), F.lit("boundary").alias("kind"), F.lit("").alias("name"))
    return surface.select("path", "line", "kind", "name").unionByName(edges)
