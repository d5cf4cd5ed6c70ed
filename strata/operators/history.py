"""Histories of files: the commit that introduced each line, and the branches and versions that contain it.

Neighbouring versions are aligned by a longest common subsequence of lines, so a line of a
version points to the same line of a parent's version, or to nothing where its commit
introduced it. Pointers are then doubled: each round a line points as far again, so a
history of any depth takes a number of rounds that grows with its logarithm, over all lines
at once. A merge's line points to the first parent that has it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import graph


def aligned(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """(place in new, place in old) of a longest common subsequence.

    Equal ends are matched first. Between them, the pairs of equal lines are taken by rising place in ``new`` and falling
    place in ``old``, and the best chain of each length ends as early in ``old`` as it can.
    """
    first, last = 0, 0
    while first < min(len(old), len(new)) and old[first] == new[first]:
        first += 1
    while last < min(len(old), len(new)) - first and old[-1 - last] == new[-1 - last]:
        last += 1
    places = defaultdict(list)
    for j in range(len(old) - last - 1, first - 1, -1):
        places[old[j]].append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(first, len(new) - last):
        for j in places.get(new[i], ()):
            k = bisect_left(ends, j)
            link = (i, j, chains[k - 1] if k else None)
            ends[k : k + 1], chains[k : k + 1] = [j], [link]
    middle, link = [], chains[-1] if chains else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [(i, i) for i in range(first)] + middle[::-1] + [(len(new) - k, len(old) - k) for k in range(last, 0, -1)]


def _large(side: DataFrame) -> DataFrame:
    """A side that is sorted and merged, never broadcast: rows exploded from few are far more than Spark takes them for."""
    return side.hint("merge")


def parent_lines(commits: DataFrame, versions: DataFrame) -> DataFrame:
    """(repo, path, commit, line, parent, parent_line) of each line that a parent's version has, the first such parent's.

    Commits are (repo, commit, parent, nth), a row for each parent; versions are (repo, path, commit, text), each file of each commit.
    """
    new = versions.select("repo", "path", "commit", F.col("text").alias("new"))
    old = versions.select("repo", "path", F.col("commit").alias("parent"), F.col("text").alias("old"))
    pairs = commits.where("parent is not null").join(_large(new), ["repo", "commit"]).join(_large(old), ["repo", "path", "parent"])
    pairs = pairs.select("repo", "path", "commit", "parent", "nth", T.lines(F.col("old")).alias("old"), T.lines(F.col("new")).alias("new"))
    kinds = dict(pairs.dtypes)
    schema = f"repo {kinds['repo']}, path string, commit {kinds['commit']}, parent {kinds['parent']}, nth int, line int, parent_line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*key, i + 1, j + 1) for *key, old, new in b.itertuples(index=False) for i, j in aligned(list(old), list(new))]
            yield pd.DataFrame(rows, columns=["repo", "path", "commit", "parent", "nth", "line", "parent_line"])

    found = pairs.withColumn("nth", F.col("nth").cast("int")).mapInPandas(run, schema)
    return found.groupBy("repo", "path", "commit", "line").agg(F.min(F.struct("nth", "parent", "parent_line")).alias("x")).select("repo", "path", "commit", "line", "x.parent", "x.parent_line")


def introduced(commits: DataFrame, versions: DataFrame, rounds: int = 40) -> DataFrame:
    """(repo, path, commit, line, introduced, at_line): where each line of each version comes from. Renamed files begin anew."""
    key = ["repo", "path", "commit", "line"]
    lines = versions.select("repo", "path", "commit", F.posexplode(T.lines(F.col("text"))).alias("pos", "_"))
    lines = lines.select("repo", "path", "commit", (F.col("pos") + 1).alias("line"))
    now = graph.cut(lines.join(_large(parent_lines(commits, versions)), key, "left").select(*key, F.col("parent").alias("to"), F.col("parent_line").alias("to_line")))
    for _ in range(rounds):
        moving = now.where("to is not null")
        onward = moving.select("repo", "path", F.col("commit").alias("to"), F.col("line").alias("to_line"), F.col("to").alias("next"), F.col("to_line").alias("next_line"))
        now = graph.cut(now.join(_large(onward), ["repo", "path", "to", "to_line"], "left").select(*key, F.coalesce("next", "to").alias("to"), F.coalesce("next_line", "to_line").alias("to_line"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select(*key, F.coalesce("to", "commit").alias("introduced"), F.coalesce("to_line", "line").alias("at_line"))
        now = now.drop("moved")
    raise ValueError(f"histories are deeper than {rounds} doublings")


def matches_glob(name: str, glob: str):
    """Does a name match a shell pattern, case kept."""
    return F.col(name).rlike(T.glob_pattern(glob))


def containing(commits: DataFrame, refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo, commit, kind, name, tip): refs (repo, kind, name, tip) whose history has a wanted (repo, commit)."""
    starts = refs.select("repo", "tip", F.col("tip").alias("node")).distinct()
    reached = graph.reach(starts, _large(commits.where("parent is not null").select("repo", F.col("commit").alias("src"), F.col("parent").alias("dst"))), ["repo"], rounds=10_000)
    return reached.withColumnRenamed("node", "commit").join(_large(wanted.select("repo", "commit").distinct()), ["repo", "commit"], "left_semi").join(_large(refs), ["repo", "tip"]).select("repo", "commit", "kind", "name", "tip")


def impact(asked: DataFrame, commits: DataFrame, versions: DataFrame, refs: DataFrame, times: DataFrame, glob: str = "v*") -> DataFrame:
    """Each asked line (repo, path, commit, line, since) with its introducing commit, and the branches, versions and commits that are known to have it.

    Nothing is known of a line that isn't there, or was introduced before ``since``. Times are (repo, commit, time).
    """
    came = asked.join(_large(introduced(commits, versions)), ["repo", "path", "commit", "line"], "left").join(_large(times.select("repo", F.col("commit").alias("introduced"), "time")), ["repo", "introduced"], "left")
    came = graph.cut(came.withColumn("introduced", F.when(F.col("since").isNull() | (F.col("time") >= F.col("since")), F.col("introduced"))).drop("time"))
    in_refs = containing(commits, refs, came.select("repo", F.col("introduced").alias("commit"))).where((F.col("kind") == "branch") | matches_glob("name", glob))
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    has = in_refs.groupBy("repo", F.col("commit").alias("introduced")).agg(names("branch").alias("branches"), names("tag").alias("versions"), F.collect_set(F.when(F.col("kind") == "branch", F.col("tip"))).alias("tips"))
    out = came.join(_large(has), ["repo", "introduced"], "left")
    none = F.array().cast("array<string>")
    known = F.when(F.col("introduced").isNotNull(), F.array_sort(F.array_union(F.array("introduced"), F.coalesce("tips", F.array().cast(out.select("tips").schema[0].dataType))))).alias("known_commits")
    return out.select("repo", "path", "commit", "line", "introduced", F.coalesce("branches", none).alias("branches"), F.coalesce("versions", none).alias("versions"), known)
