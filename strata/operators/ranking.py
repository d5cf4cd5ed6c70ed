"""Top-k, diversity caps, budgets, windows and eviction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions import text as T
from strata.operators.graph import cut
from strata.operators.lookups import clipped


def clamp_limit(limit: int, most: int) -> int:
    return max(1, min(most, limit))


def latest(df: DataFrame, order: str, tie: str, limit: int, most: int = 200) -> DataFrame:
    """The newest rows, at least one and at most ``most``; a top-k, so no full sort."""
    return df.orderBy(F.desc(order), F.asc(tie)).limit(clamp_limit(limit, most))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark keeps only k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def diverse_top(df: DataFrame, group: list[str], diversity: list[str], order: list[Column], per_diversity: int = 2, per_group: int = 6) -> DataFrame:
    """At most ``per_diversity`` rows of each (group, diversity), then the first ``per_group`` of each group."""
    capped = top_per_group(df, [*group, *diversity], order, per_diversity, "_within")
    return top_per_group(capped.drop("_within"), group, order, per_group)


def running_total(df: DataFrame, order: list[Column], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """``out`` = the sum of ``value`` over all rows before a row in a total order, without one task that sees them all.

    Rows are range-partitioned by the order; each partition starts from the sums of the partitions before it.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_value", value).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A checkpoint, as range bounds come from a sample: a second run of the same plan may cut elsewhere.
    ranged = cut(ranged.withColumn("_in", F.sum("_value").over(inside) - F.col("_value")))
    sums = ranged.groupBy("_part").agg(F.sum("_value").alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before_part"))  # a row a partition
    return ranged.join(F.broadcast(before), "_part").withColumn(out, F.col("_before_part") + F.col("_in")).drop("_part", "_in", "_before_part", "_value")


def global_rank(df: DataFrame, order: list[Column], parts: int | None = None, rank: str = "rank") -> DataFrame:
    """Ranks 1..N of all rows in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), rank, parts).withColumn(rank, F.col(rank) + 1)


def budget_skip(df: DataFrame, group: list[str], order: list[str], size: str, budget: int, most: int | None = None) -> DataFrame:
    """Rows kept while they fit a budget: a row that doesn't fit is passed over, later smaller ones may still fit.

    This isn't a running sum. Rows of a group are folded in order in batches inside the group's task, with only the
    running total as state, so a group of any size needs little memory. A row without a size takes no room; rows whose
    group is null or not a number are one group.
    """
    columns = df.columns

    def run(batches):
        key, used, kept = None, 0, 0
        for batch in batches:
            take = []
            for values in zip(*[batch[g] for g in group], batch[size]):
                here = tuple(None if pd.isna(v) else v for v in values[:-1])
                need = 0 if pd.isna(values[-1]) else int(values[-1])
                if here != key:
                    key, used, kept = here, 0, 0
                good = used + need <= budget and (most is None or kept < most)
                take.append(good)
                if good:
                    used, kept = used + need, kept + 1
            yield batch[pd.Series(take, index=batch.index, dtype=bool)]

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *group).sortWithinPartitions(*group, *order).select(*columns).mapInPandas(run, df.schema)


def budget_latest(df: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """From the newest row back, the rows that fit a budget; one that doesn't fit is passed over."""
    return budget_skip(df.withColumns({f"_neg_{i}": -F.col(c) for i, c in enumerate(order)}), group, [f"_neg_{i}" for i in range(len(order))], size, budget).drop(*[f"_neg_{i}" for i in range(len(order))])


def budget_stop(df: DataFrame, group: list[str], order: list[Column | str], size: str, budget: int) -> DataFrame:
    """Rows up to the first that would exceed the budget: a running sum decides."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def budget_shorten(df: DataFrame, group: list[str], order: list[Column | str], text: str, budget: int) -> DataFrame:
    """Rows up to a budget of UTF-8 bytes; the first that would exceed it is cut to what is left, at a character's end, and is the last. One with nothing left is dropped."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_left", F.lit(budget) - F.sum(size).over(w) + size).where(F.col("_left") >= 0)
    cut_text = F.when(size <= F.col("_left"), F.col(text)).otherwise(clipped(F.col(text), F.col("_left")))
    return rows.withColumns({"shortened": size > F.col("_left"), text: cut_text}).where(~F.col("shortened") | (F.col(text) != "")).drop("_left")


def position_bonus(df: DataFrame, group: list[str], order: list[Column], weight: float = 0.05) -> DataFrame:
    """``bonus`` = weight / place in the group's order."""
    return df.withColumn("bonus", F.lit(weight) / F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def recall(memories: DataFrame, queries: DataFrame, limit: int = 6, candidates: int = 200) -> DataFrame:
    """Best memories for each query by terms shared, importance and recency.

    Memories have id, scope, content, keywords, importance, created_at; queries query_id and text. Score: 0.55 of the query's
    terms found, 0.15 of the memory's, 0.25 importance, and a bonus for an early place by importance. Memories that share no
    term only stay if their scope is semantic or the query is empty. Only the first ``candidates`` memories are considered.
    """
    order = [F.desc("importance"), F.desc("created_at"), F.asc("id")]
    none = F.array().cast("array<string>")
    first = memories.orderBy(*order).limit(candidates).withColumn("bonus", F.lit(0.05) / F.row_number().over(Window.orderBy(*order)))
    pool = cut(
        first.repartition("id").withColumn("terms", F.array_union(F.coalesce("keywords", none), T.term_set(F.col("content"))))
        .select("id", "scope", "created_at", "terms", "bonus", F.coalesce("importance", F.lit(0.5)).alias("importance"), F.size("terms").alias("n_terms"))
    )
    asked = cut(queries.select("query_id", T.term_set(F.col("text")).alias("q_terms")).withColumn("n_asked", F.size("q_terms")))
    # Terms meet by equality; each of a query's terms is in at most ``candidates`` memories.
    met = asked.select("query_id", F.explode("q_terms").alias("term")).join(pool.select("id", F.explode("terms").alias("term")), "term").groupBy("query_id", "id").agg(F.count("*").alias("shared"))
    about = F.broadcast(pool.drop("terms"))  # bounded by ``candidates``
    found = met.join(asked.drop("q_terms"), "query_id").join(about, "id")
    apart = asked.drop("q_terms").join(about, (F.col("n_asked") == 0) | (F.col("scope") == "semantic")).join(met.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("shared", F.lit(0).cast("long"))
    pairs = found.unionByName(apart)
    score = 0.55 * F.col("shared") / F.greatest("n_asked", F.lit(1)) + 0.15 * F.col("shared") / F.greatest("n_terms", F.lit(1)) + 0.25 * F.col("importance") + F.col("bonus")
    return top_per_group(pairs.withColumn("score", score), ["query_id"], [F.desc("score"), F.asc("created_at"), F.asc("id")], limit).select("query_id", "id", "score", "rank")


def line_windows(df: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, first_line, body): whole lines packed into windows of at most ``budget`` bytes; a longer line stands alone.

    A fold over each text's lines: the state is the open window's size and the starts of windows so far.
    """
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    sized = df.select(key, pieces.alias("lines")).withColumn("sizes", F.transform("lines", lambda x: F.octet_length(x) + 1))
    state = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("int").alias("used"), F.lit(1).cast("int").alias("at"))

    def step(a: Column, size: Column) -> Column:
        opens = (F.size(a["starts"]) == 0) | (a["used"] + size > budget)
        return F.struct(F.when(opens, F.concat(a["starts"], F.array(a["at"]))).otherwise(a["starts"]).alias("starts"), F.when(opens, size).otherwise(a["used"] + size).alias("used"), (a["at"] + 1).alias("at"))

    starts = sized.withColumn("starts", F.aggregate("sizes", state, step)["starts"])
    cut = starts.select(key, "lines", F.posexplode("starts").alias("i", "first_line"), "starts")
    end = F.coalesce(F.get("starts", F.col("i") + 1) - 1, F.size("lines"))
    return cut.select(key, F.col("first_line").cast("long").alias("first_line"), F.array_join(F.slice("lines", F.col("first_line"), end - F.col("first_line") + 1), "\n").alias("body"))


def last_steps(steps: Column, most: int = 12) -> Column:
    return F.slice(steps, F.greatest(F.size(steps) - (most - 1), F.lit(1)), most)


def excerpt(lines: Column, weights: Column, around: int = 28) -> Column:
    """Lines around the heaviest one; of equals the latest."""
    best = F.array_position(F.reverse(weights), F.array_max(weights))
    centre = F.size(weights) - best + 1
    first = F.greatest(centre - around, F.lit(1)).cast("int")
    return F.slice(lines, first, (F.least(centre + around, F.size(lines)) - first + 1).cast("int"))


def evict(entries: DataFrame, now: Column, ttl_seconds: int, quota: int, free: int | None = None, floor: int = 0) -> DataFrame:
    """Cache entries (key, size, created_at, last_access, pinned as numbers) to drop, with the reason.

    Entries past their time to live go unless pinned; then, by last access, unpinned ones while the rest exceeds the quota
    or free space is under the floor.
    """
    expired = (now - F.col("created_at") > ttl_seconds) & ~F.col("pinned")
    gone = entries.where(expired).select("key", F.lit("ttl").alias("reason"))
    left = entries.where(~expired)
    total = left.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))
    freed_by_ttl = entries.where(expired).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_ttl"))
    rows = running_total(left.where("not pinned"), [F.asc("last_access"), F.asc("key")], F.col("size"), "_before").join(F.broadcast(total), F.lit(True)).join(F.broadcast(freed_by_ttl), F.lit(True))
    over = F.col("_total") - F.col("_before") > quota
    if free is not None:
        over = over | (free + F.col("_ttl") + F.col("_before") < floor)
    return gone.unionByName(rows.where(over).select("key", F.lit("lru").alias("reason")))


def capped_with_gap(df: DataFrame, order: list[Column], most: int, gap: Callable[[Column], Column]) -> DataFrame:
    """The first ``most`` rows, and if there were more one row made by ``gap`` from the number dropped."""
    first = df.orderBy(*order).limit(most)
    dropped = df.agg((F.count("*") - most).alias("_n")).where("_n > 0").select(gap(F.col("_n")).alias("_row")).select("_row.*")
    return first.unionByName(dropped)


def keep_first(df: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, identity, order, 1, "_n").drop("_n")


def by_signal(items: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first k of each group: those outside tests first, then by falling score, path, line and name."""
    return top_per_group(items, group, [F.asc("is_test"), F.desc("score"), F.asc("path"), F.asc("line"), F.asc("name")], k)
