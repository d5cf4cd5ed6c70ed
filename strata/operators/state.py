"""Task, memory and release state kept by idempotent folds over logs of writes.

A store is a log of rows with a sequence column; each function gives the table that
the writes would have left behind. Re-running a fold over the same log changes
nothing, so a repeated batch is harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_last(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last write of each key. Aggregates combine map-side, so a hot key is no hot task."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")


def upsert_max(log: DataFrame, keys: list[str], largest: str, newest: str, seq: str = "seq") -> DataFrame:
    """``largest`` is the greatest ever written, ``newest`` the last one; everything else stays as first written."""
    rest = [c for c in log.columns if c not in (*keys, largest, newest)]
    out = log.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_first"), F.max(largest).alias(largest), F.max_by(newest, seq).alias(newest))
    return out.select(*keys, "_first.*", largest, newest)


def upsert_coalesce(log: DataFrame, keys: list[str], kept: str, seq: str = "seq") -> DataFrame:
    """The last write of each key, but ``kept`` is its last value that isn't null."""
    rest = [c for c in log.columns if c not in (*keys, kept)]
    out = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row"), F.max_by(kept, F.when(F.col(kept).isNotNull(), F.col(seq))).alias(kept))
    return out.select(*keys, "_row.*", kept)


def insert_or_ignore(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first write of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*")


def versions(log: DataFrame, group: list[str], activations: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """Rows numbered 1.. within a group by arrival; ``active`` marks the one version activated last.

    Without an activation log a row with ``activate`` true activates itself.
    """
    out = log.withColumn("version", F.row_number().over(Window.partitionBy(*group).orderBy(seq)))
    chosen = activations if activations is not None else out.where("activate").select(*group, "version", seq)
    last = chosen.groupBy(*group).agg(F.max_by("version", seq).alias("_active"))
    return out.join(last, group, "left").withColumn("active", F.coalesce(F.col("version") == F.col("_active"), F.lit(False))).drop("_active")


def delete_where(df: DataFrame, **equal: object) -> DataFrame:
    """What remains after deleting rows with all given values; None is no condition, and no condition at all is refused."""
    given = {k: v for k, v in equal.items() if v is not None}
    if not given:
        raise ValueError("a delete needs a condition")
    hit = F.lit(True)
    for k, v in given.items():
        hit = hit & F.col(k).eqNullSafe(F.lit(v))
    return df.where(~hit)


def purge(df: DataFrame, as_of: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that haven't expired at ``as_of``; a null never expires."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def optional_filters(df: DataFrame, **equal: object) -> DataFrame:
    """One pushed-down equality filter for each argument that isn't None."""
    for k, v in equal.items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df


def deployments(configs: DataFrame, observations: DataFrame) -> DataFrame:
    """State of each deployment from its last configuration and the canary results after it.

    Configs: tenant_id, skill_name, seq, min_samples, max_error_rate. Observations: tenant_id, skill_name, seq, failed. The
    first observation at which enough samples have too high an error rate rolls the deployment back.
    """
    keys = ["tenant_id", "skill_name"]
    config = upsert_last(configs, keys).withColumnRenamed("seq", "config_seq")
    rows = observations.join(config, keys).where("seq > config_seq")
    run = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", F.count("*").over(run)).withColumn("_e", F.sum(F.col("failed").cast("int")).over(run))
    breach = (F.col("_n") >= F.col("min_samples")) & (F.col("_e") / F.col("_n") > F.col("max_error_rate"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("samples"), F.sum(F.col("failed").cast("long")).alias("errors"), F.min(F.when(breach, F.col("seq"))).alias("breach_seq"))
    out = config.join(counted, keys, "left").withColumns({"samples": F.coalesce("samples", F.lit(0)), "errors": F.coalesce("errors", F.lit(0))})
    return out.withColumn("status", F.when(F.col("breach_seq").isNotNull(), "rolled_back").otherwise("running"))


def promotions(configs: DataFrame, shadows: DataFrame, state: DataFrame) -> DataFrame:
    """Deployments whose shadow runs allow promotion, with the first observation that does.

    Shadows: tenant_id, skill_name, seq, disagreement, candidate_failed. ``state`` is from ``deployments``.
    """
    keys = ["tenant_id", "skill_name"]
    run = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    config = upsert_last(configs, keys).withColumnRenamed("seq", "config_seq")
    rows = shadows.join(config, keys).where("seq > config_seq").withColumn("_n", F.count("*").over(run)).withColumn("_d", F.sum((F.col("disagreement") > 0).cast("int")).over(run))
    rows = rows.join(state.select(*keys, "samples", "errors", "status"), keys)
    error_rate = F.coalesce(F.col("errors") / F.nullif("samples", F.lit(0)), F.lit(0.0))
    good = (F.col("status") == "running") & F.col("auto_promote") & (F.col("_n") >= F.col("min_samples")) & (F.col("_d") / F.col("_n") <= F.col("max_disagreement_rate")) & (error_rate <= F.col("max_error_rate")) & ~F.col("candidate_failed")
    return rows.where(good).groupBy(*keys).agg(F.min("seq").alias("promoted_seq"))


def lanes(keys: DataFrame, canary_percent: int, shadow_percent: int, tenant: str, skill: str, key: str = "key") -> DataFrame:
    """Lane and shadow flag of each key by a stable hash bucket of 100."""
    digest = F.sha2(F.concat_ws(":", F.lit(tenant), F.lit(skill), F.col(key).cast("string")), 256)
    b = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return keys.withColumn("bucket", b).withColumn("lane", F.when(b < canary_percent, "canary").otherwise("stable")).withColumn("shadow", b < shadow_percent)


def evolve_rules(rules: DataFrame, feedback: DataFrame) -> DataFrame:
    """Rules (skill, rule_id, match) after feedback (skill, seq, kind, rule_id, match) in its order.

    A false positive removes all rules with that id; a missed issue adds a rule unless one with the same id and match is
    there. A rule stands if the last event that touches its id and match leaves it standing.
    """
    removed = feedback.where("kind = 'false_positive'").groupBy("skill", "rule_id").agg(F.max("seq").alias("_gone"))
    added = feedback.where("kind = 'missed_issue'").groupBy("skill", "rule_id", "match").agg(F.max("seq").alias("_came"))
    first = rules.select("skill", "rule_id", "match").distinct().withColumn("_came", F.lit(-1).cast("long"))
    all_rules = first.unionByName(added).groupBy("skill", "rule_id", "match").agg(F.max("_came").alias("_came"))
    return all_rules.join(removed, ["skill", "rule_id"], "left").where(F.col("_gone").isNull() | (F.col("_came") > F.col("_gone"))).select("skill", "rule_id", "match")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Wanted keys without a readable cached payload; a null payload is a miss, so it is computed anew."""
    return wanted.join(cache.where("payload is not null").select(key).distinct(), key, "left_anti")


def cache_key(namespace: str, fingerprints: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{namespace}|"), F.array_join(F.array_sort(fingerprints), "\n")), 256)


def resume(cases: DataFrame, checkpoints: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases still to run: those whose last checkpoint isn't completed; an ambiguous one needs permission first."""
    last = checkpoints.groupBy(key).agg(F.max_by("status", "seq").alias("last_status"))
    out = cases.join(last, key, "left").where(F.coalesce("last_status", F.lit("")) != "SUCCESS")
    return out.withColumn("needs_permission", F.coalesce(F.col("last_status") == "AMBIGUOUS", F.lit(False)))


def terminal_state(events: DataFrame, key: str = "task_id") -> DataFrame:
    """Last state of a task, where a cancellation that came before success outranks it."""
    cancelled = F.min(F.when(F.col("state") == "CANCELLED", F.col("seq")))
    last = events.groupBy(key).agg(F.max_by("state", "seq").alias("_last"), cancelled.alias("_cancelled"))
    return last.select(key, F.when(F.col("_cancelled").isNotNull() & (F.col("_last") == "SUCCESS"), "CANCELLED").otherwise(F.col("_last")).alias("state"))


def progress(experiments: DataFrame, key: str = "run_id") -> DataFrame:
    """Calls, tokens and completed cases of persisted experiment rows."""
    n = lambda path: F.coalesce(F.sum(F.get_json_object("result", path).cast("long")), F.lit(0))
    return experiments.groupBy(key).agg(n("$.calls").alias("calls"), n("$.tokens").alias("tokens"), F.count_if(F.col("status") == "completed").alias("completed"))


def operation_ledger(log: DataFrame, key: str = "operation_id") -> DataFrame:
    """Operations with their first intent, and the last staged content and result that are known. The log has intent, staged, result and seq."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return log.groupBy(key).agg(F.min_by("intent", "seq").alias("intent"), last("staged"), last("result"))
