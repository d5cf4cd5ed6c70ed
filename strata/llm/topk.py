"""Exact search of the highest inner products by the threshold algorithm over sorted lists of each dimension.

Candidates lie in blocks, each with a list per dimension, sorted by value. A query reads
the lists from the end that its component favours. After r entries of every list no
unread row can score more than the sum of its components times the lists' next values;
once that bound doesn't beat the k-th score so far, the rows read are all that can count,
and they alone are scored. A block whose bound fails at r = 0 isn't read at all; one in
which the lists would have to be read so far that they name most rows is scored whole.

Queries and candidates meet in a grid: every candidate goes to each group of queries, and
every query to each group of candidates. Groups are of bounded size, and the grid is cut
so that queries are copied about as much as there are candidates. Each cell keeps k rows
of a query, and the best of these are the result.

Defined cases: vectors that are null or hold null or non-finite entries take no part;
shorter vectors count as ending in zeros; scaled entries beyond 2**52 count as 2**52, and
scores beyond a long as its end. All rows with a query's id are its own. Repeated
candidates count each; repeated queries are asked once. Ties go to the smaller id, null ids
last. Columns other than the id and the vector are not looked at. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import vectors

#: Rows of the largest group of queries or candidates: what one task holds of each.
GROUP_ROWS = 1 << 19
#: Candidates that are worth a task of their own.
TASK_ROWS = 4096
#: Candidates that share sorted lists, and queries that are scored against them at a time.
LIST_ROWS, QUERY_ROWS = 4096, 512
#: Lists are read while they name at most this part of a block's rows.
READ_PART = 0.25


def _merge(best: np.ndarray, at: np.ndarray, who: np.ndarray, q: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
    """Take new (query, score, place) hits into the k best of the queries ``who``, in place; ties go to the earlier place."""
    k = best.shape[1]
    local = np.searchsorted(who, q)
    group = np.concatenate([np.repeat(np.arange(len(who)), k), local])
    score, place = np.concatenate([best[who].ravel(), scores]), np.concatenate([at[who].ravel(), places])
    order = np.lexsort((place, -score if score.dtype == np.float64 else ~score, group))
    group, score, place = group[order], score[order], place[order]
    first = np.arange(len(group)) - np.searchsorted(group, group)
    kept = first < k
    best[who[group[kept]], first[kept]] = score[kept]
    at[who[group[kept]], first[kept]] = place[kept]


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, list_rows: int = LIST_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """The places and scores of the ``k`` best rows of each query (place -1 where there are fewer), and how many rows were scored.

    ``rows`` are ordered by ids, so an equal score at a later place never counts; rows past the ids have none.
    """
    top = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * rows.shape[1]
    plain = top < 1 << 53
    kind, low = (np.float64, -np.inf) if plain else (object, -(1 << 63))
    product = (lambda a, b: a @ b) if plain else (lambda a, b: np.clip(a @ b, low + 1, (1 << 63) - 1).astype(np.int64))
    q = queries.astype(kind)
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
    best = np.full((len(q), k), low, dtype=np.float64 if plain else np.int64)
    at, scored = np.full((len(q), k), -1), 0
    own_from, own_to = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for start in range(0, len(rows), list_rows):
        block = rows[start : start + list_rows]
        stop, values = start + len(block), block.astype(kind)
        order = np.argsort(block, axis=0, kind="stable")
        lists = np.take_along_axis(block, order, axis=0)
        depths = [0] + [r for r in (1 << i for i in range(20)) if r < len(block) and r * block.shape[1] <= READ_PART * len(block)]
        ends = np.hstack([lists[[len(block) - 1 - r for r in depths]], lists[depths]])
        bound = np.asarray(product(signed, ends.T.astype(kind)))
        enough = bound <= best[:, -1:]
        depth = np.where(enough.any(axis=1), enough.argmax(axis=1), len(depths))
        for i in np.flatnonzero((depth > 0) & (depth < len(depths))):
            r = depths[depth[i]]
            seen = np.unique(np.concatenate([order[len(block) - r :, queries[i] > 0].ravel(), order[:r, queries[i] < 0].ravel()]))
            seen = seen[(seen + start < own_from[i]) | (seen + start >= own_to[i])]
            score = np.asarray(product(values[seen], q[i]))
            hit = score > best[i, -1]
            scored += len(seen)
            _merge(best, at, np.array([i]), np.full(int(hit.sum()), i), score[hit], seen[hit] + start)
        rest = np.flatnonzero(depth == len(depths))
        for chunk in (rest[j : j + QUERY_ROWS] for j in range(0, len(rest), QUERY_ROWS)):
            score = np.asarray(product(q[chunk], values.T))
            scored += score.size
            for j in np.flatnonzero((own_from[chunk] < stop) & (own_to[chunk] > start)):
                score[j, max(own_from[chunk[j]] - start, 0) : max(own_to[chunk[j]] - start, 0)] = low
            hit = score > best[chunk, -1][:, None]
            if len(block) > k:
                hit &= score >= np.partition(score, len(block) - k, axis=1)[:, len(block) - k][:, None]
            i, place = np.nonzero(hit)
            _merge(best, at, chunk, chunk[i], score[i, place], place + start)
    return at, best, scored


def top_k(df: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the highest integer inner products with each row that ``asked`` (a condition on ``key``) selects."""
    plain = vectors.integers(df, key, column, scale)
    shape = vectors.measured(plain)
    rows = vectors.narrowed(plain, shape)
    queries = rows.where(asked).distinct()
    n_queries = queries.count()
    by_queries = max(1, -(-n_queries // GROUP_ROWS))
    by_rows = max(1, -(-shape.rows // GROUP_ROWS), min(-(-shape.rows // TASK_ROWS), -(-shape.rows // max(n_queries, 1))))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("key", "vector", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(by_rows)).cast("int").alias("cell_row"), numbers(by_queries).alias("cell_query"))
    right = queries.select("key", "vector", F.xxhash64("vector").alias("mark"), F.pmod(F.xxhash64("key", "vector"), F.lit(by_queries)).cast("int").alias("cell_query")).select("*", numbers(by_rows).alias("cell_row"))
    id_type = rows.schema["key"].dataType.simpleString()
    width = shape.width

    def cell(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        keys = candidates.column("key").combine_chunks()
        order = np.asarray(pa.compute.sort_indices(keys, null_placement="at_end"))
        keys, known = keys.take(pa.array(order)), len(keys) - keys.null_count
        places, scores, _ = search(keys.slice(0, known).to_numpy(zero_copy_only=False), vectors.matrix(candidates.column("vector"), width)[order], asking.column("key").to_numpy(), vectors.matrix(asking.column("vector"), width), k)
        who, nth = np.nonzero(places >= 0)
        out = [asking.column("key").take(pa.array(who)), asking.column("mark").take(pa.array(who)), keys.take(pa.array(places[who, nth])), pa.array(scores[who, nth].astype(np.int64))]
        return pa.table(out, names=["query_id", "mark", "vec_id", "score"])

    found = left.groupBy("cell_row", "cell_query").cogroup(right.groupBy("cell_row", "cell_query")).applyInArrow(cell, f"query_id {id_type}, mark bigint, vec_id {id_type}, score bigint")
    ranked = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    return f"""
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0)
    SELECT query_id, rank, vec_id, score
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"""
