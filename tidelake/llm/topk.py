"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists per dimension.

Rows and queries are dealt into blocks, and each pair of a block of rows and a block of queries is a cell that one task
works on alone, in bounded memory. Within a cell every dimension has a list of the rows sorted by their component. A query
goes down the lists (up, where its weight is negative), a depth at a time: rows met in any list are scored whole, and once
the bound, the score of an imagined row that has the last component seen in every list, is below the query's kth score, no
row below can be among the best. A last step merges the cells' best rows of each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and queries of a cell, about.
ROW_BLOCK, QUERY_BLOCK = 8192, 512
#: Depths of the sorted lists at which the bound is looked at, as shares of a block.
DEPTHS = (1 / 32, 1 / 8, 1 / 2, 1.0)
#: Above this, sums of products might not be whole as doubles.
EXACT = 2.0**50


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, or null if the vector is null or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(column.flatten())
    return out


def threshold_top_k(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's best k rows but its own, ties to the smaller id; `ids` ascend."""
    n = len(rows)
    if not n or not len(queries):
        return (np.zeros(0, np.int64),) * 3
    whole = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1]) < EXACT / n
    x, q = (rows.astype(float), queries.astype(float)) if whole else (rows, queries)
    lists = np.argsort(-x, axis=0, kind="stable")
    dims = np.arange(x.shape[1])
    # Unique keys put score first and then the smaller id; rows not scored yet are below all.
    unseen = -np.inf if whole else np.iinfo(np.int64).min
    keys = np.full((len(q), n), unseen, x.dtype)
    own_low, own_high = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    scored, active = np.zeros(n, bool), np.arange(len(q))
    up, down = np.maximum(np.sign(q), 0).astype(np.float32), np.maximum(-np.sign(q), 0).astype(np.float32)
    for share in DEPTHS:
        depth = min(n, max(k + 1, int(n * share)))
        top, bottom = np.zeros((len(dims), n), np.float32), np.zeros((len(dims), n), np.float32)
        top[dims[:, None], lists[:depth].T] = 1
        bottom[dims[:, None], lists[n - depth :].T] = 1
        met = (up[active] @ top + down[active] @ bottom > 0).any(axis=0) if depth < n else np.ones(n, bool)
        # Random access: rows that any query of the block has met are scored whole, for all queries still open.
        fresh = np.flatnonzero(met & ~scored)
        scored |= met
        found = q[active] @ x[fresh].T
        keys[np.ix_(active, fresh)] = found * n + (n - 1 - fresh) if whole else found
        for i in active[own_low[active] < own_high[active]]:
            keys[i, own_low[i] : own_high[i]] = unseen
        if depth == n:
            break
        kth = np.partition(keys[active], max(0, n - k), axis=1)[:, max(0, n - k)]
        last = np.where(q[active] > 0, x[lists[depth - 1], dims], x[lists[n - depth], dims])
        bound = (q[active] * last).sum(axis=1)
        open_ = kth <= (bound * n + n if whole else bound)  # a row below could still tie or win
        active = active[open_]
        if not len(active):
            break
    best_query, best_row, best_score = [], [], []
    for i in range(len(q)):
        if whole:
            best = np.argpartition(-keys[i], min(k, n - 1))[: k + 1]
            best = best[np.argsort(-keys[i, best])][:k]
        else:
            best = np.lexsort((np.arange(n), -keys[i].astype(object)))[:k]
        best = best[keys[i, best] != unseen]
        best_query.append(np.full(len(best), i))
        best_row.append(best)
        best_score.append(np.floor(keys[i, best] / n) if whole else keys[i, best])
    return np.concatenate(best_query), np.concatenate(best_row), np.concatenate(best_score).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k best rows of `vectors`, or all if fewer.

    Both frames: `vec_id` and `vector`, an array of whole numbers; other columns are ignored. Rows with a null in either
    take no part. A query's own rows are those with its id; of queries that share an id, the one with the smallest vector
    counts. Rows that share an id are rows of their own. Components missing from a shorter vector count as 0. Ties go to the
    smaller id. Empty tables give no rows.
    """
    sound = F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<long>")).where(sound)
    queries = queries.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<long>")).where(sound)
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    row_blocks = max(1, -(-vectors.count() // row_block))
    query_blocks = max(1, -(-queries.count() // query_block))

    def dealt(frame: DataFrame, is_query: bool, own: int, other: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(own))
        theirs = F.explode(F.sequence(F.lit(0), F.lit(other - 1)).cast("array<long>")).alias("other")
        cell = F.col("other") * row_blocks + F.col("mine") if not is_query else F.col("mine") * row_blocks + F.col("other")
        return frame.select("vec_id", "vector", mine.alias("mine"), theirs).select(cell.alias("cell"), F.lit(is_query).alias("is_query"), "vec_id", "vector")

    def search(cell: pa.Table) -> pa.Table:
        cell = cell.take(pa.array(np.argsort(np.asarray(cell["vec_id"]), kind="stable")))
        asks, ids = np.asarray(cell["is_query"]), np.asarray(cell["vec_id"])
        lengths = np.asarray(pc.list_value_length(cell["vector"]))
        everything = _matrix(cell["vector"], int(lengths.max(initial=0)))
        query, row, score = threshold_top_k(ids[~asks], everything[~asks], ids[asks], everything[asks], k)
        return pa.table({"query_id": ids[asks][query], "vec_id": ids[~asks][row], "score": score})

    cells = dealt(vectors, False, row_blocks, query_blocks).unionByName(dealt(queries, True, query_blocks, row_blocks))
    found = cells.groupBy("cell").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
