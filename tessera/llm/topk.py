"""Exact top-k search by inner product with sequential list access only (no random access).

For every dimension a slice of the candidates is a sorted list. A query reads its lists in
parallel from the better end. A candidate's upper bound takes the list's current value for each
dimension not yet read, its lower bound the list's last value. When at most ``RESOLVE``
candidates have an upper bound that reaches the k-th best lower bound, no outsider can qualify;
the final scores of those left are then resolved. The queries of a block share the reading, and
their bounds are matrix products.

Queries and candidates meet in blocks of bounded size, one task each, and a slice gives at most k
rows for a query. Scores are exact integers: components are scaled and rounded down first.

Vectors that are null, or hold null or non-finite components, and rows without an id take no
part. Vectors are compared with those of their own length. Equal scores go to the smaller id.
Repeated ids are candidates of their own; a query never meets rows of its own id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 8192
BLOCK_QUERIES = 256
RESOLVE = 64
# Shares of the lists after which bounds are compared.
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 13 / 16, 7 / 8, 15 / 16, 1)


def scaled(vectors: DataFrame, key: str, vector: str, scale: float = 1024.0) -> DataFrame:
    """``id, v``: rows that take part, components as ``floor(scale * x)``."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(whole).select(
        F.col(key).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def search(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray,
           k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows and scores of the k best of a slice, without rows of the query's name.

    All lists are read to the same depth from both ends; a query uses the upper end of a list where
    its weight is positive, else the lower end. A query leaves when its outcome is certain.
    """
    rows, length = matrix.shape
    order = np.argsort(matrix, axis=0, kind="stable")
    values = np.take_along_axis(matrix, order, axis=0).astype(float)
    columns = np.arange(length)
    high, low = np.zeros(matrix.shape), np.zeros(matrix.shape)  # values read from the upper and the lower end
    high_open, low_open = np.ones(matrix.shape), np.ones(matrix.shape)
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    found: list = [None] * len(names)
    left, before = np.arange(len(names)), 0
    for share in DEPTHS:
        depth = max(1, math.ceil(rows * share))
        if not len(left) or depth <= before:
            continue
        for read, still_open, part in ((high, high_open, slice(rows - depth, rows - before)), (low, low_open, slice(before, depth))):
            read[order[part], columns] = values[part]
            still_open[order[part], columns] = 0.0
        before = depth
        plus, minus = up[left], down[left]
        sure = plus @ high.T + minus @ low.T
        upper = sure + (plus * values[rows - depth]) @ high_open.T + (minus * values[depth - 1]) @ low_open.T
        lower = sure + (plus * values[0]) @ high_open.T + (minus * values[-1]) @ low_open.T
        own = names[left, None] == ids
        lower[own] = -np.inf
        kth = np.partition(lower, rows - k, axis=1)[:, rows - k] if rows > k else np.full(len(left), -np.inf)
        alive = (upper >= kth[:, None]) & ~own
        certain = (alive.sum(axis=1) <= max(k, RESOLVE)) | (depth == rows)
        for j in np.flatnonzero(certain):
            rest = np.flatnonzero(alive[j])
            scores = matrix[rest] @ queries[left[j]]
            best = np.lexsort((ids[rest], -scores))[:k]
            found[left[j]] = rest[best], scores[best]
        left = left[~certain]
    return found


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _slice_search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def task(queries: pa.Table, slice_rows: pa.Table) -> pa.Table:
        wanted, matrix = _matrix(queries, "v"), _matrix(slice_rows, "v")
        names, ids = queries.column("id").to_numpy(), slice_rows.column("id").to_numpy()
        if not len(names) or not len(ids):
            return schema.empty_table()
        found = [(np.full(len(rows), name), ids[rows], scores)
                 for name, (rows, scores) in zip(names, search(names, wanted, ids, matrix, k))]
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=schema)

    return task


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each query among ``id, v`` vectors."""
    queries = vectors.filter(is_query)
    slices = max(1, math.ceil(vectors.count() / SLICE_ROWS))
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    keys = ["length", "block", "slice"]

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    asked = queries.select("id", "v", F.size("v").alias("length"), dealt(blocks).alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    held = vectors.select("id", "v", F.size("v").alias("length"), dealt(slices).alias("slice"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        _slice_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
