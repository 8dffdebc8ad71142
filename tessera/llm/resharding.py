"""Minimum-cost-flow resharding.

Rows lie in old shards and must go to shards of new capacities. A minimum-cost flow between old
and new shards says how many bytes each pair exchanges, so that the fewest bytes move. Every old
shard is a line of its rows, large rows first; its transfers are cut from the far end of that
line, so the cuts fall between small rows and the new shards come out near their capacities.

Offsets on the lines come from three sums: of size classes, of blocks within a class and of rows
within a block. Blocks are kept small by salting with the text's hash (equal texts lie together);
a text with more than ``HEAVY`` copies is salted by its row key too, so no block is large. Only
shard totals, at most one number a shard, come to the driver.

Null texts count as empty; null, repeated and tied keys are rows like any other; an empty table
gives an empty plan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage, spread

# Rows for one salt value, and copies of one text from which on they are salted by row key.
ROWS_PER_SALT = 100_000
HEAVY = 20_000
# Rows of a shard that one task writes when shards are rewritten.
ROWS_PER_FILE = 100_000
BLOCK = ["old_shard", "size_class", "salt", "sub"]


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Amounts from each old to each new shard, of least total cost, by successive shortest paths.

    ``cost`` is the price of a byte for each pair. Supplies must not exceed capacities in sum.
    """
    left, room = np.array(supply, dtype=np.int64), np.array(capacity, dtype=np.int64)
    if left.sum() > room.sum():
        raise ValueError("capacities are smaller than the rows in sum")
    cost = np.asarray(cost, dtype=float)
    flow = np.zeros(cost.shape, dtype=np.int64)
    while left.sum():
        to_old = np.where(left > 0, 0.0, np.inf)
        to_new = np.full(len(room), np.inf)
        before_old, before_new = np.full(len(left), -1), np.full(len(room), -1)
        changed = True
        while changed:
            ways = to_old[:, None] + cost
            best = ways.min(axis=0)
            nearer = best < to_new - 1e-9
            to_new[nearer], before_new[nearer] = best[nearer], ways.argmin(axis=0)[nearer]
            back = np.where(flow > 0, to_new[None, :] - cost, np.inf)
            best = back.min(axis=1)
            closer = best < to_old - 1e-9
            to_old[closer], before_old[closer] = best[closer], back.argmin(axis=1)[closer]
            changed = bool(closer.any())
        end = int(np.where(room > 0, to_new, np.inf).argmin())
        path, j, most = [], end, room[end]
        while True:
            i = int(before_new[j])
            path.append((i, j, 1))
            if before_old[i] < 0:
                most = min(most, left[i])
                break
            j = int(before_old[i])
            path.append((i, j, -1))
            most = min(most, flow[i, j])
        for i, j, sign in path:
            flow[i, j] += sign * most
        left[path[-1][0]] -= most
        room[end] -= most
    return flow


def cuts(flow: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Each old shard's line as pieces ``(old, start, end, new)``: what stays comes first."""
    pieces = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(np.flatnonzero(row), key=lambda j: (j != i, j)):
            pieces.append((i, at, at + int(row[j]), int(j)))
            at += int(row[j])
    return pieces


def measured(docs: DataFrame, key: str, text: str, old_shard: Column) -> DataFrame:
    """Per row: key, ``size`` (UTF-8 bytes and 8), ``text_crc32``, hash and old shard, without the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return spread(docs.select(key, text, old_shard.cast("int").alias("old_shard"))).select(
        F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("text_hash"), "old_shard")


def _lines(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with their block and ``start``, the offset on their old shard's line."""
    salts = max(1, math.ceil(rows.count() / ROWS_PER_SALT))
    heavy = (rows.groupBy("text_hash", "size").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > HEAVY).select("text_hash", "size", F.lit(True).alias("heavy")))
    placed = rows.join(heavy, ["text_hash", "size"], "left").select(
        *rows.columns, F.floor(F.log2("size")).cast("int").alias("size_class"),
        F.pmod("text_hash", F.lit(salts)).alias("salt"),
        F.when(F.col("heavy"), F.pmod(F.xxhash64(key), F.lit(salts))).otherwise(F.lit(-1)).alias("sub"))
    blocks = placed.groupBy(*BLOCK).agg(F.sum("size").alias("bytes"))
    classes = blocks.groupBy("old_shard", "size_class").agg(F.sum("bytes").alias("bytes")).select(
        "old_shard", "size_class", F.coalesce(F.sum("bytes").over(
            Window.partitionBy("old_shard").orderBy(F.desc("size_class")).rowsBetween(*_BEFORE)),
            F.lit(0)).alias("class_start"))
    starts = blocks.withColumn("block_start", F.coalesce(F.sum("bytes").over(
        Window.partitionBy("old_shard", "size_class").orderBy("salt", "sub").rowsBetween(*_BEFORE)), F.lit(0)))
    starts = starts.join(classes, ["old_shard", "size_class"]).select(
        *BLOCK, (F.col("class_start") + F.col("block_start")).alias("block_start"))
    within = F.coalesce(F.sum("size").over(
        Window.partitionBy(*BLOCK).orderBy(*_order(key)).rowsBetween(*_BEFORE)), F.lit(0))
    return placed.join(starts, BLOCK).withColumn("start", F.col("block_start") + within).drop("block_start")


_BEFORE = (Window.unboundedPreceding, -1)


def _order(key: str) -> list[Column]:
    return [F.desc("size"), F.col("text_hash"), F.col(key)]


def reshard(rows: DataFrame, capacities: list[int] | int, key: str, cost: np.ndarray | None = None) -> DataFrame:
    """Rows with new ``shard``, gapless ``slot`` and ``moved``.

    ``rows`` holds ``key, size, text_hash, old_shard`` and is read several times, so it should be
    a written table. ``capacities`` are bytes for each new shard, or a number of equal shards. A
    byte that leaves its shard costs 1 unless ``cost`` names a price for each pair.
    """
    spark = rows.sparkSession
    held = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    supply = [held.get(i, 0) for i in range(max(held, default=-1) + 1)]
    if isinstance(capacities, int):
        share, rest = divmod(sum(supply), capacities)
        capacities = [share + (j < rest) for j in range(capacities)]
    if cost is None:
        cost = np.ones((len(supply), len(capacities)))
        np.fill_diagonal(cost, 0)
    pieces = cuts(min_cost_flow(supply, capacities, cost)) if supply else []
    # At most one piece for each pair of shards, however many rows there are.
    table = F.broadcast(spark.createDataFrame(
        pieces, "old_shard int, piece_start long, piece_end long, shard int"))
    middle = 2 * F.col("start") + F.col("size")
    lines = _lines(rows, key).join(table, "old_shard").filter(
        (middle >= 2 * F.col("piece_start")) & (middle < 2 * F.col("piece_end")))
    lines = cut_lineage(lines.drop("piece_start", "piece_end"), "resharding")
    piece = ["shard", *BLOCK]
    counts = lines.groupBy(*piece).agg(F.count(F.lit(1)).alias("n")).withColumn("first_slot", F.coalesce(
        F.sum("n").over(Window.partitionBy("shard").orderBy(
            "old_shard", F.desc("size_class"), "salt", "sub").rowsBetween(*_BEFORE)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy(*piece).orderBy(*_order(key))) - 1
    return lines.join(counts, piece).withColumn("slot", (F.col("first_slot") + rank).cast("long")).withColumn(
        "moved", F.col("shard") != F.col("old_shard")).drop("first_slot", "start", *BLOCK[1:])


def rewrite(docs: DataFrame, plan: DataFrame, key: str, text: str, path: str) -> list[int]:
    """Write the files of the shards that gain or lose rows below ``path``; the others stay as they are.

    Rows find their place by key and text; identical rows are numbered, so each takes one place.
    Returns the rewritten shards.
    """
    changed = plan.filter("moved").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    touched = sorted(r[0] for r in changed.collect())
    match = [key, "text_hash", "copy"]
    copy = F.row_number().over(Window.partitionBy(key, "text_hash").orderBy(F.lit(1)))
    there = plan.filter(F.col("shard").isin(touched)).select(key, "text_hash", "shard", "slot")
    there = there.withColumn("copy", F.row_number().over(Window.partitionBy(key, "text_hash").orderBy("shard", "slot")))
    here = docs.withColumn("text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("copy", copy)
    met = [here[c].eqNullSafe(there[c]) for c in match]
    rows = here.join(there, met[0] & met[1] & met[2]).select(
        *[here[c] for c in docs.columns], there["shard"].alias("_shard"), there["slot"].alias("_slot"))
    stretch = F.floor(F.col("_slot") / ROWS_PER_FILE)
    rows.repartition("_shard", stretch).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
    return touched
