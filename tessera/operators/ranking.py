"""Exact ranks and cut points without a window over the whole table.

Rows fall into ordered buckets; bucket counts give each bucket its starting rank and a
window ranks inside a bucket only. Buckets come from a uniform hash or from range
partitions, so a hot class spreads over all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import seeded_md5
from tessera.session import cut_lineage

ROWS_PER_BUCKET = 250_000


def bucket_digits(rows: int) -> int:
    """Hex digits that keep a bucket near ``ROWS_PER_BUCKET`` rows; one digit at least."""
    if rows <= ROWS_PER_BUCKET:
        return 1
    return math.ceil(math.log(rows / ROWS_PER_BUCKET, 16)) + 1


def bucketed_rank(df: DataFrame, by: list[str], bucket: Column, order: list[Column],
                  out: str = "rank") -> DataFrame:
    """Add ``out``: the 0-based rank within ``by``, where ``bucket`` never falls along ``order``."""
    placed = df.withColumn("_bucket", bucket)
    starts = (placed.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
                             F.col("_bucket").alias("_b"))
              .agg(F.count(F.lit(1)).alias("_n")))
    before = (Window.partitionBy(*[f"_by{i}" for i in range(len(by))]).orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")).drop("_n")
    starts = cut_lineage(starts, "starts")
    match = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(by):
        match = match & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = (placed.withColumn("_pos", F.row_number().over(inside))
              .join(starts, match))
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns],
                         (F.col("_start") + F.col("_pos") - 1).cast("bigint").alias(out))


def hash_rank(df: DataFrame, key: str, seed: int, by: list[str] | None = None,
              out: str = "rank", rows: int | None = None) -> DataFrame:
    """Rank rows within ``by`` by the seeded md5 of a unique ``key``: a repeatable shuffle."""
    digits = bucket_digits(df.count() if rows is None else rows)
    hashed = df.withColumn("_md5", seeded_md5(seed, F.col(key)))
    ranked = bucketed_rank(hashed, by or [], F.substring("_md5", 1, digits),
                           [F.col("_md5"), F.col(key)], out)
    return ranked.drop("_md5")


def value_rank(df: DataFrame, by: str, value: str, out: str = "rank") -> DataFrame:
    """Rank distinct (``by``, ``value``) rows by value within ``by``.

    Range partitioning samples the split points. The partition numbers are written down with
    the rows, so counting and ranking see the same ones.
    """
    ranged = df.repartitionByRange(F.col(by), F.col(value))
    placed = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    return bucketed_rank(placed, [by], F.col("_range"), [F.col(value)], out).drop("_range")


def _boundary(hashed: DataFrame, digits: int, nth: int) -> Row:
    """The md5 prefix that holds the ``nth`` row (1-based), its rows and those before it."""
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (hashed.groupBy(F.substring("_md5", 1, digits).alias("prefix"))
              .agg(F.count(F.lit(1)).alias("n"))
              .withColumn("upto", F.sum("n").over(running)))
    return (counts.filter(F.col("upto") >= nth).orderBy("prefix")
            .select("prefix", "n", (F.col("upto") - F.col("n")).alias("before")).first())


def hash_cut(df: DataFrame, key: str, seed: int, nth: int) -> tuple[str, object]:
    """The (md5, key) of the ``nth`` smallest row; rows up to it are exactly ``nth`` many.

    A pass of prefix counts narrows the search to 1 in 16**4 of the table, a second one to 1 in
    16**8 where that is still large, so no row is shuffled or sorted beyond that last sliver.
    """
    hashed = df.select(F.col(key).alias("_key"), seeded_md5(seed, F.col(key)).alias("_md5"))
    done, left = 0, ROWS_PER_BUCKET + 1
    for digits in (4, 8):
        if left > ROWS_PER_BUCKET:
            edge = _boundary(hashed, digits, nth - done)
            done, left = done + edge["before"], edge["n"]
            hashed = hashed.filter(F.substring("_md5", 1, digits) == edge["prefix"])
    sliver = Window.orderBy("_md5", "_key")
    hit = (hashed.withColumn("_pos", F.row_number().over(sliver))
           .filter(F.col("_pos") == nth - done).first())
    return hit["_md5"], hit["_key"]
