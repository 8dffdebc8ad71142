"""Connected components of a link table, by alternating large and small stars.

Each round is a few grouped minima and joins, so a node with very many links is summed before the
shuffle and its join can be split; rounds grow with the logarithm of the longest chain. Each
round's links are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    turned = links.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return turned.unionByName(least.withColumnRenamed("least", "b")).filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links between long ids, in any order, to ``node, root``: the least id reachable.

    Ids without a link to another id are left out.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, state = cut_lineage(links, "links"), None
    while True:
        links = cut_lineage(_small_star(_large_star(links)), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(
            F.concat_ws(",", "a", "b").cast("binary")))).first())
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
