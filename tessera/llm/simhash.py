"""SimHash near-duplicates, linked through a hierarchical index in Gray order.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles. Distinct
fingerprints within ``distance`` bits are linked; classes are the components of the links.

Candidates: of ``distance + m`` blocks of bits, two linked fingerprints agree on at least ``m``, so
a table for each choice of ``m`` blocks brings every linked pair together; ``m`` grows with the
number of fingerprints, which changes the work and not the result. A bucket of a table is sorted
by Gray rank, so that neighbours differ in few bits. Runs of ``FANOUT`` fingerprints form a node
that holds their shared bits (mask and pattern), runs of nodes form the next level. The index is
joined with itself from the root: a pair of nodes whose shared bits already differ too often is
pruned with everything below; a pair that cannot differ too often is linked as a whole; a pair
inside one known component is skipped. A bucket gives at most one link for each member, never
all pairs. Buckets of more than ``HOT`` members are cut into parts, each pair of parts a task.

Null and empty texts, and texts of blanks, have fingerprint zero and are linked like any other;
texts of fewer words than a shingle are one shingle. Null ids take part and are never the smallest
id of a class unless it has no other (then the class id is null); repeated ids and rows are rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.texts import fresh
from tessera.session import cut_lineage, spread

SEED = 42
BITS = 64
FANOUT = 8
HOT = 20_000
BUCKET = 2048
PAIRS_AT_ONCE = 1 << 18


def majority(hashes: np.ndarray) -> int:
    """A fingerprint: the bits that more than half of the hashes have; zero without hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the hashes of a text's shingles of ``width`` lower-cased words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    shingles = max(1, len(words) - width + 1)
    one = xxhash.xxh64_intdigest
    spans = zip(starts[:shingles].tolist(), ends[min(width, len(words)) - 1:].tolist())
    hashes = np.fromiter((one(joined[a:b], SEED) for a, b in spans), np.uint64, shingles)
    return majority(hashes)


def fingerprints(width: int):
    """A column function from texts to signed 64-bit fingerprints. Only texts go to the Python workers."""
    @F.arrow_udf("long")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())

    return found


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each pattern in the reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order, group by group.

    ``masks`` hold the bits that all members share, ``patterns`` their values, ``first`` and
    ``last`` the members; children of a node are ``child_first .. child_last`` one level down.
    """

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        order = np.lexsort((gray_rank(values), groups))
        self.values, groups = values[order], groups[order]
        rows = np.arange(len(values))
        self.masks = [np.full(len(values), ~np.uint64(0))]
        self.patterns, self.first, self.last, self.children = [self.values], [rows], [rows + 1], [None]
        while len(groups) > len(np.unique(groups)):
            place = np.arange(len(groups))
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            place -= np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
            heads = np.flatnonzero(place % FANOUT == 0)
            ends = np.r_[heads[1:], len(groups)]
            ones = np.bitwise_and.reduceat(self.patterns[-1] | ~self.masks[-1], heads)
            zeros = np.bitwise_or.reduceat(self.patterns[-1] & self.masks[-1], heads)
            mask = np.bitwise_and.reduceat(self.masks[-1], heads) & ~(ones ^ zeros)
            self.masks.append(mask)
            self.patterns.append(zeros & mask)
            self.first.append(self.first[-1][heads])
            self.last.append(self.last[-1][ends - 1])
            self.children.append((heads, ends))
            groups = groups[heads]

    def labels(self, distance: int) -> np.ndarray:
        """For each member the first member of its local component."""
        parent = np.arange(len(self.values))
        near = np.flatnonzero(np.bitwise_count(self.values[1:] ^ self.values[:-1]) <= distance)
        near = near[self._same_group(near)]
        parent = _merge(parent, near, near + 1)
        top = len(self.masks) - 1
        roots = np.arange(len(self.masks[top]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                stack.append((level, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
                a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
            known = self._known(parent, level, a, b)
            a, b = a[~known], b[~known]
            shared = self.masks[level][a] & self.masks[level][b]
            differ = self.patterns[level][a] ^ self.patterns[level][b]
            least = np.bitwise_count(differ & shared)
            most = np.bitwise_count(differ & shared | ~shared)
            whole = most <= distance
            if whole.any():
                parent = _merge(parent, *self._members(level, a[whole], b[whole]))
            open_pairs = (least <= distance) & ~whole
            if level and open_pairs.any():
                stack.append((level - 1, *self._below(level, a[open_pairs], b[open_pairs])))
        return parent

    def _same_group(self, rows: np.ndarray) -> np.ndarray:
        top = np.searchsorted(self.first[-1], rows, "right")
        return top == np.searchsorted(self.first[-1], rows + 1, "right")

    def _known(self, parent: np.ndarray, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs whose members are all in one component already."""
        if not level:
            return (parent[a] == parent[b])
        low = np.minimum.reduceat(parent, self.first[level])
        high = np.maximum.reduceat(parent, self.first[level])
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

    def _members(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links from the first member of ``a`` to every member of ``a`` and ``b``."""
        first, last = self.first[level], self.last[level]
        hub, start, end = np.r_[first[a], first[a]], np.r_[first[a], first[b]], np.r_[last[a], last[b]]
        return np.repeat(hub, end - start), _ranges(start, end)

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads, ends = self.children[level]
        na, nb = ends[a] - heads[a], ends[b] - heads[b]
        left = np.repeat(_ranges(heads[a], ends[a]), np.repeat(nb, na))
        right = _ranges(np.repeat(heads[b], na), np.repeat(ends[b], na))
        kept = left <= right
        return left[kept], right[kept]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``start .. end``, one after the other."""
    sizes = end - start
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, dtype=np.int64)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least member) after links ``a - b``."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _tables(fingerprints: int, distance: int) -> list[int]:
    """Masks of the bits that a bucket shares, one for each table."""
    for m in range(1, BITS - distance):
        blocks = distance + m
        if fingerprints / 2.0 ** (BITS * m / blocks) <= BUCKET or m == 4:
            break
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, m)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _link_buckets(distance: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys = ["table", "bucket", "low", "high"]

    def linked(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(c).to_numpy() for c in keys]
        change = np.zeros(len(rows), dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        index = GrayIndex(np.cumsum(change), rows.column("fp").to_numpy().view(np.uint64))
        root = index.labels(distance)
        out = np.flatnonzero(root != np.arange(len(root)))
        values = index.values.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(values[out]), pa.array(values[root[out]])], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # rows of a bucket that may go on in the next batch
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if kept is None else pa.concat_tables([kept, now]).combine_chunks()
            columns = [now.column(c).to_numpy() for c in keys]
            same = np.ones(len(now), dtype=bool)
            for c in columns:
                same &= c == c[-1]
            cut = int(same.argmax()) if len(now) else 0
            if cut:
                yield linked(now.slice(0, cut).combine_chunks())
            kept = now.slice(cut)
        if kept is not None and len(kept):
            yield linked(kept.combine_chunks())

    return task


def links(fingerprints: DataFrame, distance: int = 4) -> DataFrame:
    """``a, b`` links that connect distinct ``fp`` values within ``distance`` bits, directly or in chains."""
    masks = _tables(fingerprints.count(), distance)
    buckets = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket"))
                        for i, m in enumerate(masks)])
    routed = fingerprints.select("fp", F.explode(buckets).alias("to")).select("fp", "to.*")
    hot = routed.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select(
        "table", "bucket", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    dealt = routed.join(hot, ["table", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["table", "bucket", "low", "high"]
    dealt = dealt.select("fp", "table", "bucket", F.least("own", "other").alias("low"),
                         F.greatest("own", "other").alias("high"))
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link_buckets(distance), "a long, b long")


def classes(rows: DataFrame, key: str, distance: int = 4) -> DataFrame:
    """``fp, root, component_id``: the smallest key among all rows whose fingerprints are connected.

    ``rows`` hold ``key, fp`` and are read several times, so they should be a written table.
    """
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4,
                    distance: int = 4) -> DataFrame:
    """Per row ``key``, ``fingerprint`` in hex and ``component_id``. Texts are read once."""
    rows = spread(docs.select(F.col(key), F.col(text))).select(key, fingerprints(width)(text).alias("fp"))
    rows = cut_lineage(rows, "simhash")
    found = rows.join(classes(rows, key, distance), "fp")
    return found.select(key, hexed(F.col("fp")).alias("fingerprint"), "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4,
                distance: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row of each class: the one of the smallest key, first in the written order."""
    fp, place = fresh(docs, "_fp"), fresh(docs, "_place")
    rows = spread(docs).withColumn(fp, fingerprints(width)(text)).withColumn(place, F.monotonically_increasing_id())
    rows = cut_lineage(rows, "simhash-rows")
    slim = rows.select(F.col(key).alias("id"), F.col(place).alias("place"), F.col(fp).alias("fp"))
    met = slim.join(classes(slim, "id", distance), "fp")
    first = met.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "place")).alias("kept"))
    kept = first.select(F.col("kept.place").alias(place))
    return rows.join(kept, place, "left_semi").select(*docs.columns)
