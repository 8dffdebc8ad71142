"""N-gram Jaccard join by universe partition: sets of word shingles that overlap enough, as classes.

Two sets link when ``100 * intersection >= percent * union``. Then they differ in at most H = (a + b)(100 - percent) /
(100 + percent) shingles, a and b their sizes. Sizes fall into bands, so that partners lie in one band or in neighbouring
ones. For each band the universe of shingle hashes is cut into H + 1 segments, H taken for the largest pair of the band,
and two linked sets agree in all of some segment: they share the key of that segment's subset.

1. Sets that share a key with the smallest set of the key are checked against it, and classes formed.
2. What a key still holds of different classes is checked among itself. Keys of more than ``HOT`` sets are dear: a set
   may leave out its dear keys, at most half of its segments, if looking them up costs more than its one-deletion
   neighbourhoods, which it then gives for its other segments. Two sets that both leave out equal segments differ by at
   most one shingle in another one, or else by more than H in all; a set that leaves out no key meets all others.
   The sets of keys with a common hub (the smallest set, or that of a key near by) meet in one unit, not once a key. Units of more than
   ``PART`` shingles are cut into parts, each pair of parts a task, and pairs of one class are not checked.

Keys of few shingles are shared by many sets that are far apart, and by more of them the larger the table. So a set has a
sketch, a bit or two for each shingle: bit i is the parity of the number of its shingles whose hash ends in i. Sets that differ in d
shingles have sketches that differ in at most d bits. Candidates move their sketches first, and whole sets move only if
their sketches differ in at most H bits. That leaves out no linked pair.

Checks are on whole sets of 64-bit hashes of shingles. Nothing is left out: the method finds every linked pair.

Words are parts between ASCII blanks with A-Z in lower case; a text of fewer words than a shingle is one shingle. Null
texts and texts without words have the empty set and link with nothing, so each such row is a class of its own. Equal sets
are one class at once, repeated rows too. Rows with null keys take part; the class id is the smallest key that is not
null, or null if there is none. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shingles import shingle_sets
from tessera.llm.texts import spans
from tessera.session import cut_lineage, marked, possible, spread

WIDTH = 3
PERCENT = 90
# Ratio of a band's ends: wider ones have fewer sets near their lower end, which go to two levels, and more segments.
BAND = 1.4
# A key of more sets is dear; a set may leave its dear keys out if their sets are more than so many times its one-deletion keys,
# which cost a shuffled row each where a look-up costs a check in memory.
HOT = 1024
DELETION_COST = 16
PART = 500_000
SET_WEIGHT = 64
# A sketch takes a 32nd of its set at most, so a task of sketches may have more of them.
SKETCHES = 8
# Sets checked against one set in one task.
SALT_SETS = 2000
PIECE_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def most_apart(a: int, b: int, percent: int) -> int:
    """The most shingles in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Ranges of sizes and the number of segments for each, as far as sizes were asked for."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.top = percent, [0]

    def of(self, size: int) -> tuple[int, list[int]]:
        """The band of a size, and the levels (bands of the smaller partner) at which such sets meet others."""
        while self.top[-1] < size:
            least = self.top[-1] + 1
            self.top.append(max(least * 100 // self.percent, int(least * BAND)))
        band = int(np.searchsorted(self.top, size))
        below = band > 1 and size * self.percent <= 100 * self.top[band - 1]
        return band, [band - 1, band] if below else [band]

    def segments(self, level: int) -> int:
        top = self.top[level]
        return most_apart(top, top * 100 // self.percent, self.percent) + 1


def segment_keys(shingles: np.ndarray, level: int, segments: int, deletions: bool = False):
    """A key for each segment's subset of sorted ``shingles``; with ``deletions`` also those of its one-deletion
    neighbourhoods and their segments, (keys, neighbours, segments)."""
    place = ((shingles >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    cuts = np.searchsorted(place, np.arange(segments + 1, dtype=np.uint64))
    value = mixed(shingles)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)]
    sums = total[cuts[1:]] - total[cuts[:-1]]
    names = mixed(np.arange(segments, dtype=np.uint64) + np.uint64(level << 32) + _BASE)
    keys = mixed(sums * _BASE + names)
    if not deletions:
        return keys
    place = place.astype(np.int64)
    return keys, mixed((sums[place] - value) * _BASE + names[place]), place


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by the last bits of their hashes, a power of two of bits, at least as many as shingles."""
    bits = 64
    while bits < len(shingles):
        bits *= 2
    place = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """A sketch as it is with ``to`` words, a power of two below its own number."""
    while len(words) > to:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def near_partners(label: np.ndarray, side: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets may link with one of another class; if there are two sides, with one on the other side."""
    order = np.argsort(sizes, kind="stable")
    label, side, sizes = label[order], side[order], sizes[order].astype(np.int64)
    words = np.array([len(sketches[i]) for i in order])
    two, near = len(np.unique(side)) > 1, np.zeros(len(order), bool)
    ends = np.searchsorted(sizes, sizes * 100 // percent, "right")
    for width in np.unique(words):
        rows = np.flatnonzero(words == width)
        first = int(rows[0])
        all_bits = np.stack([folded(sketches[i], width) for i in order[first:ends[rows[-1]]]])
        for i in rows.tolist():
            others = slice(i + 1, int(ends[i]))
            apart = np.bitwise_count(all_bits[i + 1 - first:int(ends[i]) - first] ^ all_bits[i - first]).sum(axis=1, dtype=np.int64)
            may = (apart <= most_apart(sizes[others], sizes[i], percent)) & (label[others] != label[i])
            if two:
                may &= side[others] != side[i]
            near[others] |= may
            near[i] |= may.any()
    out = np.zeros(len(order), bool)
    out[order] = near
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _keys_of(width: int, percent: int):
    """Name, size and sketch of the set of each text, its keys at the level of its own band and, if there, of the one below,
    and the numbers of both."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            texts = batch.column("text")
            for at, to in spans(texts, PIECE_BYTES):
                names, sizes, sketches, high, low = [], [], [], [], []
                for held in shingle_sets(texts.slice(at, to - at), width):
                    names.append(xxhash.xxh3_128_digest(held.tobytes()))
                    sizes.append(len(held))
                    sketches.append(sketch(held))
                    levels = bands.of(len(held))[1] if len(held) else []
                    keys = [segment_keys(held, x, bands.segments(x)) for x in levels]
                    high.append(keys[-1] if keys else held)
                    low.append(keys[0] if len(keys) > 1 else held[:0])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, to - at) for c in ("key", "hash", "crc", "node")), pa.array(names, pa.binary()),
                     pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(map(len, high), pa.int32()),
                     pa.array(map(len, low), pa.int32()), _lists(high), _lists(low)],
                    ["key", "hash", "crc", "node", "name", "size", "sketch", "in_high", "in_low", "high", "low"])
                pa.default_memory_pool().release_unused()

    return task


def _sets_of(width: int):
    """Sets in place of ``name, text``, the last columns, for the texts whose set has that name."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at, to in spans(texts, PIECE_BYTES):
                part = batch.slice(at, to - at)
                sets = list(shingle_sets(texts.slice(at, to - at), width))
                names = part.column("name").to_pylist()
                same = [i for i, (held, name) in enumerate(zip(sets, names)) if xxhash.xxh3_128_digest(held.tobytes()) == name]
                kept = pa.array(same, pa.int64())
                yield pa.RecordBatch.from_arrays([*(x.take(kept) for x in part.columns[:-2]), _lists([sets[i] for i in same])],
                                                 [*part.schema.names[:-2], "shingles"])
                pa.default_memory_pool().release_unused()

    return task


def _neighbours(percent: int):
    """``key, node, active`` of ``node, lower, out, shingles``: the keys of the segments that are not left ``out``, and
    passive keys of their one-deletion neighbours."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("class", pa.int64()), ("active", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            nodes, classes = batch.column("node").to_numpy(), batch.column("class").to_numpy()
            lower = batch.column("lower").to_numpy(zero_copy_only=False)
            for node, label, low, out, shingles in zip(nodes, classes, lower, batch.column("out"), batch.column("shingles")):
                held = shingles.values.to_numpy().view(np.uint64)
                level = bands.of(len(held))[1][0 if low else -1]
                keys, fewer, place = segment_keys(held, level, bands.segments(level), deletions=True)
                stays = ~np.isin(keys.view(np.int64), out.values.to_numpy())
                keys, fewer = keys[stays], fewer[stays[place]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[keys, fewer].view(np.int64)), pa.array(np.full(len(keys) + len(fewer), node)),
                     pa.array(np.full(len(keys) + len(fewer), label)),
                     pa.array(np.arange(len(keys) + len(fewer)) < len(keys))], schema=schema)

    return task


def linked_to(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sorted sets link with a sorted set."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    fits = (np.minimum(sizes, len(one)) * 100 >= percent * np.maximum(sizes, len(one))) & (sizes > 0)
    out = np.zeros(len(others), bool)
    rows = np.flatnonzero(fits)
    for at in range(0, len(rows), 256):
        some = rows[at:at + 256]
        flat = np.concatenate([others[i] for i in some])
        place = np.searchsorted(one, flat).clip(max=len(one) - 1)
        both = np.add.reduceat(one[place] == flat, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
        out[some] = 100 * both >= percent * (sizes[some] + len(one) - both)
    return out


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of equal values in ``names``, and whether a slice begins such a run; runs may span batches."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = tuple(c[0] for c in columns) != last
        cuts = np.flatnonzero(change)
        for a, b in zip(np.unique(np.r_[0, cuts]).tolist(), [*cuts[cuts > 0].tolist(), batch.num_rows]):
            yield batch.slice(a, b - a), bool(change[a])
        last = tuple(c[-1] for c in columns)


def _held(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in batch.column("shingles")]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _check_hubs(percent: int):
    """Links of sets with their hub, whose row comes first in its run of ``hub, salt``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for rows, begins in _runs(batches, ["hub", "salt"]):
            sets = _held(rows)
            if begins:
                hub = sets[0].copy()
            near = linked_to(hub, sets, percent)
            nodes, hubs = rows.column("node").to_numpy(), rows.column("hub").to_numpy()
            near &= nodes != hubs
            yield pa.RecordBatch.from_arrays([pa.array(nodes[near]), pa.array(hubs[near])], schema=_LINK)

    return task


def check_unit(label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the classes of linked sets; if there are two sides, of sets on different ones.

    For each set, its shingles are marked among all of the unit's, and the marks of the sets of fitting sizes counted.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(sizes, kind="stable")
    label, side, sizes = label[order].copy(), side[order], sizes[order]
    known, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mark, links = ends - sizes, np.zeros(len(known), np.int8), []
    two = len(np.unique(side)) > 1
    for i in range(len(order) - 1):
        to = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        some = i + 1 + np.flatnonzero((label[i + 1:to] != label[i]) & (not two or side[i + 1:to] != side[i]))
        if not len(some):
            continue
        own = flat[starts[i]:ends[i]]
        mark[own] = 1
        first = some[0]
        held = mark[flat[starts[first]:ends[to - 1]]]
        both = np.add.reduceat(held, starts[first:to] - starts[first], dtype=np.int64)[some - first]
        mark[own] = 0
        near = some[100 * both >= percent * (sizes[some] + sizes[i] - both)]
        if len(near):
            links += [(order[x], order[i]) for x in near]
            met = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, met)] = met[0]
    return links


def _by_unit(work):
    """``work`` on each task of ``hub, part, other``, whose rows lie together."""
    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return work(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for rows, begins in _runs(batches, ["hub", "part", "other"]):
            if begins and kept:
                yield done(kept)
                kept = []
            kept.append(rows)
        if kept:
            yield done(kept)

    return task


def _check_units(percent: int):
    """Links within tasks."""
    def checked(rows: pa.RecordBatch) -> pa.RecordBatch:
        nodes, classes, own = (rows.column(c).to_numpy() for c in ("node", "class", "own"))
        links = check_unit(np.unique(classes, return_inverse=True)[1], own, _held(rows), percent)
        one, other = np.array(links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(nodes[one]), pa.array(nodes[other])], schema=_LINK)

    return _by_unit(checked)


def _sketched(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _check_sketches(percent: int):
    """``hub, node`` of the sets that may link within tasks."""
    def checked(rows: pa.RecordBatch) -> pa.RecordBatch:
        classes, own, sizes = (rows.column(c).to_numpy() for c in ("class", "own", "size"))
        near = pa.array(near_partners(classes, own, sizes, _sketched(rows.column("sketch")), percent))
        return rows.select(["hub", "node"]).filter(near)

    return _by_unit(checked)


def _check_pairs(percent: int):
    """``node, hub`` of the pairs that may link."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, hub_sizes = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "hub_size"))
            apart = np.zeros(rows.num_rows, np.int64)
            for i, (one, hub) in enumerate(zip(_sketched(rows.column("sketch")), _sketched(rows.column("hub_sketch")))):
                words = min(len(one), len(hub))
                apart[i] = np.bitwise_count(folded(one, words) ^ folded(hub, words)).sum(dtype=np.int64)
            yield rows.select(["node", "hub"]).filter(pa.array(apart <= most_apart(sizes, hub_sizes, percent)))

    return task


def _near_pairs(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The ``node, hub`` pairs whose sketches do not rule out a link."""
    ends = candidates.select("node", "size", "sketch")
    return pairs.join(ends.toDF("hub", "hub_size", "hub_sketch"), "hub").join(ends, "node").mapInArrow(
        _check_pairs(percent), "node long, hub long")


def _with_sets(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``wanted`` with ``shingles`` in place of ``hash, crc, name``. Texts that are not wanted stay where they are."""
    held = marked(texts, "hash", wanted.select("hash"), "held").filter("held").select("hash", "crc", "text")
    rows = wanted.join(held.dropDuplicates(["hash", "crc"]), ["hash", "crc"])
    more = wanted.drop("hash", "crc", "name")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in more.schema)
    return rows.select(*more.columns, "name", "text").mapInArrow(_sets_of(width), f"{kinds}, shingles array<long>")


def _places(pairs: DataFrame) -> DataFrame:
    """``node, to, salts`` of ``node, hub`` pairs: the hubs and tasks to which a set goes, and in how many tasks it is the hub;
    a hub of very many sets is checked in several."""
    salts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT_SETS).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt")
    members = pairs.join(salts, "hub").select("node", F.struct("hub", salt).alias("at"), F.lit(0).alias("salts"))
    hubs = salts.select(F.col("hub").alias("node"), F.lit(None).cast(members.schema["at"].dataType).alias("at"), "salts")
    return members.unionByName(hubs).groupBy("node").agg(F.collect_list("at").alias("to"), F.max("salts").alias("salts"))


def _near_hubs(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` links of ``node, shingles, to, salts`` with their hubs. A set carries its places and moves once to each."""
    own = F.transform(F.sequence(F.lit(1), "salts"), lambda x: F.struct(F.col("node").alias("hub"), (x - 1).alias("salt")))
    places = F.concat("to", F.when(F.col("salts") > 0, own).otherwise(F.array()))
    rows = sets.select("node", "shingles", F.explode(places).alias("at")).select("at.*", "node", "shingles")
    rows = rows.withColumn("member", F.col("node") != F.col("hub")).repartition("hub", "salt")
    return rows.sortWithinPartitions("hub", "salt", "member").select("hub", "salt", "node", "shingles").mapInArrow(
        _check_hubs(percent), "a long, b long")


def _dealt(units: DataFrame, part: int) -> DataFrame:
    """``units`` of several classes with the tasks ``part, other`` in which a set takes part, and its ``own`` side."""
    parts = units.groupBy("hub").agg(F.ceil(F.sum(F.col("size") + SET_WEIGHT) / part).cast("int").alias("parts"),
                                     (F.min("class") < F.max("class")).alias("several"))
    dealt = units.join(parts.filter("several").drop("several"), "hub").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"part": F.least("own", "with"), "other": F.greatest("own", "with")}).drop("with", "parts")


def _near_units(met: DataFrame, candidates: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b`` links among what ``key, node, class, active`` rows bring together."""
    several = (F.count(F.lit(1)) > 1) & F.max("active") & (F.min("class") < F.max("class"))
    lead = F.min(F.when(F.col("active"), F.col("lead"))).alias("hub")
    rows = met.withColumn("lead", F.col("node"))
    open_keys = rows.groupBy("key").agg(lead, several.alias("several")).filter("several").drop("several")
    rows = cut_lineage(met.join(open_keys, "key"), "jaccard-open")
    # Keys of one family get one hub: the smallest hub that a set of the key has with any key.
    rows = rows.drop("hub").join(rows.groupBy("node").agg(F.min("hub").alias("lead")), "node")
    rows = rows.drop("lead").join(rows.groupBy("key").agg(lead), "key")
    units = rows.select("hub", "node", "class").distinct().join(candidates.select("node", "size", "sketch"), "node")
    units = cut_lineage(units, "jaccard-units")
    keys = ["hub", "part", "other"]
    near = _dealt(units, SKETCHES * PART).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _check_sketches(percent), "hub long, node long").distinct()
    near = cut_lineage(units.drop("sketch").join(near, ["hub", "node"], "left_semi"), "jaccard-near")
    places = _dealt(near, PART).groupBy("node").agg(F.collect_list(F.struct(*keys, "own", "class")).alias("to"))
    wanted = cut_lineage(candidates.select("node", "hash", "crc", "name").join(places, "node"), "jaccard-wanted")
    rows = _with_sets(wanted, texts, width).select("node", "shingles", F.explode("to").alias("at")).select("at.*", "node", "shingles")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_check_units(percent), "a long, b long")


def _allocated(rest: DataFrame, candidates: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``key, node, class, active``: ``key, node, class, lower, held`` with dear keys left out where that is cheaper."""
    dear = F.col("held") > HOT
    cost = rest.groupBy("node", "lower").agg(F.count_if(dear).alias("dear"), F.sum(F.when(dear, F.col("held"))).alias("cost"),
                                             F.collect_list(F.when(dear, F.col("key"))).alias("out"),
                                             F.first("class").alias("class")).filter("dear > 0")
    left = cost.join(candidates.drop("sketch"), "node").filter(
        (2 * F.col("dear") <= F.when(F.col("lower"), F.col("in_low")).otherwise(F.col("in_high"))) & (F.col("cost") > DELETION_COST * F.col("size")))
    left = cut_lineage(left.select("node", "lower", "class", "out", "hash", "crc", "name", F.lit(True).alias("leaves")), "jaccard-left")
    rest = rest.join(left.select("node", "lower", "leaves"), ["node", "lower"], "left")
    kept = rest.select("key", "node", "class", (~dear | F.col("leaves").isNull()).alias("active"))
    if not left.isEmpty():
        kept = kept.unionByName(_with_sets(left.drop("leaves"), texts, width).mapInArrow(
            _neighbours(percent), "key long, node long, class long, active boolean"))
    return kept.groupBy("key", "node").agg(F.first("class").alias("class"), F.max("active").alias("active"))


def _classes(links: DataFrame) -> DataFrame:
    """``node, class`` of all nodes with links."""
    found = components(links).withColumnRenamed("root", "class")
    return found.unionByName(found.select(F.col("class").alias("node"), "class").distinct())


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row ``key, n_shingles, component_id``: the size of its set and the smallest key that links reach."""
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(key, text).alias("hash"),
                        F.crc32(F.col(text).cast("binary")).alias("crc"))
    kind = texts.schema["key"].dataType.simpleString()
    rows = spread(texts).withColumn("node", F.monotonically_increasing_id()).mapInArrow(
        _keys_of(width, percent),
        f"key {kind}, hash long, crc long, node long, name binary, size int, sketch binary, in_high int, in_low int, high array<long>, "
        "low array<long>")
    rows = cut_lineage(rows, "jaccard-rows")
    named = rows.select("key", "node", "name", "size")
    # A set stands for all rows that have it.
    first = cut_lineage(rows.filter("size > 0").groupBy("name", "size").agg(
        F.min("node").alias("node"), F.min("key").alias("key"), (F.count(F.lit(1)) > 1).alias("copied")), "jaccard-first")

    def level(name: str) -> Column:
        return F.transform(name, lambda k: F.struct(k.alias("key"), F.lit(name == "low").alias("lower")))
    # Only the keys of sets that may be repeated move to find the first of each.
    keyed = rows.filter("size > 0").select("node", "high", "low", F.xxhash64("name").alias("hash"))
    keyed = marked(keyed, "hash", first.filter("copied").select(F.xxhash64("name")), "copied")
    single, copied = (keyed.filter(x).select("node", "high", "low") for x in ("not copied", "copied"))
    routed = single.unionByName(copied.join(first.select("node"), "node")).select(
        "node", F.explode(F.concat(level("high"), level("low"))).alias("to")).select("node", "to.*")
    # A key moves once, with numbers only.
    same = Window.partitionBy("key")
    met = routed.select("*", F.min("node").over(same).alias("hub")).filter("node <> hub")
    met = cut_lineage(met, "jaccard-met")
    pairs = cut_lineage(met.select("node", "hub").distinct(), "jaccard-pairs")
    nodes = pairs.select(F.explode(F.array("node", "hub")).alias("node")).distinct()
    # The first row of a set, found again by the hashes of key and text, gives its text.
    candidates = rows.select("node", "hash", "crc", "name", "size", "in_low", "in_high", "sketch")
    candidates = possible(candidates, F.xxhash64("node"), nodes.select(F.xxhash64("node"))).join(nodes, "node")
    candidates = cut_lineage(candidates, "jaccard-candidates")
    near = cut_lineage(_near_pairs(pairs, candidates, percent), "jaccard-near")
    wanted = cut_lineage(candidates.select("node", "hash", "crc", "name").join(_places(near), "node"), "jaccard-wanted")
    sets = _with_sets(wanted, texts, width)
    to_hubs = cut_lineage(_near_hubs(sets, percent), "jaccard-links")
    known = cut_lineage(_classes(to_hubs), "jaccard-classes")
    rest = met.join(known, "node", "left").select("key", "node", "lower", F.coalesce("class", "node").alias("class"))
    counts = rest.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("class").alias("low"), F.max("class").alias("high"))
    rest = cut_lineage(rest.join(counts.filter("low < high").drop("low", "high"), "key"), "jaccard-rest")
    more = cut_lineage(_near_units(_allocated(rest, candidates, texts, width, percent), candidates, texts, width, percent), "jaccard-links")
    classes = _classes(to_hubs.unionByName(more))
    placed = first.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = placed.groupBy("class").agg(F.min("key").alias("component_id"))
    found = placed.join(least, "class").select("name", "size", "component_id", F.lit(True).alias("filled"))
    out = named.join(found, ["name", "size"], "left")
    return out.select(F.col("key").alias(key), F.col("size").cast("long").alias("n_shingles"),
                      F.when(F.col("filled"), F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def sql() -> str:
    """The same for ``documents`` in DuckDB, by joining the documents of each shingle."""
    return f"""WITH RECURSIVE parts AS (SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
held AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {WIDTH} THEN
    [array_to_string(w[i:i + {WIDTH - 1}], ' ') for i in range(1, len(w) - {WIDTH - 2})]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM parts),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM held),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id FROM held
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)"""
