"""Near copies by SimHash, checked by the Jaccard likeness of word-shingle sets.

Two texts are linked when their sets of ``WIDTH``-word shingles have a likeness of at least ``LEAST``; classes are
the components of the links. Texts of equal sets are one class at once.

Candidates are the classes of SimHash: fingerprints of a set's shingles, linked by the index of ``simhash`` within
``DISTANCE`` bits. Few pairs near the least likeness are as close as that (a pair at 0.8 differs in about ten bits), and at
the distance that holds them the index would bring most texts together. For these pairs there are keys besides: ``BANDS``
MinHash keys of ``BAND_ROWS`` minima each, of which texts of likeness ``s`` share one with chance 1 - (1 - s^6)^30: 0.9999
at 0.8, 0.02 at 0.3. Texts that share a class or a key, directly or in chains, form a group.
A group's shingle sets meet in tasks, and each pair that shares a class or a key is checked on the whole sets unless it is in
one class already; so near copies cost a check for each text and not for each pair. Groups of more than
``PART`` shingles are cut into parts, each pair of parts a task.

Words are parts between ASCII blanks, ASCII letters lower-cased. Null texts and texts of blanks have the empty set;
texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.simhash import classes, majority
from tessera.llm.texts import fresh, pieces, release, spans, words
from tessera.session import bound_batches, cut_lineage, marked, spread

WIDTH = 5
LEAST = 0.8
DISTANCE = 4
BANDS = 30
BAND_ROWS = 6
PART = 1_000_000
ROWS_AT_ONCE = 512
PIECE_BYTES = 500_000
SET_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_DRAWS = _mixed(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) * _BASE)
_MASKS, _FACTORS = _DRAWS[::2], _DRAWS[1::2] | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for piece in pieces(texts, PIECE_BYTES):
        flat, owner = words(piece)
        coded = flat.dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        known = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary.cast(pa.large_binary())], np.uint64)
        value = known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
        ends = np.cumsum(np.bincount(owner, minlength=len(piece)))
        starts = np.r_[0, ends[:-1]]
        rolled = np.zeros(max(0, len(value) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * _BASE + value[k:k + len(rolled)]
        rolled = _mixed(rolled)
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for v in value[a:b]:
                    whole = whole * _BASE + v
                yield _mixed(whole)
            else:
                yield np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """MinHash band keys of a set; the empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(_MASKS), ~np.uint64(0))
    for at in range(0, len(shingles), ROWS_AT_ONCE):
        some = shingles[at:at + ROWS_AT_ONCE]
        np.minimum(least, ((some[None, :] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys * _BASE + row)
    return keys.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _sketches():
    """A column function from texts to a name of the shingle set, its size, its fingerprint and its band keys."""
    @F.arrow_udf("struct<name: binary, size: int, fp: long, bands: array<long>>")
    def found(texts: pa.Array) -> pa.Array:
        names, sizes, prints, keys = [], [], [], []
        for one in shingle_sets(texts):
            names.append(xxhash.xxh3_128_digest(one.tobytes()))
            sizes.append(len(one))
            prints.append(majority(one))
            keys.append(band_keys(one))
        made = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()),
                                           _lists(keys)], ["name", "size", "fp", "bands"])
        del names, sizes, prints, keys
        release()
        return made

    return found


def near_classes(bands: list[np.ndarray], sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set the first member of its class; sorted sets are compared if they share a band key."""
    label, sizes = np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), [len(b) for b in bands])
    keys = np.concatenate(bands) if bands else np.zeros(0, np.int64)
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for i in range(a, b - 1):
            hub, rest = owner[i], owner[i + 1:b]
            if i == a and (label[rest] == label[hub]).all():
                break
            rest = rest[label[rest] != label[hub]]
            rest = rest[np.minimum(sizes[rest], sizes[hub]) >= least * np.maximum(sizes[rest], sizes[hub])]
            for at in range(0, len(rest), 256):
                some = rest[at:at + 256]
                flat = np.concatenate([sets[x] for x in some])
                place = np.searchsorted(sets[hub], flat).clip(max=sizes[hub] - 1)
                both = np.add.reduceat(sets[hub][place] == flat, np.r_[0, np.cumsum(sizes[some])[:-1]], dtype=np.int64)
                near = some[both >= least * (sizes[some] + sizes[hub] - both)]
                met = np.unique(np.append(label[near], label[hub]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
    return label


def _make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with shingle sets in place of the texts, the last column; a set leaves once its piece is done."""
    for batch in batches:
        for at, to in spans(batch.column(batch.num_columns - 1), SET_BYTES):
            part = batch.slice(at, to - at)
            sets = _lists(list(shingle_sets(part.columns[-1])))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], sets], [*batch.schema.names[:-1], "shingles"])
        release()


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the tasks of a partition, whose rows lie together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(rows: pa.Table) -> pa.RecordBatch:
        nodes = rows.column("node").to_numpy()
        bands, sets = ([x.values.to_numpy().view(dtype) for x in rows.column(c).combine_chunks()]
                       for c, dtype in (("bands", np.int64), ("shingles", np.uint64)))
        label = near_classes(bands, sets)
        out = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[label[out]])], schema=schema)

    kept = None  # rows of a task that may go on in the next batch
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if kept is None else pa.concat_tables([kept, now])
        columns = [now.column(c).to_numpy() for c in ("group", "low", "high")]
        change = np.zeros(len(now), dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.r_[0, np.flatnonzero(change)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield linked(now.slice(a, b - a))
        kept = now.slice(int(cuts[-1]))
        del now, batch, columns
        release()
    if kept is not None and len(kept):
        yield linked(kept)


def _near_prints(distinct: DataFrame) -> DataFrame:
    """``node, band`` of the sets whose fingerprints are linked with another's: a key for each class of SimHash."""
    sets = distinct.filter("size > 0").select("node", "fp")
    found = sets.join(classes(sets, "node", DISTANCE), "fp")
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    return cut_lineage(found.join(several, "component_id").select("node", F.xxhash64("component_id").alias("band")), "near-prints")


def _links(rows: DataFrame, distinct: DataFrame, place: str, sketch: str, text: str) -> DataFrame:
    """``a, b`` links between nodes of ``distinct`` that connect its near classes.

    The table of candidates holds numbers only, and a broadcast filter holds back texts that are none.
    """
    prints = _near_prints(distinct)
    routed = prints.unionByName(distinct.select("node", F.explode("bands").alias("band")))
    hubs = routed.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    met = routed.join(hubs, "band").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = components(met.distinct()).select("node", F.col("root").alias("group"))
    groups = groups.unionByName(groups.select(F.col("group").alias("node"), "group").distinct())
    parts = distinct.select("node", "size").join(groups, "node").groupBy("group").agg(
        F.ceil(F.sum("size") / PART).cast("int").alias("parts")).filter("parts > 1")
    dealt = groups.join(parts, "group", "left").join(prints, "node", "left").select(
        "node", "group", F.coalesce("parts", F.lit(1)).alias("parts"), F.array_compact(F.array("band")).alias("more"))
    dealt = cut_lineage(dealt, "near-groups")
    held = rows.select(F.col(place).alias("node"), F.col(f"{sketch}.bands").alias("bands"), F.col(text).alias("text"))
    held = marked(held.withColumn("hash", F.xxhash64("node")), "hash", dealt.select(F.xxhash64("node")), "held").filter("held")
    held = held.join(dealt, "node").select("node", F.concat("bands", "more").alias("bands"), "group", "parts", "text")
    sets = held.mapInArrow(_make_sets, "node long, bands array<long>, group long, parts int, shingles array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["group", "low", "high"]
    sets = sets.select("node", "bands", "shingles", "group", F.least("own", "other").alias("low"),
                       F.greatest("own", "other").alias("high"))
    return sets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link_groups, "a long, b long")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each class: the one of the smallest key, first in the written order."""
    bound_batches(docs.sparkSession)
    sketch, place = fresh(docs, "_sketch"), fresh(docs, "_place")
    rows = spread(docs).withColumn(sketch, _sketches()(text)).withColumn(place, F.monotonically_increasing_id())
    rows = cut_lineage(rows, "shingle-rows")
    slim = rows.select(F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("id"), F.col(place).alias("place")).alias("row"),
                       F.col(place).alias("node"), f"{sketch}.*")
    distinct = cut_lineage(slim.groupBy("name", "size").agg(F.min("row").alias("row"), F.min("node").alias("node"),
                                                            F.first("fp").alias("fp"), F.first("bands").alias("bands")), "shingle-sets")
    roots = components(_links(rows, distinct, place, sketch, text)).withColumnRenamed("root", "_root")
    rooted = distinct.join(roots, "node", "left").select("row", F.coalesce("_root", "node").alias("root"))
    kept = cut_lineage(rooted.groupBy("root").agg(F.min("row").alias("kept")).select(F.col("kept.place").alias(place)), "near-kept")
    # Rows that surely stay do not move.
    hashed, flag = fresh(docs, "_hash"), fresh(docs, "_unsure")
    gone = rows.select(place).join(kept, place, "left_anti").select(F.xxhash64(place))
    rows = marked(rows.withColumn(hashed, F.xxhash64(place)), hashed, gone, flag)
    unsure = rows.filter(F.col(flag)).join(kept, place, "left_semi")
    return rows.filter(~F.col(flag)).unionByName(unsure.select(*rows.columns)).select(*docs.columns)
