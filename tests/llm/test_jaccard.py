"""The n-gram Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import jaccard, queries
from tessera.session import marked
from tests.llm.edges import documents, nothing, words
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def plain_set(text, width=3):
    held = words(text)
    return {tuple(held[i:i + width]) for i in range(max(1, len(held) - width + 1))} if held else set()


def plain(rows):
    """(key, n_shingles, component) of every row by comparing all pairs of sets."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and label[i] != label[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (key, _), x in zip(rows, label):
        if key is not None:
            least[x] = min(key, least.get(x, key))
    return Counter((k, len(s), least.get(x) if s else k) for (k, _), s, x in zip(rows, sets, label))


def got(frame):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(frame).collect())


def family(rng, count, length, edits):
    """A text, and copies of it with some words changed."""
    text = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = [text]
    for _ in range(count):
        near = list(text)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(near))
            near[at:at + 1] = rng.choice([[f"x{rng.randrange(9000)}"], [], [near[at], "and"]])
        out.append(near)
    return out


def corpus(seed):
    rng, made = random.Random(seed), []
    for _ in range(25):
        made += family(rng, rng.randrange(1, 8), rng.choice([9, 14, 40, 120, 400]), 4)
    made += family(rng, 150, 60, 3)  # many copies about the limit, not all of one class
    common = [f"c{i}" for i in range(40)]
    made += [common + [f"y{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 12))] for _ in range(150)]
    made += [[w] for w in ("one", "two", "one", "One")] + [["a", "b"], ["A", "b"], [], []]
    rng.shuffle(made)
    return [(i, " ".join(t)) for i, t in enumerate(made)]


@pytest.mark.parametrize("hot, part, salt", [(64, 1_000_000, 2000), (2, 1500, 3), (0, 10 ** 6, 2000)])
def test_equals_all_pairs(spark, monkeypatch, hot, part, salt):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "DELETION_COST", 1)
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "SALT_SETS", salt)
    rows = corpus(11)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == plain(rows)


def test_dear_keys_are_left_out_and_made_up_for(spark, monkeypatch):
    """Texts of one template whose own words differ: most share the template's segments and are not near."""
    monkeypatch.setattr(jaccard, "HOT", 1)
    monkeypatch.setattr(jaccard, "DELETION_COST", 0)
    rng, rows = random.Random(2), []
    template = [f"c{i}" for i in range(60)]
    for i in range(120):
        own = [f"y{rng.randrange(10 ** 6)}" for _ in range(40)]
        rows.append(template + own)
        rows.append(template + own[:20] + ["z"] + own[21:])
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left = []
    real = jaccard._neighbours
    monkeypatch.setattr(jaccard, "_neighbours", lambda percent: left.append(percent) or real(percent))
    assert got(frame) == plain(rows) and left


def test_segments_agree():
    """Of any two sets that may link, some segment is equal at a common level; deletions name what is left."""
    rng, bands = np.random.default_rng(5), jaccard.Bands()
    for size in [1, 5, 9, 10, 19, 20, 77, 400, 3000]:
        whole = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
        for other in {len(whole) - k for k in (0, 1, 2, size // 20, size // 11)} - {0}:
            apart = jaccard.most_apart(len(whole), other, 90)
            gone = len(whole) - other
            if apart < gone:
                continue
            new = rng.integers(0, 2 ** 64, (apart - gone) // 2, dtype=np.uint64)
            less = np.unique(np.r_[rng.permutation(whole)[:other - len(new)], new])
            met = set(bands.of(len(whole))[1]) & set(bands.of(len(less))[1])
            assert any(set(jaccard.segment_keys(whole, k, bands.segments(k)).tolist())
                       & set(jaccard.segment_keys(less, k, bands.segments(k)).tolist()) for k in met)
    keys, fewer, _ = jaccard.segment_keys(whole, 3, 5, deletions=True)
    for i in (0, 7, len(whole) - 1):
        rest = jaccard.segment_keys(np.delete(whole, i), 3, 5)
        assert fewer[i] in rest and (rest != keys).sum() == 1


def test_edges(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs) == plain(rows) and got(nothing(spark)) == Counter()
    odd = docs.withColumn("node", docs["text"]).withColumn("key", docs["lang"]).withColumn("class", docs["size"])
    assert got(odd) == plain(rows)


def test_hot_rows(spark):
    """A third of all rows equal in key and text."""
    rows = [(5, "the same words in every one of these rows")] * 200 + [(i, f"row {i} has words of its own") for i in range(400)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)) == plain(rows)


def test_sql(spark):
    assert compare(spark, connect(SMALL), queries.op11_jaccard, queries.SQL["op11_jaccard"], SMALL)[1] == ""


def test_marks_miss_nothing(spark):
    rows = spark.range(-3000, 3000).select("id", F.xxhash64("id").alias("h"))
    some = rows.filter("id % 30 = 0").select("h")
    got = {r["id"]: r["held"] for r in marked(rows, "h", some, "held").collect()}
    assert len(got) == 6000 and all(got[i] for i in got if i % 30 == 0) and sum(got.values()) < 220
    assert not marked(rows, "h", some.limit(0), "held").filter("held").count()


def test_full_filters_lose_nothing(spark, monkeypatch):
    """Filters whose bits are all set hold back nothing, and sets that they mark for others' sake stay in."""
    monkeypatch.setattr(session, "MARKS", 64)
    rng = random.Random(12)
    rows = [" ".join(t) for _ in range(30) for t in family(rng, 4, 60, 3)]
    rows = list(enumerate(rows + rows[:40]))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain(rows)


def test_texts_without_candidates_do_not_move(spark, monkeypatch):
    """Only copied sets' keys and candidates' texts are let through to a shuffle."""
    rng, moved = random.Random(4), {}
    real = jaccard.marked
    monkeypatch.setattr(jaccard, "marked", lambda rows, hashed, some, flag: moved.setdefault(flag, real(rows, hashed, some, flag)))
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))) for i in range(400)]
    rows += [(400, rows[0][1] + " more"), (401, rows[1][1]), (402, "  ")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain(rows)
    assert {flag: frame.filter(flag).count() for flag, frame in moved.items()} == {"copied": 2, "held": 2}


def random_set(rng, size):
    return np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))


def test_sketches_rule_out_no_link():
    """Sketches differ in no more bits than their sets do in shingles, and in many if the sets are far apart."""
    rng = np.random.default_rng(3)

    def bits(a, b):
        one, other = (np.frombuffer(jaccard.sketch(x), np.uint64) for x in (a, b))
        words = min(len(one), len(other))
        return int(np.bitwise_count(jaccard.folded(one, words) ^ jaccard.folded(other, words)).sum())

    for size in [1, 2, 10, 63, 64, 65, 130, 700, 5000]:
        whole = random_set(rng, size)
        for gone, new in [(0, 0), (0, 1), (1, 0), (size // 20, size // 20), (0, size // 10), (size // 2, size // 3)]:
            other = np.unique(np.r_[rng.permutation(whole)[gone:], random_set(rng, new)])
            assert bits(whole, other) <= len(np.setxor1d(whole, other))
        if size >= 10:
            assert bits(whole, random_set(rng, size)) > jaccard.most_apart(size, size, 90)


@pytest.mark.parametrize("percent", [90, 40])
def test_near_partners_miss_no_link(percent):
    rng, sets = np.random.default_rng(8), []
    for size in [1, 3, 20, 60, 64, 66, 125, 130, 300]:
        whole = random_set(rng, size)
        sets += [whole, whole[:size - size // 30], np.unique(np.r_[whole, random_set(rng, 1 + size // 25)]), whole[size // 3:], random_set(rng, size)]
    sizes, sketches = np.array([len(x) for x in sets]), [np.frombuffer(jaccard.sketch(x), np.uint64) for x in sets]
    label, sides = rng.integers(0, 30, len(sets)), rng.integers(0, 2, len(sets))
    for side in (np.zeros(len(sets), np.int64), sides):
        near = jaccard.near_partners(label, side, sizes, sketches, percent)
        two = len(np.unique(side)) > 1
        linked = {x for i, a in enumerate(sets) for j, b in enumerate(sets)
                  if label[i] != label[j] and (not two or side[i] != side[j])
                  and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for x in (i, j)}
        assert linked and linked <= set(np.flatnonzero(near).tolist())
        assert near.sum() < len(sets)


def test_sets_that_only_share_keys_do_not_move(spark, monkeypatch):
    """Texts of one template share keys and are far apart: their sketches tell, and no text is let through to a shuffle."""
    rng, moved, places = random.Random(6), [], []
    real, placed = jaccard.marked, jaccard._places

    def seen(rows, hashed, some, flag):
        moved.append((flag, real(rows, hashed, some, flag)))
        return moved[-1][1]

    monkeypatch.setattr(jaccard, "marked", seen)
    monkeypatch.setattr(jaccard, "_places", lambda pairs: places.append(pairs) or placed(pairs))
    met, cut = [], jaccard.cut_lineage

    def kept(frame, label="cut"):
        out = cut(frame, label)
        if label == "jaccard-met":
            met.append(out)
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", kept)
    template = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(template + [f"y{rng.randrange(10 ** 6)}" for _ in range(40)])) for i in range(150)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain(rows)
    assert met[0].select("node").distinct().count() > 30 and places[0].count() == 0
    assert sum(frame.filter("held").count() for flag, frame in moved if flag == "held") == 0


def test_sets_move_once_to_each_hub(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_SETS", 2)
    rng = random.Random(5)
    base = sorted({rng.randrange(-2 ** 63, 2 ** 63) for _ in range(40)})
    held = {0: base, 1: base[1:], 2: base[:-1], 3: base[2:], 4: base[20:], 5: base[21:], 6: base[1:-1]}
    pairs = [(1, 0), (2, 0), (3, 0), (6, 0), (4, 0), (5, 4), (6, 3)]
    places = jaccard._places(spark.createDataFrame(pairs, "node long, hub long"))
    assert {r["node"]: r["salts"] for r in places.collect()} == {0: 3, 1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0}
    sets = spark.createDataFrame([(n, [x - 2 ** 64 if x >= 2 ** 63 else x for x in sorted(y % 2 ** 64 for y in s)]) for n, s in held.items()],
                                 "node long, shingles array<long>").join(places, "node").localCheckpoint()
    links = jaccard._near_hubs(sets, 90)
    assert {tuple(r) for r in links.collect()} == {(1, 0), (2, 0), (3, 0), (5, 4), (6, 0), (6, 3)}
    # Places come with the sets, so no join moves the sets before they are dealt to their hubs.
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[-1].count("Exchange") == 1
