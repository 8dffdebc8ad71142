"""Operators on Spark against brute force over whole small tables, and on edge rows."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import (components, ctw, editprint, language, licenses, mixing, quality, queries, resharding,
                         segmentation, simhash, topk)
from tessera.llm.texts import fold
from tests.llm.edges import documents, nothing, rows, words
from tests.llm.test_core import events, slow_fingerprint
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def corpus():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SMALL}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SMALL), queries.QUERIES[name], queries.SQL[name], SMALL)[1] == ""


def held(key, folds=5):
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds


def test_fold(spark):
    keys = [None, 0, 1, 17, -3, 10 ** 15]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", fold("k")).collect()
    assert {r[0]: r[1] for r in got} == {k: held(k) for k in keys}


# 1 ----------------------------------------------------------------------------------------------

def test_encode_edges(spark, docs):
    def ids(frame, apart=False):
        found = segmentation.encoded(frame, "doc_id", "text", decoded=not apart)
        found = segmentation.decoded(found, "_ids") if apart else found
        return found.select("doc_id", "text", "_ids", "_decoded").collect()

    got = ids(docs)
    assert len(got) == len(rows()) and all(r["text"] == r["_decoded"] for r in got)
    assert all((r["_ids"] is None) == (r["text"] is None) for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, ids(docs.repartition(7))))
    assert sorted(map(repr, got)) == sorted(map(repr, ids(docs, apart=True)))
    assert ids(nothing(spark)) == []


# 2 ----------------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    found = queries.op2_quality(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    tested = [r for r in found if r["held_out"]]
    assert len(tested) > 50 and all(r["held_out"] == (held(r["doc_id"]) == 0) for r in found)
    assert sum(r["predicted"] == r["quality"] for r in tested) / len(tested) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (10, 0), (2, 1), (99, 1), (6, None), (None, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        score = quality.scorer(quality.train(docs, some, F.lit(True)))
        got = [r[0] for r in docs.select(score("text")).collect()]
        assert len(got) == len(rows()) and all(0 <= s <= 1 for s in got)
    assert nothing(spark).select(score("text")).collect() == []


# 3 ----------------------------------------------------------------------------------------------

def test_ctw_blocks_and_base(spark, corpus, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 60_000)  # many blocks
    monkeypatch.setattr(ctw, "SALT_BLOCKS", 3)
    got = {r["doc_id"]: r for r in queries.op3_ctw(spark, SMALL).collect()}
    counts = Counter(w for i, t, *_ in corpus if held(i) != 1 for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    monkeypatch.undo()
    whole = {r["doc_id"]: r for r in queries.op3_ctw(spark, SMALL).collect()}
    for i, text, *_ in corpus:
        tokens = [*words(text), b""]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held(i) == 1, len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r["score"] == pytest.approx(whole[i]["score"], rel=1e-6)


def test_ctw_probabilities_add_up(spark):
    """Over all next bytes of a context the model's probabilities add up to one."""
    train = ["abab abba", "baab", None, ""]
    tails = [bytes([b]).decode("latin-1") for b in range(128) if not 65 <= b <= 90]
    frame = spark.createDataFrame([(i, t, True) for i, t in enumerate(train)] + [
        (100 + i, "ab" + t, False) for i, t in enumerate(tails)], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in ctw.score(frame, F.col("learn")).collect()}
    assert all(s < 0 for s in got.values()) and sum(10 ** s for s in got.values()) < 1
    assert got[100 + tails.index("a")] > got[100 + tails.index("z")]
    assert len(events("ab")) == 3


def test_ctw_edges(spark, docs):
    for learn in (F.lit(True), F.lit(False), F.col("doc_id") > 3):
        got = ctw.score(docs, learn).collect()
        assert len(got) == len(rows()) and all(r["score"] < 0 and r["base_score"] <= 0 for r in got)
        alike = defaultdict(set)
        for r in got:
            alike[r["n_bytes"] == 0].add(r["score"])
        assert len(alike[True]) == 1  # null and empty texts: the end alone
    nobody = ctw.score(docs, F.lit(False)).filter("doc_id = 12").first()
    assert nobody["score"] == pytest.approx(-16 * math.log10(2)) and nobody["train_tokens"] == 0
    assert ctw.score(nothing(spark), F.lit(True)).collect() == []


# 4 ----------------------------------------------------------------------------------------------

def place(docs, shards=24):
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(20))
    return resharding.reshard(resharding.measured(docs, "doc_id", "text", old).cache(), shards, "doc_id")


def check_plan(plan, texts, shards):
    assert len(plan) == len(texts)
    assert sorted((r["size"], r["text_crc32"]) for r in plan) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    by_shard, sizes = defaultdict(list), Counter()
    for r in plan:
        by_shard[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(by_shard) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    return sizes


def test_resharding(spark, corpus):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = place(frame).collect()
    sizes = check_plan(plan, [t for _, t, *_ in corpus], 24)
    mean, largest = sum(sizes.values()) / 24, max(r["size"] for r in plan)
    assert all(abs(sizes[s] - mean) <= largest for s in range(24))
    old = Counter()
    for r in plan:
        old[r["old_shard"]] += r["size"]
    least = sum(max(0, old[s] - mean) for s in old)
    moved = sum(r["size"] for r in plan if r["moved"])
    assert least - 24 * largest <= moved <= least + 24 * largest
    assert sorted(map(repr, plan)) == sorted(map(repr, place(frame.repartition(5)).collect()))


def test_resharding_hot_text(spark, monkeypatch):
    monkeypatch.setattr(resharding, "HEAVY", 50)
    monkeypatch.setattr(resharding, "ROWS_PER_SALT", 100)
    frame = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, "copied text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    texts = [r["text"] for r in frame.collect()]
    sizes = check_plan(place(frame, 6).collect(), texts, 6)
    assert max(sizes.values()) - min(sizes.values()) <= 6 * 20


def test_resharding_edges(spark, docs):
    check_plan(place(docs).collect(), [r[1] for r in rows()], 24)
    assert place(nothing(spark)).collect() == []


def test_rewrite_touches_changed_shards_only(spark, docs, tmp_path):
    old = F.when(F.coalesce(F.col("doc_id"), F.lit(0)) == 6, 0).otherwise(1)
    held_now = resharding.measured(docs, "doc_id", "text", old).cache()
    totals = {r[0]: r[1] for r in held_now.groupBy("old_shard").agg(F.sum("size")).collect()}
    plan = resharding.reshard(held_now, [totals[0], totals[1] // 2, totals[1]], "doc_id").cache()
    touched = resharding.rewrite(docs, plan, "doc_id", "text", str(tmp_path / "new"))
    assert touched == [1, 2]
    files = spark.read.parquet(str(tmp_path / "new"))
    want = sorted(repr(r) for r in docs.filter("doc_id is null or doc_id <> 6").collect())
    assert sorted(repr(r) for r in files.select(*docs.columns).collect()) == want


# 5 ----------------------------------------------------------------------------------------------

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op5_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in tested) / len(tested) > 0.93
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark, docs):
    model = language.train(docs, F.lit(True))
    got = [(r["text"], r["_lang_pred"], r["_lang_score"]) for r in language.predicted(docs, model).collect()]
    assert len(got) == len(rows()) and set(model.languages) == {"de", "en", "fr"}  # German by one long text
    for text, found, score in got:
        lettered = text is not None and any(c.isalpha() for c in text)
        assert (found in model.languages) if lettered else (found, score) == ("und", 0.0)
    assert language.train(nothing(spark), F.lit(True)) is None
    assert {r["_lang_pred"] for r in language.predicted(docs, None).collect()} == {"und"}
    assert language.predicted(nothing(spark), model).collect() == []


# 6 ----------------------------------------------------------------------------------------------

def even_shares(sizes, most=3):
    """Targets by resharing the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return share | capped
        capped |= {s: most * sizes[s] for s in above}


def check_mix(got, sources):
    sizes = Counter()
    for r in got:
        sizes[sources[r["doc_id"]] if r["doc_id"] in sources else None] += r["size"]
    targets, taken = even_shares(sizes), Counter()
    for r in got:
        source = sources[r["doc_id"]]
        taken[source] += r["taken"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        assert r["taken"] >= r["size"] * int(targets[source] / max(1, sizes[source]))  # epochs come first
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= max(r["size"] for r in got if sources[r["doc_id"]] == source)


def mixed(frame):
    return mixing.mixed(frame).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                                      F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def test_mixing(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)  # many ranges
    got = queries.op6_mix(spark, SMALL).collect()
    check_mix(got, {i: s for i, _, _, s in corpus})
    monkeypatch.undo()
    assert sorted(map(repr, got)) == sorted(map(repr, queries.op6_mix(spark, SMALL).collect()))


def test_mixing_edges(spark, docs):
    got = mixed(docs.filter("doc_id is not null")).collect()
    check_mix(got, {r[0]: r[3] for r in rows() if r[0] is not None})
    assert mixed(docs).count() == len(rows()) and mixed(nothing(spark)).collect() == []
    empty = docs.filter("text is null or text = ''")
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixed(empty).collect())
    copies = mixing.mixture(docs)
    want = sum(r["taken"] // max(1, r["size"]) for r in mixed(docs).collect())
    assert copies.columns == docs.columns and copies.count() == want


def test_sampling_prefers_quality():
    """Keys are exponential with the quality as rate: the better of two rows is first in proportion."""
    rng = np.random.default_rng(0)
    u = rng.random((20000, 2))
    assert abs((-np.log(u[:, 0]) / 0.75 < -np.log(u[:, 1]) / 0.25).mean() - 0.75) < 0.02


# 7 ----------------------------------------------------------------------------------------------

def classes_of(texts, width=4, distance=4):
    prints = np.array([slow_fingerprint(t, width) for _, t in texts], dtype=np.int64).view(np.uint64)
    label, todo = [-1] * len(texts), list(range(len(texts)))
    for i in todo:
        if label[i] < 0:
            label[i], stack = i, [i]
            while stack:
                near = np.bitwise_count(prints ^ prints[stack.pop()]) <= distance
                for j in np.flatnonzero(near).tolist():
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    least = defaultdict(list)
    for (key, _), l in zip(texts, label):
        if key is not None:
            least[l].append(key)
    return [(k, f"{int(p):016x}", min(least[l], default=None)) for (k, _), p, l in zip(texts, prints, label)]


def test_near_duplicates(spark, corpus):
    got = queries.op7_simhash(spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(classes_of([(i, t) for i, t, *_ in corpus]))


def test_near_duplicates_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 40)
    base = [f"word{i % 37} and{i % 11} more{i}" for i in range(400)]
    texts = [(i, " ".join(base[:300 + i % 7] + [f"tail{i % 13}"])) for i in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(frame).collect())) == sorted(classes_of(texts))


def test_near_duplicates_edges(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert Counter(map(tuple, got)) == Counter(classes_of([r[:2] for r in rows()]))
    kept = simhash.one_of_each(docs)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and ids == Counter({c for _, _, c in classes_of([r[:2] for r in rows()])})
    assert simhash.near_duplicates(nothing(spark)).collect() == [] and simhash.one_of_each(nothing(spark)).collect() == []


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)],
                                   [(int(a), int(b)) for a, b in np.random.default_rng(5).integers(0, 90, (70, 2))]])
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(n, n) == r for n, r in root.items())


# 8 ----------------------------------------------------------------------------------------------

def test_top_k_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    vectors = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 8]) for i in rng.permutation(150)]
    odd = [(200, None), (300, [1.0, None]), (400, [float("nan")] * 6), (500, [float("inf")] * 6), (None, [0.1] * 6), (600, []),
           (700, [1.0, 2.0]), (0, [0.5] * 6)]
    frame = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    got = topk.top_k(topk.scaled(frame, "vec_id", "embedding"), F.col("id") % 100 == 0, 10).collect()
    part = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors + odd
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in [p for p in part if p[0] % 100 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in part if i != q[0] and len(v) == len(q[1]))
        want += [(q[0], -s, i) for s, i in scored]
    for query in {r["query_id"] for r in got}:
        best = [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == query]
        every = sorted(((-s, i) for q, s, i in want if q == query))
        assert best == [(-s, i) for s, i in every[:10]]
    assert {r["query_id"] for r in got} == {q for q, *_ in want}


# 9 ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("text, found", [
    (None, []), ("", []), ("Nothing to see here.", []), ("Released under the MIT License.", ["MIT"]),
    ("thou thou\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("Licensed under CC BY-NC 4.0.\nIng Ing Ing", ["CC-BY-NC-4.0"]), ("All rights reserved.", ["all-rights-reserved"]),
    ("Permission is hereby granted, free of charge, to any person obtaining\na copy of this software to deal. The above "
     "copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", "
     "WITHOUT WARRANTY OF ANY KIND.", ["MIT"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name "
     "of the owner may be used to endorse or promote products.", ["BSD-3-Clause"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted.", ["BSD-2-Clause"]),
    ("MIT License first? Distributed under the MIT licence. SPDX-License-Identifier: MIT", ["MIT"]),
    ("Our licence is not known to anybody.", [])])
def test_licenses(spark, text, found):
    row = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["_licenses"] == found
    assert row["_unknown"] == (1 if text and "not known" in text else row["_unknown"])


def test_licenses_edges(spark, docs):
    got = licenses.scanned(docs).select("doc_id", "_licenses").collect()
    assert len(got) == len(rows()) and {r["doc_id"]: r["_licenses"] for r in got}[-11] == ["Apache-2.0"]
    assert licenses.scanned(nothing(spark)).collect() == []


# 10 ---------------------------------------------------------------------------------------------

def check_compared(got, given):
    order = sorted(given, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    texts = [t or "" for _, t in order]
    followers = texts[1:] + texts[:1]
    prints, edited, changed = editprint.prints(texts, followers)
    after = editprint.prints(followers)[0]
    want = [(k, len(t), sha256(c.encode()).hexdigest(), p.decode(), e.decode(), editprint.likeness(p, e), editprint.likeness(p, a))
            for (k, _), t, c, p, e, a in zip(order, texts, changed, prints, edited, after)]
    assert Counter(tuple(r)[:7] for r in got) == Counter(want)


def test_edited_texts(spark, corpus, monkeypatch):
    monkeypatch.setattr(editprint, "BUCKET_BYTES", 30_000)  # many buckets
    got = queries.op10_edit_prints(spark, SMALL).collect()
    check_compared(got, [(i, t) for i, t, *_ in corpus])
    assert np.mean([r["near_edited"] for r in got if r["n_chars"] > 300]) > 0.6
    assert np.median([r["near_next"] for r in got]) < 0.1


def test_edited_texts_edges(spark, docs):
    check_compared(editprint.compared(docs).collect(), [r[:2] for r in rows()])
    assert editprint.compared(nothing(spark)).collect() == []


def test_near_pairs(spark):
    rng = np.random.default_rng(0)
    texts = []
    for i in range(40):
        text = "".join(rng.choice(list("abcdefgh "), 1500))
        texts += [(3 * i, text), (3 * i + 1, text[:1400] + "changed" + text[1407:]), (3 * i + 2, text)]
    prints = editprint.fingerprinted(spark.createDataFrame(texts, "doc_id long, text string"), "text")
    held_by = {r["doc_id"]: r["_print"] for r in prints.collect()}
    pairs = {(r["first"], r["other"]) for r in editprint.near_pairs(prints, "doc_id").collect()}
    # Texts of equal fingerprints are one class and no pair.
    assert pairs == {(3 * i, 3 * i + 1) for i in range(40) if held_by[3 * i] != held_by[3 * i + 1]} and len(pairs) > 10
    assert all(held_by[3 * i] == held_by[3 * i + 2] for i in range(40))
