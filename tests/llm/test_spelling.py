"""Spelling variants: the index search against all pairs, whole results against a plain version."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import queries, spelling
from tests.llm.edges import documents, nothing
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    """word -> (form, root, n, n_near, form_n) by comparing all pairs."""
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            count[word] += 1
    held = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    out = {}
    for word, n in held.items():
        near = sorted((v for v in held if one_edit(word, v)), key=lambda v: (-held[v], v))
        form = near[0] if near and held[near[0]] >= 10 * n else None
        out[word] = [form, None, n, len(near), held.get(form)]
    for word, row in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def got(frame):
    rows = spelling.variants(frame).collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "etaoinshr"])
def test_search_equals_all_pairs(alphabet):
    rng = random.Random(3)
    for _ in range(15):
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 11))) for _ in range(90)})
        words += sorted({w[:3] + w[4:] for w in words[::4] if len(w) > 7} - set(words))
        indexed = np.array([rng.random() < 0.7 for _ in words])
        for ends in (False, True):
            one, other = spelling.near_words(words, indexed, ends)
            found = set(zip(one.tolist(), other.tolist()))
            for i, a in enumerate(words):
                for j, b in enumerate(words):
                    cut = len(a) // 2
                    same = b.endswith(a[cut:]) if ends else b.startswith(a[:cut])
                    if indexed[j] and same and one_edit(a, b):
                        assert (i, j) in found
            assert all(indexed[j] and one_edit(words[i], words[j]) for i, j in found)


def test_suffixes_in_order():
    rng = random.Random(4)
    for size in (1, 2, 30, 400):
        text = np.array([rng.randrange(3) for _ in range(size)], np.uint8)
        want = sorted(range(size), key=lambda i: bytes(text[i:]))
        assert spelling.suffix_array(text).tolist() == want


def test_equals_plain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    want = plain(rows)
    assert got(docs) == want and any(r[3] for r in want.values())


@pytest.mark.parametrize("shard_words", [4, 60])  # beginnings and ends cut into parts; many tasks
def test_chains_and_hot_beginnings(spark, monkeypatch, shard_words):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    rng, texts = random.Random(7), []
    for k in range(60):
        base = "abcde" + "".join(rng.choice("xyzé") for _ in range(rng.randrange(3, 7)))
        texts += [base] * 250 + [base + "q"] * 24 + [base[:4] + base[5:]] * 22 + [base + "qq"] * 2 + [base[:-1] + "Q"] * 3
    rng.shuffle(texts)
    rows = [(i if i % 9 else None, " ".join(texts[at:at + 7])) for i, at in enumerate(range(0, len(texts), 7))]
    want = plain(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want
    assert any(want[r[1]][2] >= 100 * r[2] and r[0] != r[1] for r in want.values())  # chains of two steps


def test_edges(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs) == plain(rows) and got(nothing(spark)) == {}
    odd = docs.withColumn("word", docs["text"]).withColumn("n", docs["size"]).withColumn("key", docs["lang"])
    assert got(odd) == plain(rows)


def test_sql(spark):
    assert compare(spark, connect(SMALL), queries.op13_spelling, queries.SQL["op13_spelling"], SMALL)[1] == ""
