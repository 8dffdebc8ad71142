"""Repeated rows in the mix: the target is met although a large share of a source is one row again and again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tests.llm.test_operators import even_shares


def repeated():
    made = [(1, "the same five words here", "a")] * 600 + [(None, "a text without key", "b")] * 300
    made += [(i, " ".join(["w%d" % (i % 7)] * (1 + i % 5)), "ab"[i % 2]) for i in range(100, 500)] + [(2, "", "b")] * 50
    return made


@pytest.mark.parametrize("range_rows", [mixing.RANGE_ROWS, 4])
@pytest.mark.parametrize("seed", ["mix", "x", "y", "z"])
def test_targets_are_met(spark, monkeypatch, seed, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    docs = spark.createDataFrame(repeated(), "doc_id long, text string, source string").repartition(7)
    got = [(s, n, c) for s, n, c in mixing.mixed(docs, seed=seed).select("_source", "_size", "_copies").collect()]
    sizes, taken = Counter(), Counter()
    for source, size, copies in got:
        sizes[source] += size
        taken[source] += size * copies
    targets = even_shares(sizes)
    assert len(got) == len(repeated()) and max(c for *_, c in got) <= 3
    assert all(abs(taken[s] - targets[s]) <= 5 for s in sizes)  # within the longest text


def test_mixture_agrees(spark):
    docs = spark.createDataFrame(repeated(), "doc_id long, text string, source string")
    plan = mixing.mixed(docs).groupBy("doc_id", "_size").agg(F.sum("_copies").alias("n")).filter("n > 0").collect()
    made = mixing.mixture(docs)
    assert made.columns == docs.columns
    found = Counter((r["doc_id"], len((r["text"] or "").split())) for r in made.collect())
    assert found == Counter({(r["doc_id"], r["_size"]): r["n"] for r in plan})
