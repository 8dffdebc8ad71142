"""The pipeline's stages, each against its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.edges import documents, nothing
from tests.llm.test_shingles import kept_by_all_pairs

SMALL = "/root/testdata/sf0.001"


def test_registered():
    queries = __spark_entry__.queries()
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {q.split("_")[0] for q in queries}
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def written(spark, frame, path):
    frame.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    steps = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        steps.append(written(spark, stage(spark, steps[-1], SMALL), tmp_path / name))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [s.collect() for s in steps]
    kept = {r["doc_id"] for r in rows[1]}
    wrong = sum((labels[i] == 1) != (i in kept) for i in labels)
    assert wrong <= 0.05 * len(labels) and 0 < len(kept) < len(rows[0])
    assert {r["doc_id"] for r in rows[2]} == {r["doc_id"] for r in rows[1] if any(c.isalpha() for c in r["text"])}
    given = sorted((r["doc_id"], r["text"]) for r in rows[2])
    assert Counter(r["doc_id"] for r in rows[3]) == Counter(given[i][0] for i in kept_by_all_pairs([t for _, t in given]))
    copies = Counter(r["doc_id"] for r in rows[4])
    assert set(copies) <= {r["doc_id"] for r in rows[3]} and max(copies.values()) <= 3
    words = sum(len(r["text"].encode().split()) for r in rows[3])
    assert abs(sum(len(r["text"].encode().split()) for r in rows[4]) - words) < 0.1 * words
    assert Counter(r["doc_id"] for r in rows[5]) == copies and all(r["lossless"] and r["ids"] for r in rows[5])


@pytest.mark.parametrize("make", [documents, nothing])
def test_edge_rows(spark, tmp_path, make):
    docs = written(spark, make(spark), tmp_path / "docs")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, SMALL), tmp_path / name)
    assert (docs.count() > 0) == (make is documents) and docs.filter(~F.col("lossless")).count() == 0
