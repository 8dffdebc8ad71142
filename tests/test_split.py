"""Splits, folds, ranks and trials."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking, split, trials


def md5(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 4, 5, 161, 20000])
def test_exact_split(spark, n):
    df = split.exact_split(spark.range(n).withColumnRenamed("id", "idx"))
    got = {r["idx"] for r in df.filter("split = 'test'").collect()}
    assert got == set(sorted(range(n), key=md5)[:math.ceil(0.2 * n)])
    assert df.filter("split = 'train'").count() == n - len(got)


def test_split_does_not_depend_on_partitions(spark):
    base = spark.range(3000).withColumnRenamed("id", "idx")
    a = split.exact_split(base.repartition(7)).filter("split = 'test'").select("idx")
    b = split.exact_split(base.coalesce(1)).filter("split = 'test'").select("idx")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_hashed_split_is_near(spark):
    df = split.hashed_split(spark.range(20000).withColumnRenamed("id", "idx"))
    assert abs(df.filter("split = 'test'").count() / 20000 - 0.2) < 0.02


def test_folds_are_even_per_class(spark):
    # one class holds most rows
    df = spark.range(5003).select(F.col("id").alias("idx"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    counts = split.stratified_folds(df, "y").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_cut_of_a_large_bucket(spark):
    kept, ranking.ROWS_PER_BUCKET = ranking.ROWS_PER_BUCKET, 0
    try:
        cut = ranking.hash_cut(spark.range(3000), "id", 42, 700)
    finally:
        ranking.ROWS_PER_BUCKET = kept
    assert cut[1] == sorted(range(3000), key=md5)[699]


def test_hash_rank_with_many_buckets(spark):
    df = spark.range(4000).withColumnRenamed("id", "idx")
    got = {r["idx"]: r["rank"] for r in ranking.hash_rank(df, "idx", 42, rows=10**9).collect()}
    assert got == {k: i for i, k in enumerate(sorted(range(4000), key=md5))}
    assert ranking.bucket_digits(10) == 1 and ranking.bucket_digits(10**12) == 7 and ranking.bucket_digits(10**15) == 9


def test_null_class_keeps_its_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "idx long, c string")
    assert ranking.hash_rank(df, "idx", 42, by=["c"]).count() == 3


def test_example_sets(spark):
    sets = split.example_sets(spark.range(23).withColumnRenamed("id", "idx"), 10).collect()
    order = sorted(range(23), key=md5)
    assert {(r["agent"], r["pos"]): r["idx"] for r in sets} == {(i // 10, i % 10): k for i, k in enumerate(order)}


def test_trials(spark):
    space = {"lr": {"distribution": "log_uniform_values", "min": 0.005, "max": 0.3},
             "depth": {"distribution": "int_uniform", "min": 3, "max": 8},
             "sub": {"distribution": "uniform", "min": 0.6, "max": 1.0},
             "mcw": {"values": [1, 3, 5]}, "seed": {"value": 42}}
    rows = trials.sample_trials(spark.range(500).withColumnRenamed("id", "trial"), space).collect()
    assert all(0.005 <= r["lr"] <= 0.3 and 0.6 <= r["sub"] <= 1 and r["seed"] == 42 for r in rows)
    assert {r["depth"] for r in rows} == {3, 4, 5, 6, 7, 8} and {r["mcw"] for r in rows} == {1, 3, 5}
    logs = sorted(math.log(r["lr"]) for r in rows)
    assert abs(logs[250] - (math.log(0.005) + math.log(0.3)) / 2) < 0.4
    with pytest.raises(ValueError, match="unknown distribution"):
        trials.draw("x", {"distribution": "normal", "min": 0, "max": 1}, F.lit(1))


def test_clean_params(spark):
    raw = {"_wandb": "x", "wandb": "y", "max_depth": "5", "n_estimators": "120.9", "learning_rate": '{"value": 0.1}',
           "subsample": "1e-1", "booster": "gbtree", "random_state": '{"value": "42"}', "other": "007",
           "nested": '{"a": 1}'}
    df = spark.createDataFrame([(1, raw)], "trial long, params map<string,string>")
    assert trials.clean_params(df).first()["params"] == {
        "max_depth": "5", "n_estimators": "120", "learning_rate": "0.1", "subsample": "0.1", "booster": "gbtree",
        "random_state": "42", "other": "7", "nested": '{"a": 1}'}
    typed = trials.typed_params(trials.clean_params(df), {"max_depth": "int", "learning_rate": "double"}).first()
    assert (typed["max_depth"], typed["learning_rate"]) == (5, 0.1)


def test_scratch_removes_its_intermediates(spark):
    import os

    from tessera.session import cut_lineage, scratch
    kept = cut_lineage(spark.range(3))
    with scratch(spark) as folder:
        inner = cut_lineage(spark.range(5), "inner")
        assert inner.count() == 5 and len(os.listdir(folder.removeprefix("file:"))) == 1
    assert not os.path.exists(folder.removeprefix("file:")) and kept.count() == 3
