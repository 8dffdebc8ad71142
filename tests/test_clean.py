"""Cleaning, encoding and the four recipes."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.rows import dict_text, key_value_text
from tessera.operators import checks, clean, presets


def rows(df, key="idx"):
    return [tuple(r) for r in df.orderBy(key).collect()]


def test_drop(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.drop_columns(df, ["a", "zz"]).columns == ["b"]
    with pytest.raises(ValueError, match="zz"):
        clean.drop_columns(df, ["zz"], strict=True)


def test_null_handling(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "?", 2.0), (3, "b", float("nan")), (4, None, 1.0)],
                               "idx int, s string, x double")
    assert rows(clean.null_sentinel(df).select("idx", "s")) == [(1, "a"), (2, None), (3, "b"), (4, None)]
    assert rows(clean.drop_incomplete(clean.null_sentinel(df))) == [(1, "a", 1.0)]
    assert clean.completeness(df).first().asDict() == {"before": 4, "kept": 2, "dropped": 2}


def test_numbers(spark):
    df = spark.createDataFrame([(1, "1.5"), (2, " 2 "), (3, "x"), (4, "1d"), (5, None)], "idx int, s string")
    assert rows(clean.coerce_numeric(df)) == [(1, 1.5), (2, 2.0), (3, None), (4, None), (5, None)]
    whole = spark.createDataFrame([(1, "7", 2.9)], "idx int, s string, x double")
    assert rows(clean.strict_bigint(whole)) == [(1, 7, 2)]
    with pytest.raises(Exception, match="not an integer"):
        clean.strict_bigint(df).collect()


def test_learned_codes(spark):
    values = [(i, v) for i, v in enumerate(["b", "a", None, "ä", "B", "b"])]
    df = spark.createDataFrame(values, "idx int, c string")
    order = {v: i for i, v in enumerate(sorted({v for _, v in values if v is not None}))}
    assert rows(clean.encode_learned(df, ["c"])) == [(i, order.get(v)) for i, v in values]


def test_learned_codes_beyond_inline(spark):
    df = spark.range(3000).select(F.col("id").alias("idx"), F.concat(F.lit("v"), F.col("id") % 500).alias("c"))
    order = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(500)))}
    assert rows(clean.encode_learned(df, ["c"])) == [(i, order[f"v{i % 500}"]) for i in range(3000)]


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "idx int, c string")
    got = clean.one_hot(df, ["c"])
    assert got.columns == ["idx", "c_b", "c_c"]
    assert rows(got) == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    with pytest.raises(ValueError, match="categories"):
        clean.one_hot(df, ["c"], limit=2)


def test_zscore(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "idx int, x double, k double")
    assert rows(clean.zscore(df, ["x", "k"])) == [(1, -1.0, 0.0), (2, 1.0, 0.0)]


def test_masks(spark):
    names = clean.mask_names(["idx", "Age", "Sex", "Survived"])
    assert names == {"Age": "x0", "Sex": "x1", "Survived": "x2"}
    imp = spark.createDataFrame([("Age", 0.6, 0), ("Sex", 0.4, 1)], "feature string, importance double, position int")
    assert [r["feature"] for r in clean.mask_importances(imp, names).orderBy("position").collect()] == ["x0", "x1"]


def test_titanic(spark):
    df = spark.createDataFrame(
        [(0, "7", "0", "3", "A, b", "male", "22", None, "S"), (1, "8", "1", "1", "C", "female", "38.5", "C85", "C"),
         (2, "9", "1", "1", "D", "female", None, "C85", "Q"), (3, "10", "1", "2", "E", "other", "4", "", "Q")],
        "idx long, PassengerId string, Survived string, Pclass string, Name string, Sex string, Age string, "
        "Cabin string, Embarked string")
    got = presets.titanic(df)
    assert got.columns == ["idx", "Survived", "Pclass", "Sex", "Age", "Embarked"]
    assert rows(got) == [(0, 0.0, 3.0, 0, 22.0, 0), (1, 1.0, 1.0, 1, 38.5, 1)]


def test_loan(spark):
    df = spark.createDataFrame(
        [(0, "1", " Graduate", " No", "5", " Approved"), (1, "2", " Not Graduate", " Yes", "6", " Rejected"),
         (2, "3", " Graduate", None, "7", " Rejected")],
        "idx long, loan_id string, ` education` string, ` self_employed` string, ` term` string, ` loan_status` string")
    got = presets.loan(df)
    assert got.columns == ["idx", "term", "loan_status", "education_Not Graduate", "self_employed_Yes"]
    assert rows(got) == [(0, 5, 1, 0, 0), (1, 6, 0, 1, 1)]


def test_mushroom(spark):
    df = spark.createDataFrame(
        [(0, "e", "x", "t", "c"), (1, "p", "b", "f", "?"), (2, "p", "s", "f", "b"), (3, "e", "b", "t", "c")],
        "idx long, class string, `cap-shape` string, bruises string, `stalk-root` string")
    # learned codes count the value of the row that is dropped later
    assert rows(presets.mushroom(df)) == [(0, 0, 2, 1, 1), (2, 1, 1, 0, 0), (3, 0, 0, 1, 1)]
    assert rows(presets.mushroom_fixed(df)) == [(0, 0, 2, 1, 1), (2, 1, 5, 0, 0), (3, 0, 0, 1, 1)]


def test_row_text(spark):
    df = spark.createDataFrame([(1, 3.0, 0.00012, "a b", "x: y", None, 1e22)],
                               "idx int, n double, s double, t string, `odd key` string, g double, big double")
    text = df.select(key_value_text(df, df.columns)).first()[0]
    assert text == ('idx: 1\nn: 3\ns: 0.00012\nt: a b\n"odd key": "x: y"\ng: null\n'
                    "big: 10000000000000000000000")
    assert df.select(dict_text(["idx", "t"])).first()[0] == '{"idx":1,"t":"a b"}'


def test_dataset_contract(spark):
    good = spark.createDataFrame([(1, 0), (2, 1)], "idx long, y int")
    checks.require_dataset(good, "y", [0, 1])
    for bad in ([(1, 0), (1, 1)], [(1, None), (2, 1)], [(1, 2), (2, 1)]):
        with pytest.raises(ValueError, match="contract"):
            checks.require_dataset(spark.createDataFrame(bad, "idx long, y int"), "y", [0, 1])
    with pytest.raises(ValueError, match="2 entries"):
        checks.dataset_contract(good, "y", [0, 1, 2])


def test_score_contract(spark):
    df = spark.createDataFrame(
        [(1, {"faithfulness": 4.5, "consistency": 4.0, "coherence": 4.75}), (2, {"faithfulness": 5.5}),
         (3, {"faithfulness": 4.1, "consistency": 4.0, "coherence": 1.0})], "idx long, metrics map<string,double>")
    assert checks.score_contract(df).first().asDict() == {
        "rows": 3, "incomplete": 1, "out_of_range": 1, "off_step": 1}


def test_one_hot_vector(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None), (4, None, "x"), (5, "c", "y")],
                               "idx int, c string, d string")
    wide = clean.one_hot(df, ["c", "d"])
    got = {r["idx"]: r["one_hot"] for r in clean.one_hot_vector(df, ["c", "d"]).collect()}
    for row in wide.collect():
        values = list(row)[1:]
        found = got[row["idx"]]
        assert found["size"] == len(values) == 3
        assert dict(zip(found["indices"], found["values"])) == {i: 1.0 for i, v in enumerate(values) if v}
