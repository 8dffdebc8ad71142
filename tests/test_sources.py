"""Files in and out."""

import json
import os

import pandas as pd
import pytest

from tessera.operators import requests
from tessera.config import ModelSpec
from tessera.plans.run import mask  # noqa: F401  (imports the whole job module)
from tessera.session import cut_lineage, shared_dir
from tessera.sources import explain_log, jsonl, tables

CSV = '''PassengerId,Survived,Name,Age,Cabin
710,1,"Moubarek, Master. Halim (""William"")",,
440,0,"Kvillner, Mr.
Johan",31.0,NA
841,0,Alhomaki,20.5,C85
'''


@pytest.mark.parametrize("multiline", [True])
def test_csv_matches_pandas(spark, tmp_path, multiline):
    path = tmp_path / "small.csv"
    path.write_text(CSV)
    got = tables.read_csv(spark, str(path), multiline=multiline).orderBy("idx").toPandas()
    want = pd.read_csv(path, dtype=str)
    assert got["idx"].tolist() == [0, 1, 2]
    for c in want.columns:
        assert [None if pd.isna(v) else v for v in got[c]] == [None if pd.isna(v) else v for v in want[c]]
    with pytest.raises(ValueError, match="csv"):
        tables.read_csv(spark, "x.parquet")


def test_csv_keys_run_on_over_blocks_and_files(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for f in range(3):
        rows = "".join(f"{f * 1000 + i}\n" for i in range(1000))
        (folder / f"part-{f}.csv").write_text("v\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = tables.read_csv(spark, str(folder), multiline=False)
        assert got.rdd.getNumPartitions() > 3
        assert got.filter("idx != cast(v as bigint)").count() == 0 and got.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_attributions_need_idx(spark, tmp_path):
    df = spark.createDataFrame([(3, 0.5), (1, -0.25)], "idx long, Age double")
    for name in ("a.csv", "a.parquet"):
        tables.write_attributions(df, str(tmp_path / name))
        got = tables.read_attributions(spark, str(tmp_path / name))
        assert {tuple(r) for r in got.collect()} == {(3, 0.5), (1, -0.25)}
    with pytest.raises(KeyError, match="idx"):
        tables.write_attributions(df.drop("idx"), str(tmp_path / "b.csv"))


def test_explain_log(spark, tmp_path):
    log = {"dataset_path": "d.csv", "feature_importances": {"Age": 0.75, "Sex": 0.25}, "train_data_idx": [5, 0],
           "test_data_idx": [3], "train_predictions": [1, 0], "test_predictions": [1]}
    (tmp_path / "log.json").write_text(json.dumps(log, indent=4))
    logs = explain_log.read_json_log(spark, str(tmp_path / "log.json"))
    assert {tuple(r) for r in explain_log.log_predictions(logs).collect()} == {
        (5, "train", 1), (0, "train", 0), (3, "test", 1)}
    imp = explain_log.log_importances(logs).orderBy("position").collect()
    assert [(r["feature"], r["importance"]) for r in imp] == [("Age", 0.75), ("Sex", 0.25)]


def test_requests_are_json_lines(spark, tmp_path):
    model = ModelSpec("m", 0.6, 4096)
    df = spark.createDataFrame([(7, 'say "hi"\nπ')], "idx long, prompt string")
    key = requests.reasoning_id(df.idx)
    jsonl.write_requests(df.select(requests.body_envelope(key, df.prompt, model).alias("request")), str(tmp_path / "r"))
    lines = [line for f in (tmp_path / "r").glob("part-*") for line in f.read_text().splitlines()]
    assert [json.loads(line) for line in lines] == [{"custom_id": "reasoning_batch-7", "body": {
        "model": "m", "messages": [{"role": "user", "content": 'say "hi"\nπ'}], "max_tokens": 4096, "temperature": 0.6}}]


def test_newest_file_of_a_run(spark, tmp_path):
    for i, run in enumerate(["titanic_zero-shot_100", "titanic_zero-shot_200", "titanic_zero-shot-cot_300"]):
        folder = tmp_path / run / "x"
        folder.mkdir(parents=True)
        (folder / "predictions.jsonl").write_text("{}")
        (folder / "other.jsonl").write_text("{}")
        os.utime(folder / "predictions.jsonl", (1000 + i, 1000 + i))
    assert "titanic_zero-shot_200/x/predictions.jsonl" in jsonl.newest_file(spark, str(tmp_path), "titanic_zero-shot")
    with pytest.raises(ValueError, match="no output file"):
        jsonl.newest_file(spark, str(tmp_path), "titanic_zero")


def test_run_documents(spark, tmp_path):
    def score(x):
        return {"accuracy": x, "macro_f1_score": x}
    doc = {"zero_shot_baseline": {"xgboost": score(0.7), "zero-shot-prompting": score(0.6)},
           "zero_shot_cot_ablation": {"xgboost": score(0.7), "zero-shot-cot": score(0.5)},
           "reasoning": {"3": "because"}, "cot": {"xgboost": score(0.7), "guided-few-shot": score(0.8)},
           "llm_as_judge": {"3": {"faithfulness": 4.5, "consistency": 4.0, "coherence": 4.75}}}
    (tmp_path / "loan_unmasked.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "loan_masked.json").write_text(json.dumps(doc))
    runs = jsonl.read_runs(spark, str(tmp_path))
    got = {(r["masked"], r["strategy"]): r["macro_f1"] for r in jsonl.run_scores(runs, model="xgboost").collect()}
    assert len(got) == 8 and got[(True, "guided-few-shot")] == 0.8 and got[(False, "zero-shot-prompting")] == 0.6
    judged = jsonl.run_judgements(runs).collect()
    assert len(judged) == 1 and judged[0]["metrics"]["coherence"] == 4.75


def test_sweep(spark, tmp_path):
    doc = {"method": "bayes", "metric": {"name": "f1_macro", "goal": "maximize"},
           "parameters": {"max_depth": {"distribution": "int_uniform", "min": 3, "max": 8}, "seed": {"value": 42}}}
    (tmp_path / "sweep.json").write_text(json.dumps(doc, indent=2))
    space, settings = jsonl.read_sweep(spark, str(tmp_path / "sweep.json"))
    assert space["max_depth"]["max"] == 8 and settings["metric"]["goal"] == "maximize"


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5)
    assert cut_lineage(df).inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_dir(spark).lstrip("/"))


def test_written_runs_can_be_read(spark, tmp_path):
    columns = "strategy string, accuracy double, macro_f1 double"
    cot = spark.createDataFrame([("tree-model", 0.9, 0.8), ("guided", 0.75, None)], columns)
    plain = spark.createDataFrame([("tree-model", 0.9, 0.8), ("zéro \"shot\"", 1 / 3, 0.25)], columns)
    folder = str(tmp_path / "runs")
    jsonl.write_run(spark, folder, "loan_a", False, cot=cot.limit(0))
    assert jsonl.write_run(spark, folder, "loan_a", False, cot=cot, zero_shot_baseline=plain).endswith("/loan_a_unmasked.json")
    jsonl.write_run(spark, folder + "/", "loan_a", True, zero_shot_baseline=plain)
    found = jsonl.run_scores(jsonl.read_runs(spark, f"{folder}/*.json")).collect()
    same = [("tree-model", 0.9, 0.8), ("zéro \"shot\"", 1 / 3, 0.25)]
    want = [("loan_a", False, "guided", 0.75, None), *[("loan_a", m, *r) for m in (True, False) for r in same]]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="judge"):
        jsonl.write_run(spark, folder, "loan_a", True, judge=plain)
