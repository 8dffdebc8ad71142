"""Configuration, prompts, requests, whole jobs and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from catalog.models import offline_answers
from tessera.config import Dataset, FewShot, ModelSpec, check_strategy
from tessera.operators import parse, prompts, requests
from tessera.operators.joins import per_agent
from tessera.plans import requests as jobs
from tessera.plans import run as runs
from tessera.plans.explain import explain
from tessera.sources import responses as source
from tessera.streaming import votes as stream


def test_descriptors():
    ok = dict(name="t", target="y", labels={0: "No", 1: "Yes"}, prepare=lambda df: df)
    Dataset(**ok)
    for change, error in (({"labels": {0: "a"}}, ValueError), ({"prepare": 3}, TypeError), ({"path": "a.txt"}, ValueError)):
        with pytest.raises(error):
            Dataset(**(ok | change))
    assert ModelSpec("m", 0.0, 1).max_tokens == 1 and FewShot(1, 0).thinking_budget == 0
    for bad in (lambda: ModelSpec("m", -0.1, 1), lambda: ModelSpec("m", 0.0, 0), lambda: FewShot(1, -1),
                lambda: FewShot(0, 1), lambda: check_strategy("other")):
        with pytest.raises(ValueError):
            bad()


def test_prompts_ask_for_what_the_parsers_read():
    assert parse.FINAL_MARK in prompts.STEPWISE and parse.FINAL_MARK in prompts.FEW_SHOT
    assert parse.THINK_END in prompts.REASONING and parse.REASONING_OPEN in prompts.REASONING
    assert parse.EVALUATION_MARK in prompts.JUDGE


def test_own_template(spark):
    rows = spark.createDataFrame([(1, 2.0)], "idx long, age double")
    asked = jobs.zero_shot(rows, ["age"], [0, 1], "d", "y", ModelSpec("m", 0.0, 5),
                           make=prompts.from_template("{example} of {dataset}? {other}"))
    text = asked.select(F.col("request.request.contents")[0]["parts"][0]["text"]).first()[0]
    assert text == "age: 2 of d? {other}"


def test_per_agent_ways_agree(spark):
    rows = spark.range(20).withColumnRenamed("id", "idx")
    few = spark.range(3).select(F.col("id").alias("agent"), F.concat(F.lit("b"), "id").alias("block"))
    assert per_agent(rows, few).count() == 60
    many = spark.range(1500).select(F.col("id").alias("agent"), F.col("id").alias("block"))
    assert per_agent(rows, many).select("idx", "agent").distinct().count() == 30000
    assert per_agent(rows, few.limit(0)).count() == 0


def test_replay_and_infer(spark):
    asked = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, line string")
    got = {r["key"]: (r["response"], r["status"]) for r in
           requests.replay(asked, spark.createDataFrame([("a", "x")], "key string, line string")).collect()}
    assert got == {"a": ("x", "done"), "b": (None, "missing")}
    sent = requests.infer(asked, lambda: lambda line: line + "!", 2)
    assert {tuple(r) for r in sent.collect()} == {("a", "1!", "done", None), ("b", "2!", "done", None)}


def test_failed_requests_are_sent_again_alone(spark, tmp_path):
    asked = spark.range(30).select(F.col("id").cast("string").alias("key"), F.lit("q").alias("line"))
    log = str(tmp_path)

    def make():
        def send(line):
            import uuid
            open(f"{log}/{uuid.uuid4().hex}", "w").close()
            if uuid.uuid4().int % 2:
                raise OSError("busy")
            return line + "!"
        return send
    got = requests.infer_rounds(asked, make, 3, rounds=40).collect()
    done = [r["key"] for r in got if r["status"] == "done"]
    assert sorted(done) == sorted(str(i) for i in range(30))
    assert len(got) == len(list(tmp_path.iterdir())) > 30  # one call for each row, none for answered keys
    assert all(r["error"] == "OSError: busy" and r["line"] is None for r in got if r["status"] == "failed")


def test_later_attempts_win(spark):
    asked = spark.createDataFrame([("a", "1")], "key string, prompt string").select("key", F.struct("key").alias("request"))
    replies = spark.createDataFrame([("a", "second", 1), ("a", "first", 0), ("a", None, 2)], "key string, line string, attempt int")
    got = runs.answers(asked, lambda lines: replies, "test").orderBy("seq").collect()
    assert [r["line"] for r in got] == ["first", "second"]


@pytest.fixture(scope="module")
def explained(spark):
    df = spark.range(300).select(
        F.col("id").alias("idx"), (F.col("id") % 17).cast("double").alias("qage"), (F.col("id") % 5).cast("double").alias("qclass"),
        ((F.col("id") % 17 > 8) | (F.col("id") % 5 == 0)).cast("int").alias("y"))
    space = {"max_depth": {"distribution": "int_uniform", "min": 2, "max": 4}, "random_state": {"value": 42}}
    return explain(df, "y", space, "DecisionTreeClassifier", n_trials=2, folds=2)


def test_explain(explained):
    assert explained.rows("test").count() == 60 and explained.rows("train").count() == 240
    assert explained.predictions.count() == 300
    assert explained.attributions.count() == 240 and explained.attributions.columns == ["idx", "qage", "qclass"]


SPECS = runs.Models(ModelSpec("a", 0.6, 4096), ModelSpec("b", 0.6, 4096), ModelSpec("c", 0.0, 4096))


def test_run(explained):
    task = runs.Task("numbers", "y", {0: "No", 1: "Yes"})
    got = runs.run(explained, task, SPECS, offline_answers, FewShot(2, 10), with_baseline=True, with_judge=True,
                   with_stepwise=True)
    scores = {r["strategy"]: r for r in got.scores.collect()}
    assert set(scores) == {"tree-model", "guided-few-shot", "zero-shot-prompting", "zero-shot-cot"}
    assert all(r["n"] == 60 and 0 <= r["macro_f1"] <= 1 for r in scores.values())
    assert scores["tree-model"]["accuracy"] > 0.8
    assert {r["metric"]: r["score"] for r in got.judgement.collect()} == {
        "faithfulness": 4.5, "consistency": 4.0, "coherence": 4.75}
    assert got.reasons.count() >= 2


def test_masked_run(explained):
    e, task = runs.mask(explained, "y")
    assert task.target == "x2" and task.dataset == "unknown"
    assert e.attributions.columns == ["idx", "x0", "x1"] and "x2" in e.table.columns
    seen = []

    def infer(lines):
        seen.extend(r["line"] for r in lines.collect())
        return offline_answers(lines)
    runs.run(e, task, SPECS, infer)
    assert seen and not any(name in line for line in seen for name in ("qage", "qclass", "numbers"))


def test_run_needs_reasoning(explained):
    def infer(lines):
        body = '{"custom_id": "%s", "response": {"body": {"choices": [{"message": {"content": "no marks"}}]}}}'
        return lines.select("key", F.format_string(body, "key").alias("line"))
    with pytest.raises(ValueError, match="no reasoning"):
        runs.run(explained, runs.Task("numbers", "y", {0: "No", 1: "Yes"}), SPECS, infer)


def _write(folder, name, votes):
    lines = [{"key": f"cot_batch-{idx}_agent-{agent}", "response": {"candidates": [
        {"finishReason": "STOP", "content": {"parts": [{"text": f"FINAL PREDICTION: {p}"}]}}]}}
        for idx, agent, p in votes]
    (folder / name).write_text("".join(json.dumps(x) + "\n" for x in lines))


def _labels(df):
    return {r["idx"]: r["prediction"] for r in df.collect()}


@pytest.mark.parametrize("dedupe", [False, True])
def test_stream_compaction(spark, tmp_path, dedupe, monkeypatch):
    monkeypatch.setattr(stream, "COMPACT_EVERY", 2)
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for i in range(5):
        _write(folder, f"{i}.jsonl", [(i % 3, i % 2, i % 2), (7, i, 1), (7, 0, 0)])
    stream.ingest(spark, str(folder), store, dedupe, files_per_batch=1).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "store" / "sums").iterdir()) == ["upto=1", "upto=3"]
    assert stream._counted(spark, store).count() < 15
    batch = parse.agent_labels(source.candidates(source.read_lines(spark, str(folder))), dedupe)
    assert _labels(stream.running_labels(spark, store)) == _labels(batch)
    with pytest.raises(ValueError, match="dedupe"):
        stream.running_labels(spark, store, not dedupe)


def test_stream_before_the_first_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream.ingest(spark, str(tmp_path / "in"), str(tmp_path / "store")).awaitTermination()
    assert stream.running_labels(spark, str(tmp_path / "store")).collect() == []


@pytest.mark.parametrize("dedupe", [False, True])
def test_stream_equals_batch(spark, tmp_path, dedupe):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    _write(folder, "a.jsonl", [(0, 0, 1), (0, 1, 0), (1, 0, 1)])
    stream.ingest(spark, str(folder), store, dedupe).awaitTermination()
    first = _labels(stream.running_labels(spark, store, dedupe))
    assert first == {0: 0, 1: 1}
    _write(folder, "b.jsonl", [(0, 2, 1), (0, 0, 0), (2, 0, 1), (1, 0, 0), (1, 0, 0)])
    stream.ingest(spark, str(folder), store, dedupe).awaitTermination()
    batch = parse.agent_labels(source.candidates(source.read_lines(spark, str(folder))), dedupe)
    assert _labels(stream.running_labels(spark, store, dedupe)) == _labels(batch)
    table = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "idx long, y long")
    assert stream.running_scores(spark, store, table, "y", "guided-few-shot", dedupe).first()["n"] == 3


def test_dataset_run_from_csv(spark, tmp_path):
    from tessera.operators import presets
    rows = ["PassengerId,Survived,Pclass,Name,Sex,Age,Embarked"]
    rows += [f'{i},{int(i % 3 == 0)},{i % 3 + 1},"Doe, J. ""{i}""",{"male" if i % 2 else "female"},{i % 60 if i % 9 else ""},{"SCQ"[i % 3]}'
             for i in range(120)]
    (tmp_path / "titanic.csv").write_text("\n".join(rows) + "\n")
    dataset = Dataset("titanic", "Survived", {0: "No", 1: "Yes"}, presets.titanic, str(tmp_path / "titanic.csv"))
    got = runs.run_dataset(spark, dataset, {"max_depth": {"value": 3}}, SPECS, offline_answers, "DecisionTreeClassifier",
                           masked=True, n_trials=1, with_baseline=False, with_judge=False)
    scores = {r["strategy"]: r for r in got.scores.collect()}
    # 14 of the 120 ages are missing: 106 rows, of which 22 are test rows
    assert set(scores) == {"tree-model", "guided-few-shot"} and {r["n"] for r in scores.values()} == {22}
    assert scores["tree-model"]["accuracy"] == 1.0


def test_compare(spark):
    from tessera.plans.evaluation import compare
    table = spark.range(30).select(F.col("id").alias("idx"), F.lit(1).alias("y"))
    good = table.select("idx", F.lit(1).cast("long").alias("prediction"))
    bad = table.filter("idx < 20").select("idx", F.lit(0).cast("long").alias("prediction"))
    got = compare(good, bad, table, "y").first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (0, 20, 0, 0) and got["significant"]
