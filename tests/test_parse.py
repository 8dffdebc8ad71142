"""Parsers on small files: valid answers, cut-off answers, missing marks, duplicates."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import first_int, strip
from tessera.operators import parse
from tessera.sources import responses as source


def candidate(key, text, finish="STOP"):
    found = [{"finishReason": finish, "content": {"parts": [{"text": text}]}}]
    return {"key": key, "response": {"candidates": found}}


def choice(key, text):
    return {"custom_id": key, "response": {"body": {"choices": [{"message": {"content": text}}]}}}


@pytest.fixture
def lines(spark, tmp_path):
    def write(records, name="a.jsonl"):
        (tmp_path / name).write_text("".join(
            (r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))
        return source.read_lines(spark, str(tmp_path))
    return write


def as_dict(df, value="prediction"):
    return {r["idx"]: r[value] for r in df.collect()}


def test_plain_labels(lines):
    got = parse.plain_labels(source.candidates(lines([
        candidate("baseline_zero-shot_batch-0", "0"),
        candidate("baseline_zero-shot_batch-1", "The answer is 1"),
        candidate("baseline_zero-shot_batch-2", "1", "MAX_TOKENS"),
        candidate("baseline_zero-shot_batch-3", "no answer comes to mind"),
        candidate("baseline_zero-shot_batch-4", "")])))
    assert as_dict(got) == {0: 0, 1: 1, 3: -1, 4: -1}


def test_stepwise_labels(lines):
    got = parse.stepwise_labels(source.candidates(lines([
        candidate("baseline_zero-shot-cot_batch-0", "Thinking 7...\nFINAL PREDICTION: 0"),
        candidate("baseline_zero-shot-cot_batch-1", "FINAL PREDICTION: 1", "MAX_TOKENS"),
        candidate("baseline_zero-shot-cot_batch-2", "My FINAL PREDICTION: is open"),
        candidate("baseline_zero-shot-cot_batch-3", "FINAL PREDICTION: undecided"),
        candidate("baseline_zero-shot-cot_batch-4", "no mark but 5")])))
    assert as_dict(got) == {0: 0, 2: -1, 3: -1, 4: 5}


def test_agent_labels(lines):
    got = source.candidates(lines([
        candidate("cot_batch-0_agent-0", "FINAL PREDICTION: 0"),
        candidate("cot_batch-0_agent-1", "FINAL PREDICTION: 0"),
        candidate("cot_batch-0_agent-2", "FINAL PREDICTION: 1"),
        candidate("cot_batch-1_agent-0", "FINAL PREDICTION: 1"),
        candidate("cot_batch-2_agent-0", "FINAL PREDICTION: 0"),
        candidate("cot_batch-2_agent-1", "FINAL PREDICTION: 0", "MAX_TOKENS"),
        candidate("cot_batch-2_agent-2", "All done, FINAL PREDICTION:"),
        candidate("cot_batch-2_agent-3", "FINAL PREDICTION: no number"),
        candidate("cot_batch-3_agent-0", "FINAL PREDICTION: 1", "MAX_TOKENS"),
        candidate("cot_batch-4_agent-0", "FINAL PREDICTION: 1"),
        candidate("cot_batch-4_agent-1", "FINAL PREDICTION: 0")]))
    # row 2: two answers without a number outvote the 0; row 4: a tie goes to the smaller label
    assert as_dict(parse.agent_labels(got)) == {0: 0, 1: 1, 2: -1, 4: 0}
    assert parse.interrupted(got).first().asDict() == {"interrupted": 2, "responses": 11}


def test_first_vote_of_an_agent_counts(lines):
    got = source.candidates(lines([
        candidate("cot_batch-0_agent-0", "FINAL PREDICTION: 1", "MAX_TOKENS"),
        candidate("cot_batch-0_agent-0", "FINAL PREDICTION: 1"),
        candidate("cot_batch-0_agent-0", "FINAL PREDICTION: 0"),
        candidate("cot_batch-0_agent-0", "FINAL PREDICTION: 0")]))
    assert as_dict(parse.agent_labels(got)) == {0: 0}
    assert as_dict(parse.agent_labels(got, dedupe_agents=True)) == {0: 1}


def test_votes_do_not_depend_on_partitions(lines):
    got = lines([candidate(f"cot_batch-{i % 7}_agent-{i}", f"FINAL PREDICTION: {i * i % 3}") for i in range(60)])
    one = as_dict(parse.agent_labels(source.candidates(got.coalesce(1))))
    assert one == as_dict(parse.agent_labels(source.candidates(got.repartition(7))))


def test_reasoning(lines):
    got = parse.reasoning(source.choices(lines([
        choice("reasoning_batch-0", "the thoughts</think><REASONING>The fare decided it</REASONING>"),
        choice("reasoning_batch-1", "thoughts end </think> and nothing follows"),
        choice("reasoning_batch-2", "thoughts end </think> <REASONING>"),
        choice("reasoning_batch-3", ""),
        choice("reasoning_batch-4", "a</think> <REASONING>\n x </REASONING> </think><REASONING>later")])))
    assert as_dict(got, "reasoning") == {0: "The fare decided it", 2: "", 4: "x"}


def test_reasoning_guard(spark, lines):
    none = parse.reasoning(source.choices(lines([choice("reasoning_batch-0", "x")])))
    with pytest.raises(ValueError, match="no reasoning"):
        parse.require_reasoning(none)


def test_judge_scores(lines):
    texts = {
        0: 'Analysis\nEVALUATION:{"metrics":{"faithfulness":4.5,"consistency":4.0,"coherence":4.75}}',
        1: "Missing EVALUATION: delimiter",
        2: 'EVALUATION:{"metrics":{"faithfulness":4.5,"consistency":4.0}}',
        3: "EVALUATION:{invalid json}",
        4: 'EVALUATION:{"wrong_key":{"value":1}}',
        5: 'EVALUATION: {"metrics":{"faithfulness":1}} trailing',
        6: 'EVALUATION:\n{"metrics": {"faithfulness": 2, "note": "n/a"}}\n',
        7: 'EVALUATION:{"metrics":{"faithfulness":1}} EVALUATION:{"metrics":{"faithfulness":2}}',
    }
    got = parse.judge_scores(source.evaluations(lines(
        [{"request_id": f"judge_batch-{k}", "evaluation": v} for k, v in texts.items()])))
    assert as_dict(got, "metrics") == {
        0: {"faithfulness": 4.5, "consistency": 4.0, "coherence": 4.75},
        2: {"faithfulness": 4.5, "consistency": 4.0},
        6: {"faithfulness": 2.0, "note": None}, 7: {"faithfulness": 1.0}}


def test_last_valid_line_wins(lines):
    got = parse.judge_scores(source.evaluations(lines([
        {"request_id": "judge_batch-0", "evaluation": 'EVALUATION:{"metrics":{"faithfulness":1}}'},
        {"request_id": "judge_batch-0", "evaluation": 'EVALUATION:{"metrics":{"faithfulness":2}}'},
        {"request_id": "judge_batch-0", "evaluation": "broken"}])))
    assert as_dict(got, "metrics") == {0: {"faithfulness": 2.0}}


def test_bad_lines(lines):
    broken = lines([candidate("b-0", "1"), '{"key": "b-1"', {"key": "b-2"}, ""])
    with pytest.raises(Exception, match="bad response line"):
        source.candidates(broken).collect()
    good, bad = source.split_bad(source.candidates(broken, "quarantine"))
    assert as_dict(parse.plain_labels(good)) == {0: 1}
    assert bad.count() == 2
    with pytest.raises(ValueError):
        source.candidates(broken, "lenient")


def test_triage(lines):
    def result(key, kind, text=None):
        out = {"type": kind}
        if text is not None:
            out["message"] = {"content": [{"text": text}]}
        return {"custom_id": key, "result": out}
    got = source.results(lines([result("judge_batch-0", "succeeded", "ok"), result("judge_batch-1", "errored"),
                                result("judge_batch-2", "expired"), result("judge_batch-3", "succeeded", "fine")]))
    assert {r["type"]: r["n"] for r in parse.triage(got).collect()} == {"succeeded": 2, "errored": 1, "expired": 1}
    assert {r["request_id"]: r["evaluation"] for r in parse.succeeded(got).collect()} == {
        "judge_batch-0": "ok", "judge_batch-3": "fine"}


def test_text_functions(spark):
    df = spark.createDataFrame([(" \t\x1c a b  \n",)], "t string")
    assert df.select(strip(df.t)).first()[0] == "a b"
    df = spark.createDataFrame([("-1",), ("0.5",), ("9" * 30,)], "t string")
    assert [r[0] for r in df.limit(2).select(first_int(df.t)).collect()] == [1, 0]
    df = spark.createDataFrame([("9" * 30,), ("0" * 30 + "7",), ("8" * 30,), ("9" * 30 + "x",), (None,)], "t string")
    long, seven, other, same, none = [r[0] for r in df.select(first_int(df.t)).collect()]
    assert long == same >= 2**62 and other >= 2**62 and other != long and seven == 7 and none is None


def test_judge_json_is_as_strict_as_a_json_parser(spark):
    """Mutated evaluations are kept exactly when Python's parser finds a metrics object."""
    rng = random.Random(5)
    base = '{"metrics": {"faithfulness": 4.5, "coherence": [1], "x": {"y": "z"}}, "n": null}'
    texts = {base}
    for _ in range(600):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(t))
            if rng.random() < 0.5:
                t[at:at + 1] = rng.choice(["", "}", "{", '"', ",", "]", "[", " ", "1", ":", "a", "\\", "\n", "'", "0"])
            else:
                t.insert(at, rng.choice(["}", "{", '"', ",", "]", "[", " ", "1", ":", "x", "\\", "\t", "//", "0"]))
        texts.add("".join(t))

    def kept(text):
        try:
            return isinstance(json.loads(text)["metrics"], dict)
        except Exception:
            return False
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    got = {r["t"]: r["ok"] for r in df.select(
        "t", parse.metrics_of(F.concat(F.lit(parse.EVALUATION_MARK), "t")).isNotNull().alias("ok")).collect()}
    assert [t for t in texts if got[t] != kept(t)] == []
