"""Prompt, envelope and request-job queries.

Customers are the table to classify: the features are integers, the target is whether the
balance is positive.
"""

from pyspark.sql import functions as F

from catalog.inputs import table
from tessera.config import FewShot, ModelSpec
from tessera.functions.rows import key_value_text
from tessera.operators import prompts, requests
from tessera.operators.split import exact_split, example_sets
from tessera.plans import requests as jobs

MODEL = ModelSpec("model-a", 0.6, 4096)
CLASSIFIER = ModelSpec("model-b", 0.0, 4096)
DATASET, TARGET, LABELS = "customers", "solid", {0: "No", 1: "Yes"}
FEATURES = ["nation", "balance", "segment"]


def _rows(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("nation"),
        F.floor("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") > 0).cast("int").alias("solid"))


def _predictions(rows):
    return rows.select("idx", (F.col("nation") % 2).cast("bigint").alias("prediction"))


def _attributions(rows):
    return rows.select("idx", (F.col("idx") % 7 - 3).alias("nation"), (F.col("idx") % 11 - 5).alias("balance"))


def _reasons(rows):
    kept = rows.filter("balance % 3 > 0")
    return kept.select("idx", F.concat(F.lit("Because of "), "segment").alias("reasoning"))


def _importances(spark, sf):
    """Share of the rows that each feature's attribution sign is positive in, as percent."""
    rows = _attributions(_rows(spark, sf))
    shares = rows.agg(F.struct(F.lit("nation").alias("feature"), F.count_if(F.col("nation") > 0).alias("importance"),
                               F.lit(0).alias("position")).alias("a"),
                      F.struct(F.lit("balance").alias("feature"), F.count_if(F.col("balance") > 0).alias("importance"),
                               F.lit(1).alias("position")).alias("b"))
    return shares.select(F.explode(F.array("a", "b")).alias("r")).select("r.*")


def _prompt(spark, sf, make):
    rows = _rows(spark, sf)
    slots = {"dataset": F.lit(DATASET), "target": F.lit(TARGET), "labels": prompts.label_list([0, 1]),
             "example": key_value_text(rows, FEATURES)}
    return rows.select("idx", make(slots).alias("prompt"))


def g1_zero_shot(spark, sf):
    return _prompt(spark, sf, prompts.zero_shot)


def g2_stepwise(spark, sf):
    return _prompt(spark, sf, prompts.stepwise)


def _explained(spark, sf):
    rows = _rows(spark, sf)
    return jobs.explained_rows(rows, _predictions(rows), _attributions(rows), _importances(spark, sf), TARGET)


def g3_reasoning(spark, sf):
    asked = jobs.reasoning(_explained(spark, sf), DATASET, TARGET, MODEL)
    return asked.select("idx", "key", F.col("request.body.messages")[0]["content"].alias("prompt"))


def g4_judge(spark, sf):
    asked = jobs.judge(_explained(spark, sf), _reasons(_rows(spark, sf)), DATASET, TARGET, MODEL)
    return asked.select("idx", "key", F.col("request.params.messages")[0]["content"].alias("prompt"))


def g6_blocks(spark, sf):
    rows = _rows(spark, sf)
    texts = jobs.example_texts(rows, _predictions(rows), _attributions(rows), _reasons(rows), TARGET)
    return prompts.example_blocks(example_sets(texts, 10))


def _nation_examples(spark, sf):
    """Few examples: nations stand for rows with a reasoning."""
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("idx"),
        F.concat(F.lit('{"region":'), F.col("n_regionkey"), F.lit("}")).alias("features"),
        F.concat(F.lit('{"region":'), F.col("n_nationkey") - 12, F.lit("}")).alias("attributions"),
        (F.col("n_regionkey") % 2).alias("prediction"), F.col("n_name").alias("reasoning"))


def _few_shot(spark, sf):
    return jobs.few_shot(_nation_examples(spark, sf), _rows(spark, sf), FEATURES, _importances(spark, sf), DATASET,
                         TARGET, LABELS, CLASSIFIER, FewShot(10, 1000))


def g5_few_shot(spark, sf):
    return _few_shot(spark, sf).select(
        "idx", "agent", "key", F.col("request.request.contents")[0]["parts"][0]["text"].alias("prompt"))


def _lines(requests_df):
    return requests_df.select("key", F.to_json("request").alias("line"))


def _short(spark, sf):
    return _rows(spark, sf).select("idx", F.concat(F.lit('Say "'), "segment", F.lit('"\n')).alias("prompt"))


def g7_contents(spark, sf):
    key = requests.baseline_id("zero-shot-cot", F.col("idx"))
    envelope = requests.contents_envelope(key, F.col("prompt"), CLASSIFIER, 1000)
    return requests.as_lines(_short(spark, sf).select(envelope.alias("request")))


def g8_body(spark, sf):
    envelope = requests.body_envelope(requests.reasoning_id(F.col("idx")), F.col("prompt"), MODEL)
    return requests.as_lines(_short(spark, sf).select(envelope.alias("request")))


def g9_params(spark, sf):
    envelope = requests.params_envelope(requests.judge_id(F.col("idx")), F.col("prompt"), MODEL)
    return requests.as_lines(_short(spark, sf).select(envelope.alias("request")))


def g11_replay(spark, sf):
    """Answers are on record for events only, so later customers' requests stay open."""
    asked = _rows(spark, sf).select(requests.baseline_id("zero-shot", F.col("idx")).alias("key"))
    recorded = table(spark, sf, "events").filter("event_type = 'click'").select(
        requests.baseline_id("zero-shot", F.col("event_id")).alias("key"),
        F.concat(F.lit("answer "), "user_id").alias("line"))
    return requests.replay(asked, recorded)


def g11_infer(spark, sf):
    """A client that answers with the number of characters of the request, and is too busy for odd numbers."""
    def answer(line):
        if len(line) % 2:
            raise TimeoutError(f"busy with {len(line)}")
        return str(len(line))

    asked = _lines(_short(spark, sf).select(
        requests.judge_id(F.col("idx")).alias("key"),
        requests.params_envelope(requests.judge_id(F.col("idx")), F.col("prompt"), MODEL).alias("request")))
    return requests.infer(asked, lambda: answer, 4)


def g12_zero_shot(spark, sf):
    """Split, labels in first-seen order, prompts and envelopes of the test rows."""
    rows = exact_split(_rows(spark, sf))
    train, test = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")
    labels = jobs.label_values(train, TARGET)
    return _lines(jobs.zero_shot(test, FEATURES, labels, DATASET, TARGET, CLASSIFIER))


def g12_stepwise(spark, sf):
    test = exact_split(_rows(spark, sf)).filter("split = 'test'").drop("split")
    return _lines(jobs.zero_shot(test, FEATURES, [0, 1], DATASET, TARGET, CLASSIFIER, stepwise=True))


def g12_few_shot(spark, sf):
    return _lines(_few_shot(spark, sf))


QUERIES = {f.__name__: f for f in (
    g1_zero_shot, g2_stepwise, g3_reasoning, g4_judge, g5_few_shot, g6_blocks, g7_contents, g8_body, g9_params,
    g11_replay, g11_infer, g12_zero_shot, g12_stepwise, g12_few_shot)}


def text_sql(template: str, slots: dict[str, str]) -> str:
    """A template as an SQL concatenation."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in slots.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


ROWS = """rs AS (SELECT c_custkey AS idx, c_nationkey AS nation, CAST(floor(c_acctbal) AS BIGINT) AS balance,
  c_mktsegment AS segment, CAST(c_acctbal > 0 AS INT) AS solid FROM customer)"""
EXAMPLE = "'nation: ' || nation || chr(10) || 'balance: ' || balance || chr(10) || 'segment: ' || segment"
COMMON = {"dataset": "'customers'", "target": "'solid'"}
LABELED = COMMON | {"labels": "'0, 1'", "example": EXAMPLE}
IMPORTANCES = """imp AS (SELECT 'nation: ' || count(*) FILTER (WHERE c_custkey % 7 > 3) || chr(10) || 'balance: '
  || count(*) FILTER (WHERE c_custkey % 11 > 5) AS importances FROM customer)"""
TOLD = COMMON | {
    "prediction": "(nation % 2)", "truth": "solid", "importances": "importances",
    "features": EXAMPLE + " || chr(10) || 'solid: ' || solid",
    "attributions": "'nation: ' || (idx % 7 - 3) || chr(10) || 'balance: ' || (idx % 11 - 5)",
    "reasoning": "'Because of ' || segment"}
FEW = COMMON | {"labels": "'0: No, 1: Yes'", "importances": "importances", "examples": "examples", "example": EXAMPLE}
SHOT = {"number": "(pos + 1)", "features": "features", "attributions": "attributions", "prediction": "prediction",
        "reasoning": "reasoning"}
BLOCKS = f"""blocks AS (SELECT agent, string_agg({text_sql(prompts.EXAMPLE, SHOT)}, chr(10) ORDER BY pos) AS examples
  FROM (SELECT *, r // 10 AS agent, r % 10 AS pos FROM ex) GROUP BY agent)"""
NATIONS = """ex AS (SELECT row_number() OVER (ORDER BY md5('42:' || n_nationkey), n_nationkey) - 1 AS r,
  '{"region":' || n_regionkey || '}' AS features, '{"region":' || (n_nationkey - 12) || '}' AS attributions,
  n_regionkey % 2 AS prediction, n_name AS reasoning FROM nation)"""
REASONED = """ex AS (SELECT row_number() OVER (ORDER BY md5('42:' || idx), idx) - 1 AS r,
  '{"nation":' || nation || ',"balance":' || balance || ',"segment":"' || segment || '","solid":' || solid || '}' AS features,
  '{"nation":' || (idx % 7 - 3) || ',"balance":' || (idx % 11 - 5) || '}' AS attributions,
  nation % 2 AS prediction, 'Because of ' || segment AS reasoning FROM rs WHERE balance % 3 > 0)"""
SAY = """'Say "' || segment || '"' || chr(10)"""


def contents_sql(key: str, prompt: str, budget: int) -> str:
    return f"""CAST(json_object('key', {key}, 'request', json_object('contents', [json_object('role', 'user',
      'parts', [json_object('text', {prompt})])], 'generationConfig', json_object('temperature', CAST(0.0 AS DOUBLE),
      'maxOutputTokens', 4096, 'thinkingConfig', json_object('thinkingBudget', {budget})))) AS VARCHAR)"""


FEW_KEY = "'cot_batch-' || idx || '_agent-' || agent"
SPLIT = """tested AS (SELECT * FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || idx), idx) AS r
  FROM rs) WHERE r <= ceil(CAST(0.2 AS DOUBLE) * n))"""
SEEN = """seen AS (SELECT string_agg(CAST(solid AS VARCHAR), ', ' ORDER BY h) AS labels FROM (SELECT solid, min(md5('42:' || idx)) AS h
  FROM rs WHERE idx NOT IN (SELECT idx FROM tested) GROUP BY solid))"""

SQL = {
    "g1_zero_shot": f"WITH {ROWS} SELECT idx, {text_sql(prompts.ZERO_SHOT, LABELED)} AS prompt FROM rs",
    "g2_stepwise": f"WITH {ROWS} SELECT idx, {text_sql(prompts.STEPWISE, LABELED)} AS prompt FROM rs",
    "g3_reasoning": f"""WITH {ROWS}, {IMPORTANCES} SELECT idx, 'reasoning_batch-' || idx AS key,
        {text_sql(prompts.REASONING, TOLD)} AS prompt FROM rs, imp""",
    "g4_judge": f"""WITH {ROWS}, {IMPORTANCES} SELECT idx, 'judge_batch-' || idx AS key,
        {text_sql(prompts.JUDGE, TOLD)} AS prompt FROM rs, imp WHERE balance % 3 > 0""",
    "g5_few_shot": f"""WITH {ROWS}, {IMPORTANCES}, {NATIONS}, {BLOCKS} SELECT idx, agent, {FEW_KEY} AS key,
        {text_sql(prompts.FEW_SHOT, FEW)} AS prompt FROM rs, imp, blocks""",
    "g6_blocks": f"WITH {ROWS}, {REASONED}, {BLOCKS} SELECT agent, examples FROM blocks",
    "g7_contents": f"WITH {ROWS} SELECT {contents_sql(chr(39) + 'baseline_zero-shot-cot_batch-' + chr(39) + ' || idx', SAY, 1000)} AS value FROM rs",
    "g8_body": f"""WITH {ROWS} SELECT CAST(json_object('custom_id', 'reasoning_batch-' || idx, 'body', json_object(
        'model', 'model-a', 'messages', [json_object('role', 'user', 'content', {SAY})], 'max_tokens', 4096,
        'temperature', CAST(0.6 AS DOUBLE))) AS VARCHAR) AS value FROM rs""",
    "g9_params": f"""WITH {ROWS} SELECT CAST(json_object('custom_id', 'judge_batch-' || idx, 'params', json_object(
        'model', 'model-a', 'max_tokens', 4096, 'temperature', CAST(0.6 AS DOUBLE),
        'messages', [json_object('role', 'user', 'content', {SAY})])) AS VARCHAR) AS value FROM rs""",
    "g11_replay": """SELECT 'baseline_zero-shot_batch-' || c_custkey AS key, CASE WHEN event_id IS NOT NULL
        THEN 'answer ' || user_id END AS response, CASE WHEN event_id IS NULL THEN 'missing' ELSE 'done' END AS status
        FROM customer LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') ON event_id = c_custkey""",
    "g11_infer": f"""WITH {ROWS}, sent AS (SELECT 'judge_batch-' || idx AS key, length(CAST(json_object('custom_id', 'judge_batch-' || idx,
        'params', json_object('model', 'model-a', 'max_tokens', 4096, 'temperature', CAST(0.6 AS DOUBLE),
        'messages', [json_object('role', 'user', 'content', {SAY})])) AS VARCHAR)) AS n FROM rs)
        SELECT key, CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) END AS line, CASE WHEN n % 2 = 0 THEN 'done' ELSE 'failed' END AS status,
          CASE WHEN n % 2 = 1 THEN 'TimeoutError: busy with ' || n END AS error FROM sent""",
    "g12_zero_shot": f"""WITH {ROWS}, {SPLIT}, {SEEN} SELECT 'baseline_zero-shot_batch-' || idx AS key,
        {contents_sql(chr(39) + 'baseline_zero-shot_batch-' + chr(39) + ' || idx', text_sql(prompts.ZERO_SHOT, LABELED | {"labels": "labels"}), 0)} AS line
        FROM tested, seen""",
    "g12_stepwise": f"""WITH {ROWS}, {SPLIT} SELECT 'baseline_zero-shot-cot_batch-' || idx AS key,
        {contents_sql(chr(39) + 'baseline_zero-shot-cot_batch-' + chr(39) + ' || idx', text_sql(prompts.STEPWISE, LABELED), 1000)} AS line FROM tested""",
    "g12_few_shot": f"""WITH {ROWS}, {IMPORTANCES}, {NATIONS}, {BLOCKS} SELECT {FEW_KEY} AS key,
        {contents_sql(FEW_KEY, text_sql(prompts.FEW_SHOT, FEW), 1000)} AS line FROM rs, imp, blocks""",
}
