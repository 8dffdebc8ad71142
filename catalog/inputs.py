"""Inputs derived from the driver tables: response lines, truth and model features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events that stand for responses; parsing them is all work and little data."""
    return spread(table(spark, sf, "events").select("event_id", "user_id", "event_type"))


def candidate_line(key: Column, finish: Column, text: Column) -> Column:
    content = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
    found = F.array(F.struct(finish.alias("finishReason"), content.alias("content")))
    return F.to_json(F.struct(key.alias("key"), F.struct(found.alias("candidates")).alias("response")))


def choice_line(key: Column, text: Column) -> Column:
    choices = F.array(F.struct(F.struct(text.alias("content")).alias("message")))
    body = F.struct(F.struct(choices.alias("choices")).alias("body"))
    return F.to_json(F.struct(key.alias("custom_id"), body.alias("response")))


def result_line(key: Column, kind: Column, text: Column) -> Column:
    message = F.struct(F.array(F.struct(text.alias("text"))).alias("content"))
    return F.to_json(F.struct(key.alias("custom_id"),
                              F.struct(kind.alias("type"), message.alias("message")).alias("result")))


def by_type(**cases: Column) -> Column:
    """A value per event type; any other type gives an empty text."""
    out = None
    for kind, value in cases.items():
        hit = F.col("event_type") == kind
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(""))


def vote_text(label: str) -> Column:
    """Answer text of an event; the label is the parity of column ``label``."""
    parity = (F.col(label) % 2).cast("string")
    return by_type(
        click=F.concat(F.lit("Thinking... FINAL PREDICTION: "), parity),
        view=F.concat(F.lit("Maybe FINAL PREDICTION: 1 or FINAL PREDICTION: "), parity),
        signup=F.lit("FINAL PREDICTION: undecided"),
        purchase=F.concat(F.lit("The answer is "), parity))



def finish() -> Column:
    return F.when(F.col("event_type") == "error", F.lit("MAX_TOKENS")).otherwise(F.lit("STOP"))


def vote_lines(spark: SparkSession, sf: str, label: str = "user_id") -> DataFrame:
    """Five agents' answers per row: ``line, seq``."""
    idx = F.floor(F.col("event_id") / 5).cast("string")
    agent = (F.col("event_id") % 5).cast("string")
    key = F.concat(F.lit("cot_batch-"), idx, F.lit("_agent-"), agent)
    return events(spark, sf).select(
        candidate_line(key, finish(), vote_text(label)).alias("line"), F.col("event_id").alias("seq"))


def single_lines(spark: SparkSession, sf: str, kind: str = "zero-shot", key: str = "event_id",
                 label: str = "user_id") -> DataFrame:
    """One answer per event: ``line, seq``."""
    name = F.concat(F.lit(f"baseline_{kind}_batch-"), F.col(key).cast("string"))
    return events(spark, sf).select(
        candidate_line(name, finish(), vote_text(label)).alias("line"), F.col("event_id").alias("seq"))


def reasoning_lines(spark: SparkSession, sf: str) -> DataFrame:
    words = F.concat(F.lit("thoughts</think><REASONING> Because user "), F.col("user_id").cast("string"),
                     F.lit(" did it \n</REASONING>"))
    text = by_type(click=words, view=F.lit("thoughts end </think> and nothing follows"),
                   signup=F.lit("thoughts end </think> <REASONING>"),
                   purchase=F.lit("<REASONING>no end of thought</REASONING>"))
    key = F.concat(F.lit("reasoning_batch-"), F.col("event_id").cast("string"))
    return events(spark, sf).select(choice_line(key, text).alias("line"), F.col("event_id").alias("seq"))


def silenced(lines: DataFrame, line: Column) -> DataFrame:
    """``lines`` and, for each event, a later line to the same key without a text; it must change nothing."""
    return lines.unionByName(lines.select(line.alias("line"), (F.col("seq") + 10**15).alias("seq")))


def key_of(field: str) -> Column:
    """A request id taken back from its response line."""
    return F.get_json_object("line", f"$.{field}")


def judge_text() -> Column:
    q = (1 + (F.col("user_id") % 17) * 0.25).cast("string")
    q2 = (1 + (F.col("event_id") % 17) * 0.25).cast("string")
    return by_type(
        click=F.concat(F.lit('Analysis\nEVALUATION:{"metrics":{"faithfulness":'), q, F.lit(',"consistency":'),
                       q2, F.lit(',"coherence":4.0}}')),
        view=F.concat(F.lit('EVALUATION:{"metrics":{"faithfulness":'), q, F.lit(',"consistency":'), q2,
                      F.lit("}}")),
        signup=F.concat(F.lit('EVALUATION:{"metrics":{"faithfulness":'), q, F.lit("}} trailing")),
        purchase=F.lit('EVALUATION:{"wrong_key":{"value":1}}'),
        error=F.lit("no marker"))


def judge_lines(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("judge_batch-"), F.col("event_id").cast("string"))
    line = F.to_json(F.struct(key.alias("request_id"), judge_text().alias("evaluation")))
    return events(spark, sf).select(line.alias("line"), F.col("event_id").alias("seq"))


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Batch results: errors failed, sign-ups expired, the rest succeeded with a judge text."""
    kind = (F.when(F.col("event_type") == "error", F.lit("errored"))
            .when(F.col("event_type") == "signup", F.lit("expired")).otherwise(F.lit("succeeded")))
    key = F.concat(F.lit("judge_batch-"), F.col("event_id").cast("string"))
    return events(spark, sf).select(
        result_line(key, kind, judge_text()).alias("line"), F.col("event_id").alias("seq"))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """``idx, y``: whether an order is finished."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("idx"), (F.col("o_orderstatus") == "F").cast("bigint").alias("y"))


FEATURES = ["quantity", "price", "discount", "lines", "late"]


def order_features(spark: SparkSession, sf: str) -> DataFrame:
    """``idx``, numeric features of each order's lines and ``y``: whether any line was returned.

    Sums are taken before the shuffle, so an order of very many lines costs one row per task.
    """
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("idx")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"), F.count(F.lit(1)).cast("double").alias("lines"),
        F.max(F.year("l_shipdate") - 1990).cast("double").alias("late"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    return lines.select("idx", *FEATURES, "y")


# The same derived rows in SQL.
SQL_TEXT = """CASE event_type
    WHEN 'click' THEN 'Thinking... FINAL PREDICTION: ' || CAST({label} % 2 AS VARCHAR)
    WHEN 'view' THEN 'Maybe FINAL PREDICTION: 1 or FINAL PREDICTION: ' || CAST({label} % 2 AS VARCHAR)
    WHEN 'signup' THEN 'FINAL PREDICTION: undecided'
    WHEN 'purchase' THEN 'The answer is ' || CAST({label} % 2 AS VARCHAR)
    ELSE '' END"""


def sql_first_int(text: str) -> str:
    return f"""CASE WHEN regexp_extract({text}, '[0-9]+') = '' THEN -1
      ELSE coalesce(TRY_CAST(regexp_extract({text}, '[0-9]+') AS BIGINT), 9223372036854775807) END"""


def sql_votes(label: str = "user_id") -> str:
    """CTEs ``ballots(idx, agent, seq, prediction)`` and ``voted(idx, prediction)``."""
    last = "list_extract(string_split(text, 'FINAL PREDICTION:'), -1)"
    return f"""raw_{label} AS (
  SELECT CAST(floor(event_id / 5) AS BIGINT) AS idx, event_id % 5 AS agent, event_id AS seq,
    event_type, {SQL_TEXT.format(label=label)} AS text FROM events),
ballots_{label} AS (
  SELECT idx, agent, seq, CAST({sql_first_int(last)} AS BIGINT) AS prediction
  FROM raw_{label} WHERE event_type <> 'error'),
voted_{label} AS (
  SELECT idx, prediction FROM (
    SELECT idx, prediction, row_number() OVER (PARTITION BY idx ORDER BY n DESC, prediction) AS r
    FROM (SELECT idx, prediction, count(*) AS n FROM ballots_{label} GROUP BY ALL)) WHERE r = 1)"""


SQL_TRUTH = "truth AS (SELECT o_orderkey AS idx, CAST(o_orderstatus = 'F' AS BIGINT) AS y FROM orders)"
SQL_JUDGE = """judged AS (SELECT event_id AS idx, event_type,
  1 + (user_id % 17) * 0.25 AS q, 1 + (event_id % 17) * 0.25 AS q2 FROM events)"""
