"""Request ids, request envelopes and batch inference."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import ModelSpec
from tessera.session import cut_lineage


def baseline_id(kind: str, idx: Column) -> Column:
    """``baseline_<kind>_batch-<idx>``."""
    return F.concat(F.lit(f"baseline_{kind}_batch-"), idx.cast("string"))


def reasoning_id(idx: Column) -> Column:
    """``reasoning_batch-<idx>``."""
    return F.concat(F.lit("reasoning_batch-"), idx.cast("string"))


def judge_id(idx: Column) -> Column:
    """``judge_batch-<idx>``."""
    return F.concat(F.lit("judge_batch-"), idx.cast("string"))


def few_shot_id(idx: Column, agent: Column) -> Column:
    """``cot_batch-<idx>_agent-<agent>``."""
    return F.concat(F.lit("cot_batch-"), idx.cast("string"), F.lit("_agent-"), agent.cast("string"))


def contents_envelope(key: Column, prompt: Column, model: ModelSpec,
                      thinking_budget: int = 0) -> Column:
    """``{key, request: {contents, generationConfig}}``."""
    part = F.struct(prompt.alias("text"))
    message = F.struct(F.lit("user").alias("role"), F.array(part).alias("parts"))
    thinking = F.struct(F.lit(thinking_budget).alias("thinkingBudget"))
    settings = F.struct(F.lit(float(model.temperature)).alias("temperature"),
                        F.lit(model.max_tokens).alias("maxOutputTokens"),
                        thinking.alias("thinkingConfig"))
    request = F.struct(F.array(message).alias("contents"), settings.alias("generationConfig"))
    return F.struct(key.alias("key"), request.alias("request"))


def _messages(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def body_envelope(key: Column, prompt: Column, model: ModelSpec) -> Column:
    """``{custom_id, body: {model, messages, max_tokens, temperature}}``."""
    body = F.struct(F.lit(model.name).alias("model"), _messages(prompt).alias("messages"),
                    F.lit(model.max_tokens).alias("max_tokens"),
                    F.lit(float(model.temperature)).alias("temperature"))
    return F.struct(key.alias("custom_id"), body.alias("body"))


def params_envelope(key: Column, prompt: Column, model: ModelSpec) -> Column:
    """``{custom_id, params: {model, max_tokens, temperature, messages}}``."""
    params = F.struct(F.lit(model.name).alias("model"), F.lit(model.max_tokens).alias("max_tokens"),
                      F.lit(float(model.temperature)).alias("temperature"),
                      _messages(prompt).alias("messages"))
    return F.struct(key.alias("custom_id"), params.alias("params"))


def as_lines(requests: DataFrame) -> DataFrame:
    """``value``: one JSON line per ``request`` struct."""
    return requests.select(F.to_json("request").alias("value"))


def replay(requests: DataFrame, recorded: DataFrame, key: str = "key", order: str = "line") -> DataFrame:
    """Requests with their recorded answer of highest ``order``: ``key, response, status``
    ('done' or 'missing')."""
    answers = recorded.groupBy(key).agg(F.max_by("line", order).alias("response"))
    status = F.when(F.col("response").isNull(), F.lit("missing")).otherwise(F.lit("done"))
    return requests.select(key).join(answers, key, "left").select(key, "response", status.alias("status"))


def infer(requests: DataFrame, make_client: Callable[[], Callable[[str], str]],
          concurrency: int, answered: DataFrame | None = None) -> DataFrame:
    """Send each ``key, line`` to a client and return ``key, line, status, error``.

    Each of ``concurrency`` partitions makes one client of its own and streams small batches through
    it. A call that raises gives a row with status 'failed' and the error; the others go on. Keys with
    a 'done' row in ``answered`` (the result of an earlier round) are not sent again.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for key, line in zip(batch["key"], batch["line"]):
                try:
                    rows.append((key, client(line), "done", None))
                except Exception as e:  # whatever a service's client raises belongs to this request
                    rows.append((key, None, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "line", "status", "error"])
    sent = requests.select("key", "line")
    if answered is not None:
        sent = sent.join(answered.filter(F.col("status") == "done").select("key"), "key", "left_anti")
    return sent.repartition(concurrency, "key").mapInPandas(run, "key string, line string, status string, error string")


def infer_rounds(requests: DataFrame, make_client: Callable[[], Callable[[str], str]], concurrency: int,
                 rounds: int = 3) -> DataFrame:
    """``infer`` for all requests, and again for those that failed: ``key, line, status, error, attempt``.

    Every round's rows are written before the next, so a lost executor or a later failure never sends
    an answered request again.
    """
    found = None
    for attempt in range(rounds):
        got = infer(requests, make_client, concurrency, found).withColumn("attempt", F.lit(attempt))
        got = cut_lineage(got, "answers")
        found = got if found is None else found.unionByName(got)
        if got.filter(F.col("status") == "failed").isEmpty():
            break
    return found
