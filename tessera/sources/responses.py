"""Response JSONL: envelopes, reading with line order, and bad-line handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The JSON shapes that batch services return.
CANDIDATES = ("key string, response struct<candidates: array<struct<finishReason: string, "
              "content: struct<parts: array<struct<text: string>>>>>>")
CHOICES = ("custom_id string, response struct<body: struct<choices: "
           "array<struct<message: struct<content: string>>>>>")
EVALUATIONS = "request_id string, evaluation string"
RESULTS = ("custom_id string, result struct<type: string, "
           "message: struct<content: array<struct<text: string>>>>")

MODES = ("strict", "quarantine")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines as ``line`` with ``seq``: file time, file, block and line order."""
    raw = spark.read.text(path).select("value", "_metadata")
    # The id is a column of its own first: an aggregate may not contain it.
    numbered = raw.withColumn("_row", F.monotonically_increasing_id())
    return with_sequence(numbered).filter(F.trim("line") != "")


def with_sequence(raw: DataFrame) -> DataFrame:
    """``line`` and ``seq`` from a text scan that kept ``_metadata`` and has ``_row``."""
    seq = F.struct(F.col("_metadata.file_modification_time").alias("time"),
                   F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.col("_row").alias("row"))
    return raw.select(F.col("value").alias("line"), seq.alias("seq"))


def _checked(lines: DataFrame, schema: str, fields: dict[str, str], valid: Column,
             mode: str) -> DataFrame:
    """Parse ``line``; ``strict`` fails on a bad line, ``quarantine`` marks it in ``bad_line``.

    No filter moves below a generator, so later conditions on the fields do not parse again.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    others = [c for c in lines.columns if c != "line"]
    parsed = lines.select("*", F.explode_outer(F.array(F.from_json("line", schema))).alias("r"))
    ok = F.coalesce(valid, F.lit(False))
    if mode == "strict":
        broken = F.raise_error(F.concat(F.lit("bad response line: "), F.substring("line", 1, 200)))
        parsed = parsed.withColumn("r", F.when(ok, F.col("r")).otherwise(broken))
        return parsed.select(*[F.expr(e).alias(n) for n, e in fields.items()], *others)
    bad = F.when(~ok, F.col("line")).alias("bad_line")
    return parsed.select(*[F.expr(e).alias(n) for n, e in fields.items()], *others, bad)


def candidates(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """``key, finish, text`` of the candidate envelope; refused or cut answers have a null text."""
    first = F.get(F.col("r.response.candidates"), F.lit(0))
    valid = F.col("r.key").isNotNull() & first["finishReason"].isNotNull()
    fields = {"key": "r.key", "finish": "get(r.response.candidates, 0).finishReason",
              "text": "get(get(r.response.candidates, 0).content.parts, 0).text"}
    return _checked(lines, CANDIDATES, fields, valid, mode)


def choices(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """``key, text`` of the choices envelope; a refused answer has a null text."""
    first = F.get(F.col("r.response.body.choices"), F.lit(0))
    fields = {"key": "r.custom_id", "text": "get(r.response.body.choices, 0).message.content"}
    return _checked(lines, CHOICES, fields, F.col("r.custom_id").isNotNull() & first["message"].isNotNull(), mode)


def evaluations(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """``key, text`` of the judge envelope; an evaluation can be null."""
    fields = {"key": "r.request_id", "text": "r.evaluation"}
    return _checked(lines, EVALUATIONS, fields, F.col("r.request_id").isNotNull(), mode)


def results(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """``key, type, text`` of the batch-result envelope."""
    valid = F.col("r.custom_id").isNotNull() & F.col("r.result.type").isNotNull()
    fields = {"key": "r.custom_id", "type": "r.result.type",
              "text": "get(r.result.message.content, 0).text"}
    return _checked(lines, RESULTS, fields, valid, mode)


def split_bad(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad lines of a parse in ``quarantine`` mode."""
    good = parsed.filter(F.col("bad_line").isNull()).drop("bad_line")
    return good, parsed.filter(F.col("bad_line").isNotNull()).select("bad_line")
