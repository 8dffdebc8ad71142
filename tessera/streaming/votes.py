"""Response files as a stream: votes are counted as files land.

Each micro-batch is parsed, reduced to one row per row id and label, and written to a folder
of its own number, so a batch that runs twice overwrites itself. Every ``COMPACT_EVERY`` batches the
counts so far are added up to one table; the running counts are the last such sum and the batches
after it. The stream itself keeps no state that grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import parse, scoring
from tessera.operators.joins import attach_truth
from tessera.sources import responses


def _reduce(batch: DataFrame, dedupe_agents: bool) -> DataFrame:
    numbered = batch.withColumn("_row", F.monotonically_increasing_id())
    lines = responses.with_sequence(numbered).filter(F.trim("line") != "")
    ballots = parse.votes(responses.candidates(lines))
    return parse.first_votes(ballots) if dedupe_agents else parse.count_votes(ballots)


# Batches whose counts are added up to one table.
COMPACT_EVERY = 16
COUNTS = "idx long, prediction long, n long"
FIRST_VOTES = ("idx long, agent long, prediction long, "
               "seq struct<time: timestamp, file: string, block: long, row: long>")


def ingest(spark: SparkSession, source: str, store: str, dedupe_agents: bool = False,
           files_per_batch: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start counting the votes of every response file that appears below ``source``.

    ``store`` gets the counts, the state and the stream's checkpoint. ``available_now`` stops after the
    files that are there; otherwise the query keeps watching.
    """
    shape = FIRST_VOTES if dedupe_agents else COUNTS
    spark.createDataFrame([], shape).write.mode("ignore").parquet(f"{store}/votes/epoch=-1")
    _state_row(spark, dedupe_agents, -1).write.mode("ignore").parquet(f"{store}/state")
    _check(spark, store, dedupe_agents)
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(source).select("value", "_metadata")

    def save(batch: DataFrame, epoch: int) -> None:
        _reduce(batch, dedupe_agents).write.mode("overwrite").parquet(f"{store}/votes/epoch={epoch}")
        if epoch % COMPACT_EVERY == COMPACT_EVERY - 1:
            # The state names a sum only when it is whole; a batch that runs twice writes the same sum twice.
            found = _sum(_counted(spark, store, epoch), dedupe_agents)
            found.write.mode("overwrite").parquet(f"{store}/sums/upto={epoch}")
            _state_row(spark, dedupe_agents, epoch).write.mode("append").parquet(f"{store}/state")
    writer = lines.writeStream.foreachBatch(save).option("checkpointLocation", f"{store}/checkpoint")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _state_row(spark: SparkSession, dedupe_agents: bool, upto: int) -> DataFrame:
    return spark.createDataFrame([(dedupe_agents, upto)], "dedupe_agents boolean, upto int")


def _check(spark: SparkSession, store: str, dedupe_agents: bool | None) -> bool:
    """The store's setting; another value raises."""
    kept = spark.read.parquet(f"{store}/state").first()["dedupe_agents"]
    if dedupe_agents is not None and dedupe_agents != kept:
        raise ValueError("the store was begun with the other value of dedupe_agents")
    return kept


def _sum(parts: DataFrame, dedupe_agents: bool) -> DataFrame:
    return parse.first_votes(parts) if dedupe_agents else parts.groupBy("idx", "prediction").agg(F.sum("n").alias("n"))


def _counted(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The last sum (of batches below ``before``, where given) and the batches after it."""
    state = spark.read.parquet(f"{store}/state")
    if before is not None:
        state = state.filter(F.col("upto") < before)
    found = state.agg(F.max("upto").alias("upto"), F.first("dedupe_agents").alias("dedupe")).first()
    schema = FIRST_VOTES if found["dedupe"] else COUNTS
    later = spark.read.schema(f"{schema}, epoch int").parquet(f"{store}/votes").filter(F.col("epoch") > found["upto"])
    if before is not None:
        later = later.filter(F.col("epoch") <= before)
    later = later.drop("epoch")
    if found["upto"] < 0:
        return later
    return spark.read.schema(schema).parquet(f"{store}/sums/upto={found['upto']}").unionByName(later)


def running_labels(spark: SparkSession, store: str, dedupe_agents: bool | None = None) -> DataFrame:
    """``idx, prediction`` from everything counted so far, nothing before the first batch."""
    kept = _check(spark, store, dedupe_agents)
    found = _sum(_counted(spark, store), kept)
    return parse.majority(parse.count_votes(found) if kept else found)


def running_scores(spark: SparkSession, store: str, table: DataFrame, target: str, strategy: str,
                   dedupe_agents: bool | None = None) -> DataFrame:
    """Accuracy and macro-F1 of everything counted so far."""
    found = attach_truth(running_labels(spark, store, dedupe_agents), table, target)
    return scoring.evaluate(found.withColumn("strategy", F.lit(strategy)), ["strategy"])
