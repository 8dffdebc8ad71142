"""From raw documents to sampled token ids: five stages, each an operator of ``tessera.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame
whose written rows are the next stage's ``docs``. All but the last return the columns of ``docs``; working
columns take names that ``docs`` does not have, so further columns of any name pass through. ``sf_dir``
gives the labels.

Null and empty texts have no letter and go at the second stage, if not at the first; rows with null or
repeated keys are rows, of which near-dedup keeps one for each text; a null source is a source. An
empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, quality, segmentation, shingles
from tessera.llm.texts import fold, fresh
from tessera.session import cut_lineage, spread

# Score from which on a document is kept.
MIN_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not take for junk."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, fold("doc_id") != 0)
    score = fresh(docs, "_score")
    scored = spread(docs).withColumn(score, quality.scorer(model)("text"))
    return scored.filter(F.col(score) >= MIN_QUALITY).drop(score)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a language that the corpus teaches, by cuts from all documents that taught nothing.

    ``lang`` is the language found; where the text is too short to be sure of it, a language that was given stays.
    """
    model = language.train(docs, fold("doc_id") != 0, every=True)
    least = language.cuts(docs, model, fold("doc_id") == 0)
    found = fresh(docs, "_found")
    # Past a generator the filter does not ask for the language once more.
    rows = spread(docs).select("*", F.explode(F.array(language.placed(spark, model, least, "text"))).alias(found))
    given = F.when(~F.col(f"{found}.sure"), F.col("lang"))
    return rows.filter(F.col(f"{found}.lang").isNotNull()).withColumn("lang", F.coalesce(given, f"{found}.lang")).drop(found)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest key: SimHash's candidates, and pairs beyond the
    distance of its index by MinHash keys, whose sets of five-word shingles have a likeness of 0.8."""
    return shingles.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document is there as often as the mix takes it."""
    return mixing.mixture(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    slim = docs.select("doc_id", "lang", "source", "text")
    rows = segmentation.encoded(spread(slim), "doc_id", "text", decoded=True)
    return rows.select("doc_id", "lang", "source", F.col("_ids").alias("ids"), F.size("_ids").alias("n_pieces"),
                       F.col("_log_prob").alias("log_prob"), F.col("_decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_copies", drop_near_copies),
          ("mix", mix_sources), ("pieces", sample_pieces)]

# Learned models, components and sampled segmentations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
