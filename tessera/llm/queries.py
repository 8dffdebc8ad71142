"""Registered queries of the operators, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, ctw, editprint, jaccard, language, licenses, mixing, quality, resharding, segmentation, simhash, spelling, topk
from tessera.llm.texts import fold
from tessera.session import cut_lineage, spread

OLD_SHARDS = 20
NEW_SHARDS = 24
ACCEPT = 0.3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_sample_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    rows = segmentation.encoded(docs, "doc_id", "text", decoded=True)
    return rows.select("doc_id", F.col("_ids").alias("ids"), F.size("_ids").alias("n_pieces"),
                       F.col("_log_prob").alias("log_prob"), F.col("_decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"), fold("doc_id") != 0)
    scored = spread(docs).withColumn("score", quality.scorer(model)("text"))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op3_ctw(spark: SparkSession, sf: str) -> DataFrame:
    rows = ctw.score(table(spark, sf, "documents"), fold("doc_id") != 1)
    return rows.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                       "score", "n_bytes")


def op4_reshard(spark: SparkSession, sf: str) -> DataFrame:
    """From 20 shards by text hash, uneven where texts have many copies, to 24 of equal bytes."""
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(OLD_SHARDS))
    rows = resharding.measured(table(spark, sf, "documents"), "doc_id", "text", old)
    plan = resharding.reshard(cut_lineage(rows, "sizes"), NEW_SHARDS, "doc_id")
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
                       "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, fold("doc_id") != 0)
    found = language.predicted(spread(docs.select("doc_id", "text")), model)
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("_lang_pred").alias("lang_pred"),
                        F.col("_lang_score").alias("score"))


def op6_mix(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf, "documents"))
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                       F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"),
                       F.col("_copies").alias("copies"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op8_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.scaled(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 100 == 0, 10)


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scanned(spread(table(spark, sf, "documents").select("doc_id", "text")))
    return found.select("doc_id", F.array_join("_licenses", ",").alias("licenses"),
                        F.array_join("_sentences", ",").alias("sentence_ids"), F.col("_unknown").alias("unknown"))


def op10_edit_prints(spark: SparkSession, sf: str) -> DataFrame:
    return editprint.compared(table(spark, sf, "documents").select("doc_id", "text"))


def op11_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.joined(table(spark, sf, "documents"))


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignments(table(spark, sf, "documents"))


def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents"))


QUERIES = {"op1_sample_pieces": op1_sample_pieces, "op2_quality": op2_quality,
           "op3_ctw": op3_ctw, "op4_reshard": op4_reshard,
           "op5_language": op5_language, "op6_mix": op6_mix,
           "op7_simhash": op7_simhash, "op8_topk": op8_topk, "op9_licenses": op9_licenses, "op10_edit_prints": op10_edit_prints,
           "op11_jaccard": op11_jaccard, "op12_alignment": op12_alignment, "op13_spelling": op13_spelling}

SQL = {
    "op11_jaccard": jaccard.sql(),
    "op13_spelling": spelling.sql(),
    "op9_licenses": licenses.sql(),
    "op6_mix": """
WITH body AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM body),
rated AS (SELECT doc_id, source, len(w) AS size,
  CASE WHEN len(w) > 0 THEN greatest(CAST(length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) AS DOUBLE)
    / length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))
    * least(CAST(len(list_distinct(w)) AS DOUBLE) / least(len(w), 64), 1.0), 0.05) ELSE 0.05 END AS quality,
  (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text), 1, 13) AS BIGINT) + 0.5)
    / 4503599627370496.0 AS u FROM words),
sources AS (SELECT source, sum(size) AS source_size,
  (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM rated GROUP BY source),
filled AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS words_left,
  sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left FROM sources
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT *, 3 * source_size * weight_left <= weight * words_left AS held FROM filled),
targets AS (SELECT source, source_size, CASE WHEN held THEN CAST(3 * source_size AS DOUBLE) ELSE
  weight * CAST(sum(source_size) OVER () - sum(CASE WHEN held THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE)
  / sum(CASE WHEN held THEN 0 ELSE weight END) OVER () END AS target FROM held),
ordered AS (SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
  coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY -ln(u) / quality, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rated r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, epochs + CAST(2 * start + size <= 2 * (target - epochs * source_size) AND size > 0 AS BIGINT)
  AS copies FROM ordered)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE)
  AS target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM taken""",
    "op8_topk": """
WITH whole AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scaled AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM whole),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, vec_id, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
