"""Memory of the Python workers: pieces of bounded size, freed memory given back."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from tessera.llm import language, quality, segmentation
from tessera.llm.texts import pieces
from tessera.session import bound_batches, local_table


def test_texts_are_measured_in_small_pieces(spark, monkeypatch):
    texts = pa.array([f"some words of text {i}, " * 200 for i in range(400)])
    whole = quality.features(next(pieces(texts)))
    seen, given_back, real, grams = [], [], quality.features, language.grams
    monkeypatch.setattr(quality, "features", lambda piece: seen.append(piece.nbytes) or real(piece))
    monkeypatch.setattr(language, "grams", lambda piece: seen.append(piece.nbytes) or grams(piece))
    assert np.allclose(quality.measure(texts), whole)
    assert language.Landmarks.of(["some words", "other text"]).kernel(texts).shape == (400, 2)
    assert len(seen) > 6 and max(seen) < 600_000 and segmentation.PIECE_BYTES <= 1_000_000
    monkeypatch.setattr(quality, "release", lambda: given_back.append(1))
    score = quality.scorer(quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0)))
    assert score.func(texts).to_pylist() == [0.5] * 400 and given_back


def test_arrow_batches_end_at_a_number_of_bytes(spark, monkeypatch):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 200).alias("text"))
    sizes = lambda rows: rows.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in it), "n long")
    spark.conf.unset(limit)
    try:
        segmentation.encoded(docs, "doc_id", "text")
        found = [r["n"] for r in sizes(docs).collect()]
        assert max(found) < 2_200_000 and sum(found) > 8_000_000
        spark.conf.set(limit, "1m")
        bound_batches(spark)
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit)


def test_local_tables_start_no_python_workers(spark):
    made = local_table(spark, {"_lang": pa.array(["de", None]), "_n": pa.array([1, 2], pa.int64())})
    assert [tuple(r) for r in made.collect()] == [("de", 1), (None, 2)]
    assert "PythonRDD" not in made._jdf.queryExecution().toRdd().toDebugString()
