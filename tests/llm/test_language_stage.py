"""The language stage on texts of languages and scripts that the corpus does not teach."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language
from tessera.llm.texts import fold

SMALL = "/root/testdata/sf0.01"
FOREIGN = [
    "Съешь ещё этих мягких французских булок да выпей чаю. Она пришла домой поздно вечером.",
    "日本語のテキストです。今日は天気がいいから散歩しましょう。",
    "Το γρήγορο καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και φεύγει.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri."]


def test_unlearned_languages_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    shape = docs.first().asDict()
    more = spark.createDataFrame([shape | {"doc_id": 10 ** 6 + i, "text": t, "lang": None} for i, t in enumerate(FOREIGN)], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.keep_language(spark, docs.unionByName(more), SMALL).collect()}
    assert not any(i >= 10 ** 6 for i in got)
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert got == lettered


def test_languages_of_long_documents_are_learned(spark):
    english, finnish = "Plain words make a plain text of the day. ", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina. "
    made = [(i, english + f"Number {'x' * i}.", "en") for i in range(6)] + [(10 + i, (finnish + "y" * i + " ") * 1500, "fi") for i in range(6)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert model.languages == ["en", "fi"]
    assert all(r["_lang_pred"] == r["lang"] for r in language.predicted(docs, model).collect())
    books = docs.filter("lang = 'fi'")
    assert {r["_lang_pred"] for r in language.predicted(books, language.train(books, F.lit(True))).collect()} == {"fi"}


def test_more_languages_than_landmarks(spark, monkeypatch):
    monkeypatch.setattr(language, "LANDMARKS", 4)
    docs = spark.createDataFrame([(i, chr(0x561 + i % 9) * 40, f"l{i % 9}") for i in range(90)], "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert len(model.languages) == 9
    assert all(r["_lang_pred"] == r["lang"] for r in language.predicted(docs, model).collect())


def test_found_language_is_kept(spark):
    """A missing or contradicted language is that of the text; a text too short to be sure of keeps what it says."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.filter("n_chars between 2000 and 4000").collect()}
    assert len(texts) == 4
    shape = docs.first().asDict()
    made = [shape | {"doc_id": 10 ** 6 + i, "text": t, "lang": None if i % 2 else "en"} for i, t in enumerate(texts.values())]
    short = shape | {"doc_id": 2 * 10 ** 6, "text": "a", "lang": "fr"}
    more = spark.createDataFrame([*made, short], docs.schema)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_language(spark, docs.unionByName(more), SMALL).collect()}
    assert {i: x for i, x in got.items() if 10 ** 6 <= i < 2 * 10 ** 6} == {10 ** 6 + i: x for i, x in enumerate(texts)}
    assert got[2 * 10 ** 6] == "fr"
    assert {r["doc_id"]: r["lang"] for r in docs.collect()} == {i: x for i, x in got.items() if i < 10 ** 6}


def test_language_of_held_out_documents_only_is_learned(spark):
    """No document goes because a hash of its key held it out."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    shape = docs.first().asDict()
    keys = [r["id"] for r in spark.range(10 ** 6, 10 ** 6 + 40).filter(fold("id") == 0).collect()]
    greek = [shape | {"doc_id": k, "text": FOREIGN[2] + "α" * i, "lang": "el"} for i, k in enumerate(keys)]
    got = corpus_pipeline.keep_language(spark, docs.unionByName(spark.createDataFrame(greek, docs.schema)), SMALL)
    assert keys and {r["doc_id"] for r in got.filter("lang = 'el'").collect()} == set(keys)


def test_cuts_are_of_all_held_out_documents(spark, monkeypatch):
    """A language's cuts are those of its own documents, however many; one odd text of 2,000 moves nothing, 40 do."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs, fold("doc_id") != 0)
    seen = []
    plain = language.judge
    monkeypatch.setattr(language, "judge", lambda *a: seen.append(a) or plain(*a))
    text = docs.filter("lang = 'en'").first()["text"][:200]
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 7, F.lit(FOREIGN[3])).otherwise(
        F.lit(text)).alias("text"), F.lit("en").alias("lang"))
    _, score, _, share = model.judged(pa.array([text, FOREIGN[3]]))
    odd = model.languages[model.judged(pa.array([FOREIGN[3]]))[0][0]] == "en"
    least = language.cuts(rows, model, F.lit(True))["en"]
    low = 1 if odd else 0
    assert least == pytest.approx((min(0.5, language.SLACK * round(score[low], 4)), language.SLACK * round(share[low], 4)), abs=1e-9)
    assert len(seen) == 1
