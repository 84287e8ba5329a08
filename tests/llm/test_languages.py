from pyspark.sql import functions as F

from leadloom.llm import language


def test_every_language_is_learned(spark):
    rows = [(i, chr(0x4E00 + i // 2) * 40, f"l{i // 2:03}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs, F.lit(True))
    assert model.languages == [f"l{i:03}" for i in range(100)]
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(docs, model).collect())


def test_a_language_of_few_long_documents_is_learned_within_its_bytes(spark):
    rows = [(i, f"{i} " + "abc " * 50_000, "long") for i in range(3)] + [(i, f"xyz {i} " * 20, "many") for i in range(3, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs, F.lit(True), training_bytes=5_000)
    assert model.languages == ["long", "many"]
    everything = language.learn(docs, F.lit(True))
    assert len(model.grams[language.ORDER]) < len(everything.grams[language.ORDER])
