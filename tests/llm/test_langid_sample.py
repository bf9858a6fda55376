"""Every label is learned, however rare, and the letters of every script."""

import random

from pyspark.sql import functions as F

from spoorline.llm import langid as m


def test_a_rare_label_is_learned(spark):
    rng = random.Random(1)
    common, rare = ["karu", "tola", "miri", "santo"], ["wxzq", "ghyth", "ztrk", "qwyx"]
    rows = [(i, " ".join(rng.choices(common, k=5)), "aa") for i in range(20_000)]
    rows += [(i, " ".join(rng.choices(rare, k=5)), "bb") for i in range(20_000, 20_003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = m.fit(docs, sample=10)
    assert model.langs == ["aa", "bb"]
    texts = spark.createDataFrame([(1, "wxzq ztrk"), (2, "tola karu")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in m.predict(texts, model).collect()} == {1: "bb", 2: "aa"}
    sizes = m.sampled(m.training_rows(docs, "doc_id", "lang"), "doc_id", "lang", 10).groupBy("lang").count().collect()
    sizes = {r["lang"]: r["count"] for r in sizes}
    assert 100 < sizes["aa"] < 350 and sizes["bb"] == docs.where((F.col("lang") == "bb") & ~m.held_out(F.col("doc_id"))).count()


def test_letters_of_rare_scripts_stay_apart(spark):
    letters = [chr(c) for c in range(0x100, 0x180) if chr(c).islower()][:58]
    rows = [(i, " ".join(letters) * 20, "aa") for i in range(40)]
    rows += [(i, "абвг " * 5, "ru") for i in range(40, 60)] + [(i, "гвба " * 5, "bg") for i in range(60, 80)]
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set("абвг") <= {chr(c) for c in model.alphabet} and len(model.alphabet) == 62
    texts = spark.createDataFrame([(1, "гвба"), (2, "абвг")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in m.predict(texts, model).collect()} == {1: "bg", 2: "ru"}
