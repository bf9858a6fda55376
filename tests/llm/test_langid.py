"""Language identification: the walk against all paths, held-out accuracy, spans."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.llm import langid as m

SF = "/root/testdata/sf0.01"
WORDS = {
    "aa": ["karu", "tola", "miri", "santo", "pela"],
    "bb": ["wxzq", "ghyth", "ztrk", "qwyx", "hjklz"],
    "ru": ["привет", "слово", "язык", "текст", "дом"],
}


def labelled(spark):
    rng = random.Random(1)
    rows = [
        (i, " ".join(rng.choices(WORDS[lang], k=30)), lang)
        for i, lang in enumerate(rng.choices(sorted(WORDS), k=300))
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def best_by_trying(scores, switch):
    n, k = scores.shape
    value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B905, E731
    return max(map(value, itertools.product(range(k), repeat=n))), value


def test_paths_are_best():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.integers(1, 7, size=3)
        scores = rng.normal(0, 3, size=(sizes.sum(), 3))
        owner = np.repeat([0, 2, 5], sizes)
        path = m.paths(scores, owner, 4.0)
        at = 0
        for size in sizes.tolist():
            best, value = best_by_trying(scores[at : at + size], 4.0)
            assert value(path[at : at + size].tolist()) == pytest.approx(best)
            at += size


def test_spans_of_mixed_text(spark):
    model = m.fit(labelled(spark))
    assert model.langs == ["aa", "bb", "ru"]
    first, second = " ".join(WORDS["aa"] * 4), " ".join(WORDS["ru"] * 2)
    docs = spark.createDataFrame([(1, f"{first}. {second}!")], "doc_id long, text string")
    row = m.predict(docs, model).first()
    assert (row["lang_pred"], row["span_lang"]) == ("aa", ["aa", "ru"])
    assert (row["span_start"], row["span_end"]) == ([0, len(first) + 2], [len(first), len(first) + 2 + len(second)])
    assert 0.5 < row["score"] < 1


def test_nulls_ties_long_texts_and_no_rows(spark):
    model = m.fit(labelled(spark))
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "karu " * 100_000, "x"), (5, "İKARU tola", None), (5, "İKARU tola", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = m.predict(docs, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und"] * 3 + ["aa"] * 3
    assert [r["score"] for r in got[:3]] == [0.0] * 3 and got[4] == got[5]
    assert m.predict(docs.limit(0), model).collect() == []
    nothing = m.fit(labelled(spark).limit(0))
    assert {r["lang_pred"] for r in m.predict(docs, nothing).collect()} == {"und"}


def test_labels_and_held_out_rows_are_not_learned(spark):
    docs = labelled(spark)
    changed = docs.withColumn("text", F.when(m.held_out(F.col("doc_id")), "zzzz").otherwise(F.col("text")))
    a, b = m.fit(docs), m.fit(changed)
    assert np.array_equal(a.scores, b.scores) and a.alphabet == b.alphabet


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = m.predict(docs, m.fit(docs)).where(m.held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
