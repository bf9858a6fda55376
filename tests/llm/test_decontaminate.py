"""BM25 retrieval against scoring every item, and planted items."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from spoorline.llm import decontaminate as m


def words(rng, n):
    return [rng.choice(["the", "of", "and", *(f"w{k}" for k in range(400))]) for _ in range(n)]


def some_items(rng, n=60):
    return [(i, " ".join(words(rng, rng.randrange(4, 50))) + rng.choice(["", ". Short answer here", "\nanother line w5"])) for i in range(n)]


def index_of(items):
    df = Counter(w for _, t in items for w in set(m.words_of(t)))
    return m.build(items, dict(df), len(items), 20.0)


def plain_scores(items, passage):
    df = Counter(w for _, t in items for w in set(m.words_of(t)))
    out = {}
    for i, t in items:
        own = m.words_of(t)
        score = lambda w: (
            math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5))
            * own.count(w) * (m.K1 + 1) / (own.count(w) + m.K1 * (1 - m.B + m.B * len(own) / 20.0))  # noqa: B023
        )
        whole = sum(score(w) for w in set(own))
        if whole:
            out[i] = sum(score(w) for w in set(own) & set(passage)) / whole
    return out


def test_retrieval_equals_scoring_everything():
    rng = random.Random(1)
    items = some_items(rng)
    index = index_of(items)
    for _ in range(300):
        passage = words(rng, rng.randrange(1, 80)) + m.words_of(rng.choice(items)[1])[: rng.randrange(30)]
        ids = np.array([index.terms.get(w, -1) for w in passage])
        want = {i: s for i, s in plain_scores(items, passage).items() if s >= 0.3}
        got = dict(m.retrieve(index, ids, 0.3))
        assert got.keys() == want.keys()
        for i, score in got.items():
            assert score == pytest.approx(want[i])


def test_planted_items_are_found_wherever_they_stand(spark):
    rng = random.Random(2)
    items = some_items(rng, 30)
    rows, want = [], set()
    for d in range(120):
        body = [f"x{rng.randrange(5000)}" for _ in range(rng.randrange(400))]
        if d % 2:
            i, text = items[rng.randrange(30)]
            at = rng.randrange(len(body) + 1)
            body[at:at] = [text.upper() if d % 3 else text]
            want.add((d, i))
        rows.append((d, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_of_test"]) for r in m.contaminated(docs, tests).collect()}
    assert got == want
    parts = {(r["doc_id"], r["item_of_test"]) for r in m.contaminated(docs, tests, slice_terms=1000).collect()}
    assert parts == want


def test_question_without_answer_is_not_enough(spark):
    question, answer = " ".join(f"q{k}" for k in range(20)), "only this answer counts"
    tests = spark.createDataFrame([(1, f"{question}? {answer}.")], "item_id long, text string")
    rows = [(1, question), (2, f"a {question} b {answer}"), (3, answer)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in m.contaminated(docs, tests).collect()] == [2]


def test_nulls_ties_long_texts_and_no_rows(spark):
    item = " ".join(f"t{k}" for k in range(30))
    tests = spark.createDataFrame([(1, item), (1, item), (2, None), (None, ""), (3, "...")], "item_id long, text string")
    rows = [(1, None, 0), (2, "", 0), (None, item, 0), (4, item, 0), (4, item, 0), (5, "z " * 200_000 + item, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, test_items long")
    got = [(r["doc_id"], r["item_of_test"]) for r in m.contaminated(docs, tests).collect()]
    assert sorted(got, key=str) == sorted([(None, 1), (4, 1), (4, 1), (5, 1)] * 2, key=str)
    assert m.contaminated(docs.limit(0), tests).collect() == []
    assert m.contaminated(docs, tests.limit(0)).collect() == []
