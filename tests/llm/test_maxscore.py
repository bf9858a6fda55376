"""Exact top-k against the scores of all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spoorline.llm import maxscore


def plain(rows, k, every=20):
    """rows: [(id, embedding)]; the sorted results of every query row."""
    kept = []
    for i, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in e]))
    out = []
    for at, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        others = [(sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(kept) if n != at]
        others.sort(key=lambda t: (-t[0], t[1] is None, t[1] or 0))
        out += [(i, rank, j, s) for rank, (s, j) in enumerate(others[:k], 1)]
    return sorted(out, key=repr)


def got(spark, rows, k):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("copies", F.lit(2))
    found = maxscore.exact_topk(maxscore.quantized(frame), F.col("vec_id") % 20 == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "LEAST_ROWS", 64)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    rows = [(n, (centres[n % 6] + rng.normal(size=24) * 0.4).astype("float32").tolist()) for n in range(600)]
    rows += [(1000 + n, rows[40][1]) for n in range(60)]  # a group of copies: ties go to the smaller id
    assert got(spark, rows, 20) == plain(rows, 20)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(n, rng.integers(-3, 4, size=4).astype(float).tolist()) for n in range(50)]
    rows += [(60, None), (61, []), (80, [1.0]), (81, [1.0, None]), (82, [float("nan")] * 4), (83, [float("inf")] * 4)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0]), rows[20], rows[20], rows[21], (40, [0.5, 0.0, 0.0, 0.0]), (100, [-0.01] * 6)]
    assert got(spark, rows, 5) == plain(rows, 5)
    assert got(spark, rows, 200) == plain(rows, 200)


@pytest.mark.parametrize("rows", [[], [(20, [1.0])], [(3, [1.0]), (4, [2.0])], [(20, None)]])
def test_no_partner(spark, rows):
    assert got(spark, rows, 5) == []


def test_large_components_are_exact():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-(2**28), 2**28, size=(300, 8))
    query = vectors[7]
    frame = pd.DataFrame({"vec_id": range(300), "v": list(vectors)})
    asked = pd.DataFrame({"query_key": [0], "query_id": [7], "v": [query]})
    (found,) = maxscore.search_block(frame, asked, 10)
    exact = sorted(((-int(sum(int(a) * int(b) for a, b in zip(query, v))), n) for n, v in enumerate(vectors) if n != 7))[:10]
    assert [(-s, n) for s, n in exact] == list(zip(found["score"], found["vec_id"]))


def test_non_essential_terms_are_probed_for_few():
    """On clustered vectors, most rows are dropped before their last terms."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 64)) * 8
    vectors = np.floor(centres[rng.integers(20, size=4000)] + rng.normal(size=(4000, 64))).astype(np.int64)
    shard = maxscore.Shard(vectors, np.float64)
    query = vectors[11].astype(float)
    rows, scores = shard.search(query, 20, 11)
    full = query @ vectors.T
    full[11] = -np.inf
    assert sorted(scores, reverse=True) == sorted(full, reverse=True)[:20]
    bound = np.sort(shard.bounds(query))
    assert bound.cumsum().searchsorted(scores[-1]) > 16
