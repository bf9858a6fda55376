"""The filter audit against removing documents one filter after another."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.llm import filteraudit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(docs):
    """(part, failed letters, id) of [(id, text, source)]."""
    out = []
    for i, text, source in docs:
        t = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        failed = set()
        if len(words) < 50:
            failed.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            failed.add("C")
        if any(c in "#$%&*|" for c in t):
            failed.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            failed.add("E")
        out.append((source or "", failed, i))
    return out


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = fails(docs)
    out, shapley = [], {}
    for part in {p for p, _, _ in rows}:
        mine = [(f, i) for p, f, i in rows if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                kept = [x for x in left if letter not in x[0]]
                failing = sum(letter in f for f, _ in mine)
                out.append([part, "".join(order), step, len(kept), len(gone), failing - len(gone), sum(f == {letter} for f, _ in mine),
                            sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), letter])
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                left = kept
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def got(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit(3)).withColumn("t", F.lit(""))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("x"))
    found = filteraudit.filter_audit(frame, told)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


def test_equals_one_filter_after_another(spark):
    rng = random.Random(9)
    docs = []
    for n in range(150):
        words = [rng.choice(["a", "Bb", "c,", "dé", "e f", "G", "h", "$i", "j"][: rng.choice([3, 9])]) + (str(k) if rng.random() < 0.8 else "") for k in range(rng.choice([0, 3, 49, 50, 51, 90]))]
        docs.append((n, rng.choice([" ", "\n", "\t \x0b"]).join(words), rng.choice(["web", "web", "web", "book", None, ""])))
    docs += [(200 + n, docs[5][1], "web") for n in range(40)] + [(300, None, "book"), (301, "", "void"), (None, docs[5][1], "web")]
    docs += [(3, docs[3][1], "book"), (400, "x " * 60_000 + "Y" * 4000, "long"), (401, "W%d " * 50, "long")]
    labels = [(n, rng.choice([0, 1, None]), rng.choice([0, 1])) for n in range(0, 240, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert got(spark, docs, labels) == plain(docs, labels)


@pytest.mark.parametrize("docs", [[], [(1, None, None)], [(1, "a", "s"), (2, "a", "s")]])
def test_small_tables(spark, docs):
    assert got(spark, docs, []) == plain(docs, [])


def test_walk_equals_sums_over_cells():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, size=(3, 32, 3))
    states = filteraudit.survivors(counts)
    for chosen in range(32):
        free = [m for m in range(32) if not m & chosen]
        assert (states[:, chosen] == counts[:, free].sum(axis=1)).all()
