"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spoorline.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(docs, least_chars, least_count, rate):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % rate == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1 :]
            if len(run) >= least_chars:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio):
    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(close[w]), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_counts_and_variants_equal_all_pairs(spark):
    rng = random.Random(5)
    stems = ["spelling", "Straßen", "balloon", "ÉTUDES", "aaaaaaa", "variant", "ÀàÀàÀàx"]
    words = []
    for _ in range(6000):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + w[at] + w[at:], w[:at] + rng.choice("abzà") + w[at + 1 :]])
        words.append(w)
    docs = [(n, " ".join(words[n * 60 : n * 60 + 60])) for n in range(100)]
    docs += [(None, "spelling,Spelling;spellings" * 40), (7, None), (8, ""), (9, "x1y2 short"), (10, docs[3][1]), (10, docs[3][1])]
    docs.append((11, "longword" * 30_000 + " " + "balloons " * 20_000))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("w"))
    counts = plain_counts(docs, 6, 5, 199)
    got = variants.spelling_variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == plain_variants(counts, 5)
    assert any(r[1] and r[2] != r[1] for r in plain_variants(counts, 5)), "a chain of two forms"


def test_neighbours_are_written_once(spark):
    words = ["hello", "helo", "hallo", "hellos", "aaa", "aa", "aaaa", "aba", "b", "ab", "", "zz"]
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r.word, r.near) for r in variants.neighbours(frame).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if near(a, b)}
    sums = {r.word: r.n for r in variants.scanned(frame).groupBy("word").agg(F.sum("n_near").alias("n")).collect()}
    assert {w: n for w, n in sums.items() if n} == {w: n for w, n in Counter(a for a, _ in got).items()}


@pytest.mark.parametrize("text", [None, "", "12 34"])
def test_nothing_to_find(spark, text):
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert variants.spelling_variants(frame).count() == 0
    assert variants.spelling_variants(frame.limit(0)).count() == 0
