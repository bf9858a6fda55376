"""Which documents hold test items: BM25 over an inverted index of the items, then overlap.

Every document is cut into overlapping passages of words, long enough that an item lies
whole in one of them. Each passage is a query on the index of the items; an item's score
is taken as a share of the score that the item's own text would have, so that one
threshold fits all. Postings lie in blocks of items and carry the block's highest impact
per term: as in block-max WAND with a fixed threshold, a passage whose terms' highest
impacts cannot reach it is passed over, and so is each block whose maxima cannot; only
the other blocks are opened. All items above the threshold are retrieved, none is capped.

A retrieved item is verified by its five-word shingles: `question` is the share of those
of the item without its last sentence that the passages hold, `answer` the share of the
last sentence's words that stand beside them. Both must reach their bounds. An item of a
single sentence is all question; one of fewer than five words must stand there whole.

The index goes to the tasks in slices of at most `slice_terms` postings, so no broadcast
grows with the items; document frequencies are those of all items. Nulls: a null text is
empty; an item without words never matches; null ids are kept. Equal rows repeat their
rows. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import bounded_batches

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK = 16
#: Passages of a text, times blocks of items, that are looked up together.
TOGETHER = 1 << 18


@dataclass
class Index:
    """Items by number; postings by term, ordered by block and item."""

    ids: list
    words: list[np.ndarray]  # each item's terms in order
    answer_at: list[int]  # the first word of the last sentence
    terms: dict[str, int]
    post_from: np.ndarray
    post_item: np.ndarray
    post_share: np.ndarray  # impact as a share of the item's own score
    block_from: np.ndarray
    block_number: np.ndarray
    block_share: np.ndarray
    block_post: np.ndarray  # the first posting of each block of a term
    highest: np.ndarray  # per term
    size: int
    stride: int


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def last_sentence(text: str) -> int:
    """The number of words before the last sentence; 0 where there is only one."""
    body = text.rstrip().rstrip(".!?")
    at = max(body.rfind(". "), body.rfind("? "), body.rfind("! "), body.rfind("\n"))
    return len(words_of(body[: at + 1])) if at >= 0 else 0


def build(items: list[tuple], frequency: dict[str, int], total: int, mean: float) -> Index:
    terms: dict[str, int] = {}
    words = [np.array([terms.setdefault(w, len(terms)) for w in words_of(t)], dtype=np.int64) for _, t in items]
    names = list(terms)
    df = np.array([frequency.get(t, 1) for t in names], dtype=float)
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    rows = []
    for number, own in enumerate(words):
        term, tf = np.unique(own, return_counts=True)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean))
        if len(own):
            rows.append(np.stack([term, np.full(len(term), number), impact / impact.sum()], axis=1))
    post = np.concatenate(rows) if rows else np.zeros((0, 3))
    post = post[np.lexsort((post[:, 1], post[:, 0]))]
    term, item, share = post[:, 0].astype(np.int64), post[:, 1].astype(np.int64), post[:, 2]
    n = len(names)
    new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)][: len(term)])
    block_share = np.maximum.reduceat(share, new) if len(new) else share
    highest = np.zeros(n)
    np.maximum.at(highest, term, share)
    longest = max([len(w) for w in words] or [1])
    stride = max(32, longest)
    return Index(
        [i for i, _ in items],
        words,
        [last_sentence(t or "") for _, t in items],
        terms,
        np.searchsorted(term, np.arange(n + 1)),
        item,
        share,
        np.searchsorted(term[new], np.arange(n + 1)),
        item[new] // BLOCK,
        block_share,
        np.r_[new, len(term)],
        highest,
        2 * stride,
        stride,
    )


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of several ranges, and the range each belongs to."""
    size = end - start
    owner = np.repeat(np.arange(len(start)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


def retrieve(index: Index, passage: np.ndarray, least: float) -> list[tuple[int, float]]:
    """Items whose share of their own score the passage's distinct terms reach."""
    found = retrieve_all(index, passage, np.array([0]), np.array([len(passage)]), least)
    return [(item, score) for _, item, score in found]


def retrieve_all(
    index: Index, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float
) -> list[tuple[int, int, float]]:
    """(passage, item, score): items whose share of their own score a passage's distinct terms reach.

    Passages are runs of the words. All are looked up together: block maxima first, then the
    postings of those blocks that can still reach the bound for their passage, no others.
    """
    at, owner = ranges(starts, ends)
    term = words[at]
    owner, term = owner[term >= 0], term[term >= 0]
    wide = len(index.highest)
    owner, term = np.divmod(np.unique(owner * wide + term), max(1, wide))
    may = np.bincount(owner, weights=index.highest[term], minlength=len(starts)) >= least
    owner, term = owner[may[owner]], term[may[owner]]
    blocks = len(index.ids) // BLOCK + 1
    entry, which = ranges(index.block_from[term], index.block_from[term + 1])
    where = owner[which] * blocks + index.block_number[entry]
    opened = (np.bincount(where, weights=index.block_share[entry]) >= least)[where] if len(where) else where > 0
    if not opened.any():
        return []
    entry, owner = entry[opened], owner[which[opened]]
    at, which = ranges(index.block_post[entry], index.block_post[entry + 1])
    pair, where = np.unique(owner[which] * len(index.ids) + index.post_item[at], return_inverse=True)
    score = np.bincount(where, weights=index.post_share[at], minlength=len(pair))
    found = score >= least
    passage, item = np.divmod(pair[found], len(index.ids))
    return list(zip(passage.tolist(), item.tolist(), score[found].tolist(), strict=True))


def shingles(words: np.ndarray, width: int) -> set[tuple]:
    own = words.tolist()
    return set(zip(*(own[k : len(own) - width + 1 + k] for k in range(width)), strict=True))


def overlap(index: Index, number: int, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the item's question and answer that a passage holds."""
    own, cut = index.words[number], index.answer_at[number]
    if cut >= len(own):
        cut = 0
    question, answer = (own[:cut], own[cut:]) if cut else (own, own[:0])
    width = min(SHINGLE, len(question))
    want = shingles(question, width)
    there = want & shingles(passage, width)
    if not want:
        return 0.0, 0.0
    if not len(answer):
        return len(there) / len(want), 1.0
    width = min(SHINGLE, len(answer))
    want_answer = shingles(answer, width)
    held = set(passage.tolist())
    beside = sum(w in held for w in answer.tolist()) / len(answer)
    exact = len(want_answer & shingles(passage, width)) / len(want_answer)
    return len(there) / len(want), max(exact, beside)


def search(index: Index, text: str | None, least: float, question: float, answer: float) -> list[tuple]:
    """Verified items of one text: (item id, score, question share, answer share)."""
    own = words_of(text)
    words = np.fromiter(map(index.terms.get, own, repeat(-1)), dtype=np.int64, count=len(own))
    if not len(words):
        return []
    weight = np.where(words >= 0, index.highest[words] if len(index.highest) else 0, 0.0)
    sums = np.r_[0.0, np.cumsum(weight)]
    starts = np.arange(0, max(1, len(words) - index.stride), index.stride)
    ends = np.minimum(starts + index.size, len(words))
    best: dict[int, tuple] = {}
    likely = np.flatnonzero(sums[ends] - sums[starts] >= least - 1e-9)
    many = max(1, TOGETHER // (len(index.ids) // BLOCK + 1))
    for first in range(0, len(likely), many):
        some = likely[first : first + many]
        for k, number, score in retrieve_all(index, words, starts[some], ends[some], least):
            q, a = overlap(index, number, words[starts[some[k]] : ends[some[k]]])
            if q >= question and a >= answer:
                row = (score, q, a)
                best[number] = max(best.get(number, row), row)
    return [(index.ids[number], *best[number]) for number in sorted(best)]


def slices_of(items: DataFrame, id: str, text: str, slice_terms: int) -> Iterator[Index]:
    """Indexes of bounded size that together hold all items."""
    spark = items.sparkSession
    bounded_batches(spark)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text_ in batch["t"]:
                own = words_of(text_)
                yield pd.DataFrame({"term": sorted(set(own)), "size": len(own)}).astype({"term": str})

    rows = items.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t"))
    sizes = rows.select(F.length("t").alias("n")).agg(F.sum("n"), F.count("*")).first()
    parts = 1 + (sizes[0] or 0) // slice_terms
    frequency = rows.mapInPandas(cut, "term string, size long").groupBy("term").count()
    total, length = sizes[1], max(1.0, (sizes[0] or 0) / max(1, sizes[1]) / 6)
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        held = sorted(map(tuple, own.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        mine = spark.createDataFrame([(w,) for w in {w for _, t in held for w in words_of(t)}], "term string")
        known = dict(map(tuple, frequency.join(mine, "term").collect())) if held else {}
        yield build(held, known, total, length)


def _searcher(shared, kind: str, least: float, question: float, answer: float):
    names = ("item", "score", "question", "answer")

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        rows = [search(shared.value, t, least, question, answer) for t in texts]
        return pd.Series([[dict(zip(names, r, strict=True)) for r in x] for x in rows], dtype=object)

    return run


def test_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: float = 0.5,
    question: float = 0.6,
    answer: float = 0.5,
    slice_terms: int = 20_000_000,
) -> DataFrame:
    """Adds `test_items`: the items a text holds with their score and overlaps.

    Only the text goes through Python; all columns are kept and nothing is shuffled.
    """
    kind = "array<struct<item:bigint,score:double,question:double,answer:double>>"
    found = []
    for index in slices_of(items, item_id, item_text, slice_terms):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found.append(_searcher(shared, kind, least, question, answer)(F.col(text)))
    return docs.withColumn("test_items", F.concat(*found))


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """One row per document and item it holds: id, item_of_test, score and the two overlaps."""
    held = test_items(docs, items, **options).where(F.size("test_items") > 0)
    return held.select(F.col(id).cast("long").alias(id), F.explode("test_items").alias("x")).select(
        id,
        F.col("x.item").alias("item_of_test"),
        F.col("x.score").alias("score"),
        F.col("x.question").alias("question_overlap"),
        F.col("x.answer").alias("answer_overlap"),
    )
