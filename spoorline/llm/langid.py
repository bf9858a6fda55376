"""Language identification with spans: word scores and a Viterbi walk over languages.

A word is a run of letters. Each of its letters adds the log likelihood of the trigram
around it in every learned language; languages whose training text hardly uses the word's
script are out for that word. The best path over the words pays `switch` for every change
of language, which yields spans; the text's language is the one with most letters.

The model is a table of trigram scores over a small alphabet for each script, counted by
Spark on a sample of each label's rows (chosen by a hash of the id): about an equal share of
`sample`, `LEAST_ROWS` where there are many labels, all rows of a label that has fewer, and
one in any case. Letters are chosen by their share in the label that uses them most. The
model's size is bounded by the alphabet, `LETTERS` cubed per language, whatever the input.

A text that is null or has no letter gives `und` with score 0. Equal texts give equal
results; a table without rows gives none. Ids and labels are never read in a prediction.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import bounded_batches, packed, unpacked

LETTERS = 62
LEAST_ROWS = 200
UNKNOWN = "und"
FOUND = {
    "lang_pred": "string",
    "score": "double",
    "span_lang": "array<string>",
    "span_start": "array<int>",
    "span_end": "array<int>",
}
#: Batches of this many code points are worked on at a time.
PIECE = 500_000

# The blocks of the scripts (first, last code point).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


def script_table() -> np.ndarray:
    """Per code point 0 for no letter, 1 for a letter of another script, else the script."""
    letters = np.fromiter(
        (chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1
    )
    out = letters.astype(np.uint8)
    for number, blocks in enumerate(SCRIPTS.values(), 2):
        for first, last in blocks:
            span = out[first : last + 1]
            span[span > 0] = number
    return out


_scripts: list[np.ndarray] = []


def scripts() -> np.ndarray:
    if not _scripts:
        _scripts.append(script_table())
    return _scripts[0]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between zeros, and where each begins."""
    points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in texts]
    sizes = np.fromiter((len(p) + 1 for p in points), dtype=np.int64, count=len(points))
    out = np.zeros(sizes.sum() + 1, dtype=np.uint32)
    starts = np.cumsum(sizes) - sizes + 1
    for at, p in zip(starts.tolist(), points, strict=True):
        out[at : at + len(p)] = p
    return out, starts


def folded(text: str) -> str:
    """Lower case, code point by code point, so that offsets stay those of the text."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def trigrams(ids: np.ndarray) -> np.ndarray:
    """At each place the number of the trigram around it."""
    wide = ids.astype(np.int32)
    out = wide * LETTERS
    out[1:] += wide[:-1] * (LETTERS * LETTERS)
    out[:-1] += wide[1:]
    return out


@dataclass(frozen=True)
class Model:
    langs: list[str]
    alphabet: list[int]
    scores: np.ndarray  # trigram x language
    allowed: np.ndarray  # script x language

    def numbers(self) -> np.ndarray:
        out = np.where(scripts() > 0, LETTERS - 1, 0).astype(np.uint8)
        last = np.zeros(len(SCRIPTS) + 2, dtype=np.uint8)
        for point in self.alphabet:
            script = scripts()[point]
            last[script] += 1
            out[point] = last[script]
        return out


def training_rows(docs: DataFrame, id: str, lang: str) -> DataFrame:
    return docs.where(F.col(lang).isNotNull() & ~held_out(F.col(id)))


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(known: DataFrame, id: str, lang: str, sample: int) -> DataFrame:
    """About an equal number of rows of each label, at least one."""
    place = F.shiftrightunsigned(F.xxhash64(id), 2)
    labels = known.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    if sum(row["n"] for row in labels) <= sample:
        return known
    share = max(-(-sample // len(labels)), LEAST_ROWS)
    cuts = [(row["l"], max(row["first"], (min(share, row["n"]) << 62) // row["n"])) for row in labels]
    cuts = known.sparkSession.createDataFrame(cuts, "label_ string, cut_ long")
    return known.join(F.broadcast(cuts), F.col(lang) == F.col("label_")).where(place <= F.col("cut_"))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 6000) -> Model:
    """Counts letters, scripts and trigrams of a bounded sample of labelled rows."""
    bounded_batches(docs.sparkSession)
    known = sampled(training_rows(docs, id, lang), id, lang, sample)
    narrow = known.select(F.col(text).alias("t"), F.col(lang).alias("l"))

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("l")["t"]:
                points, _ = codes_of([folded(x or "") for x in texts])
                points, counts = np.unique(points[scripts()[points] > 0], return_counts=True)
                yield pd.DataFrame({"l": name, "k": points.astype(np.int64), "n": counts})

    seen = narrow.mapInPandas(letters, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n"))
    seen = seen.toPandas().sort_values(["l", "k"])
    langs = sorted(seen["l"].unique())
    size = len(SCRIPTS) + 2
    used = np.zeros((size, len(langs)))
    for row in seen.itertuples():
        used[scripts()[row.k], langs.index(row.l)] += row.n
    allowed = used >= 0.01 * used.sum(axis=0, keepdims=True)
    seen["share"] = seen["n"] / seen.groupby("l")["n"].transform("sum")
    top = seen.groupby("k")["share"].max().reset_index()
    top["script"] = scripts()[top["k"].to_numpy(dtype=np.int64)]
    top = top[allowed.any(axis=1)[top["script"]]].sort_values(["share", "k"], ascending=[False, True])
    alphabet = sorted(top.groupby("script").head(LETTERS - 2)["k"].tolist())
    allowed[~allowed.any(axis=1)] = True
    empty = Model(langs, alphabet, np.zeros((0, 0)), allowed)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = empty.numbers()
        for batch in batches:
            for name, texts in batch.groupby("l")["t"]:
                points, _ = codes_of([folded(x or "") for x in texts])
                ids = numbers[points]
                keys, counts = np.unique(trigrams(ids)[ids > 0], return_counts=True)
                yield pd.DataFrame({"l": name, "k": keys.astype(np.int64), "n": counts})

    counted = narrow.mapInPandas(grams, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n"))
    counts = np.full((LETTERS**3, len(langs)), 0.5)
    for row in counted.toPandas().itertuples():
        counts[row.k, langs.index(row.l)] += row.n
    scores = np.log(counts / counts.sum(axis=0, keepdims=True)) if langs else counts
    return Model(langs, alphabet, scores.astype(np.float32), allowed)


def word_scores(model: Model, numbers: np.ndarray, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Words of all texts: scores, sizes, first place in the text, number of the text."""
    points, starts = codes_of([folded(x) for x in texts])
    ids = numbers[points]
    edge = np.diff((ids > 0).astype(np.int8))
    begin, end = np.flatnonzero(edge > 0) + 1, np.flatnonzero(edge < 0) + 1
    if not len(begin):
        return np.zeros((0, len(model.langs))), begin, begin, begin
    letters = ids > 0
    grams = trigrams(ids)[letters]
    at = np.cumsum(end - begin) - (end - begin)
    sums = np.add.reduceat(model.scores[grams], at, axis=0)
    sums[~model.allowed[scripts()[points[begin]]]] -= 1e4
    owner = np.searchsorted(starts, begin, side="right") - 1
    return sums, end - begin, begin - starts[owner], owner


def walk(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best path's language for each word of one text."""
    n, k = scores.shape
    back = np.empty((n, k), dtype=np.uint8)
    value = scores[0].astype(np.float64)
    stay = np.arange(k)
    for i in range(1, n):
        best = int(value.argmax())
        jump = value[best] - switch
        moved = value < jump
        back[i] = np.where(moved, best, stay)
        value = np.where(moved, jump, value) + scores[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = value.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def paths(scores: np.ndarray, owner: np.ndarray, switch: float) -> np.ndarray:
    """The best path of every text. `owner` ascends.

    Where no stretch gains more than one switch over the language that is best for the
    whole text, that language's straight path is the best; only other texts are walked.
    """
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[begin, len(owner)])
    which = np.repeat(np.arange(len(begin)), size)
    best = np.add.reduceat(scores.astype(np.float64), begin, axis=0).argmax(axis=1)
    path = best[which]
    gain = np.zeros(len(begin))
    for lang in range(scores.shape[1]):
        more = (scores[:, lang] - scores[np.arange(len(path)), path]).astype(np.float64)
        run = np.cumsum(more)
        before = np.r_[0.0, run[:-1]]
        base = before[begin][which]
        room = np.abs(more).sum() + 1
        low = np.minimum.accumulate(before - base - which * room) + which * room
        gain = np.maximum(gain, np.maximum.reduceat(run - base - low, begin))
    for doc in np.flatnonzero(gain > switch * 0.999):
        part = slice(begin[doc], begin[doc] + size[doc])
        path[part] = walk(scores[part], switch)
    return path


def label_texts(model: Model, numbers: np.ndarray, texts: list[str], switch: float) -> list[tuple]:
    """Per text (language, share of its letters, spans' languages, starts and ends)."""
    out: list[tuple] = [(UNKNOWN, 0.0, [], [], [])] * len(texts)
    if not model.langs or not texts:
        return out
    scores, size, place, owner = word_scores(model, numbers, texts)
    if not len(owner):
        return out
    path = paths(scores, owner, switch)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(owner)] - 1
    letters = np.add.reduceat(size, first)
    totals = np.zeros((len(texts), len(model.langs)))
    np.add.at(totals, (owner[first], path[first]), letters)
    top = totals.argmax(axis=1)
    whole = totals.sum(axis=1)
    bounds = np.searchsorted(owner[first], np.arange(len(texts) + 1))
    starts, ends = place[first].tolist(), (place[last] + size[last]).tolist()
    names = [model.langs[x] for x in path[first]]
    for doc in np.flatnonzero(whole):
        a, b = bounds[doc], bounds[doc + 1]
        share = float(totals[doc, top[doc]] / whole[doc])
        out[doc] = (model.langs[top[doc]], share, names[a:b], starts[a:b], ends[a:b])
    return out


def pieces(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > PIECE:
            yield held
            held, size = [], 0
    yield held


def predict(docs: DataFrame, model: Model, text: str = "text", switch: float = 12.0) -> DataFrame:
    """Adds lang_pred, score and the spans' languages and code point offsets.

    Every other column is kept, one named as a result is replaced by it; only the text goes
    through Python.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(map(" ".join, FOUND.items())))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        numbers = own.numbers()
        for batch in batches:
            texts = [x or "" for x in batch]
            rows = [row for part in pieces(texts) for row in label_texts(own, numbers, part, switch)]
            yield pd.DataFrame(rows, columns=list(FOUND))

    rows = packed(docs).withColumn("found", run(F.col("row").getField(text)))
    return unpacked(rows, docs, **{name: F.col("found").getField(name) for name in FOUND})
