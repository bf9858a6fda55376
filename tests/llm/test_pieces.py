"""Viterbi pieces against a plain search and the library's own, and exact round trips."""

import math
import random
import struct

import numpy as np
import public_tokenizers
import sentencepiece

from spoorline.llm import pieces as p

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  two  spaces ", "Hello world, the end.", "Erentha thnttionwh\nÜber\tnaïve", "ein 漢字 😀 test", "x" * 300,
    "tail ", "\n\n", "a b", "12345 6.7", "Straße façade señor",
]


def unigram_file(folder):
    """The public pieces with the log of their rank as scores and the unigram type."""
    raw = open(PATH, "rb").read()
    out, at, rank = [], 0, 0
    while at < len(raw) and raw[at] == 0x0A:
        size, body = p.varint(raw, at + 1)
        own = raw[body : body + size]
        found = p.fields(own)
        if found.get(3, 1) == 1:
            rank += 1
            score = struct.pack("<f", -math.log(rank + 5.0) - 1)
            own = own.replace(b"\x15" + found[2], b"\x15" + score, 1)
        out.append(raw[at:body] + own)
        at = body + size
    rest = raw[at:]
    kind = rest.index(b"\x18\x02")
    path = folder / "unigram.model"
    path.write_bytes(b"".join(out) + rest[:kind] + b"\x18\x01" + rest[kind + 2 :])
    return str(path)


def plain(own, word):
    """The best unigram segmentation by trying every start at every end."""
    scores = {own.pieces[i]: (s, i) for i, s in zip(own.key_ids.tolist(), own.key_scores.tolist(), strict=True)}
    best = [(0.0, [])]
    for j in range(1, len(word) + 1):
        top = None
        for i in range(max(0, j - own.longest), j):
            score, piece = scores.get(word[i:j], (None, None))
            if score is None:
                if i < j - 1:
                    continue
                score, tail = own.unknown_score, [own.byte_ids[b] for b in word[i:j].encode()]
            else:
                tail = [piece]
            if top is None or best[i][0] + score > top[0]:
                top = (best[i][0] + score, best[i][1] + tail)
        best.append(top)
    return best[-1][1]


def some_words(letters, count):
    rng = random.Random(8)
    return ["".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(count)]


def test_unigram_words_equal_the_plain_search_and_the_library(tmp_path):
    path = unigram_file(tmp_path)
    own = p.Vocabulary(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert own.unigram
    words = some_words("thenraoiéß漢😀.", 300)
    for word, got in zip(words, own.encode(words), strict=True):
        assert got.tolist() == plain(own, p.MARK + word)
    texts = [" ".join(some_words("etaoinsrhld", 400))]
    assert own.encode(texts)[0].tolist() == library.encode(texts[0])


def test_merges_equal_the_library():
    own = p.Vocabulary(PATH)
    assert not own.unigram
    rng = random.Random(9)
    texts = TEXTS + [" ".join(some_words("etaoinsrhldéüß", 3000)), " ".join(some_words("the.,!0129 ▁漢😀\n", 1000))]
    texts += ["".join(rng.choices("aehnt  \n", k=rng.randrange(80))) for _ in range(300)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == own.model.encode(text)


def test_round_trip():
    own = p.Vocabulary(PATH)
    for text, ids in zip(TEXTS, own.encode(TEXTS), strict=True):
        assert own.decode(ids) == text
        assert own.model.decode(ids.tolist()) == text or text.startswith(" ")


def test_columns_nulls_and_no_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "word " * 50_000, "z"), (3, "the", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = docs.select("doc_id", "text", p.encode(docs.text, PATH).alias("own"))
    got = coded.select("doc_id", "text", "own", p.decode(coded.own, PATH).alias("back")).collect()
    assert [r["back"] for r in got] == [r["text"] or "" for r in got]
    assert got[0]["own"] == [] and np.asarray(got[3]["own"]).size == 1
    whole = docs.select(p.round_trip(docs.text, PATH).alias("x")).select("x.*").collect()
    assert [(r["ids"], r["back"]) for r in whole] == [(r["own"], r["back"]) for r in got]
    assert docs.limit(0).select(p.encode(docs.text, PATH)).collect() == []
