"""The wavelet matrix against a plain list, and token shards against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spoorline.llm import shards as s
from spoorline.llm.common import Kept

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n, high", [(0, 1), (1, 1), (7, 2), (512, 3), (513, 50_000), (3000, 17)])
def test_wavelet_equals_a_list(n, high):
    rng = random.Random(n)
    values = [rng.randrange(high) for _ in range(n)]
    held = s.Wavelet.build(np.array(values, dtype=np.uint32))
    _, _, _, held = s.unpack(s.pack(np.array([1]), np.array([True]), np.array([n]), np.array(values, dtype=np.uint32)))
    assert held.values().tolist() == values
    for i in range(0, n, 7):
        assert held.access(i) == values[i]
    for value in {*values[:20], high + 5}:
        places = [i for i, v in enumerate(values) if v == value]
        assert held.count(value) == len(places)
        assert held.count(value, n // 3, n // 2) == values[n // 3 : n // 2].count(value)
        assert [held.find(value, k) for k in range(0, len(places), 5)] == places[::5]
        with pytest.raises(IndexError):
            held.find(value, len(places))


def test_files_hold_every_document(spark):
    rng = random.Random(6)
    words = ["the", "Über", "naïve", "<|endoftext|>", "it's", "x\x1cy", "1234", "😀", "don't", "a b", "é", "ΣΑΣ"]
    rows = [(i * 3, rng.choice([" ", "  ", "\n", " "]).join(rng.choices(words, k=rng.randrange(30)))) for i in range(200)]
    rows += [(None, "null id"), (1, None), (5000, "w " * 30_000), (6000, "q" * 5000)]
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = s.shared_folder(spark, "test")
    s.write_shards(docs, path, PATH, size=1000)
    read = s.read_shards(spark, path)
    assert read.count() > 5
    got = {r["id"]: r for r in s.digests(read).collect()}
    start, tokenizer = 0, Tokenizer.from_file(PATH)
    for i, text in order:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_parts_encode_as_the_text_does():
    rng = random.Random(7)
    own, tokenizer = s.Words(PATH), Tokenizer.from_file(PATH)
    latin = "".join(map(chr, range(1, 256)))
    texts = ["".join(rng.choices(latin, k=rng.randrange(60))) for _ in range(500)]
    texts += ["".join(rng.choices("aé'stdlm. <|>1\u0301ΣİK\u2003", k=rng.randrange(30))) for _ in range(500)]
    for text, code in zip(texts, own.encode(texts, 2), strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(code, dtype="<u4").tolist() == ids, repr(text)


def test_ties_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (1, "c", 0)], "doc_id long, text string, part int")
    got = sorted((r["start"], r["n_tokens"]) for r in s.through_files(docs, PATH).collect())
    assert len(got) == 3 and got[0][0] == 0 and got[2][0] == got[1][0] + got[1][1]
    assert s.through_files(docs.limit(0), PATH).collect() == []


def test_a_look_for_new_words_reads_only_these():
    class Counted(Kept):
        def __iter__(self):
            raise AssertionError("all keys read")

    known = Counted(1000)
    known.update((str(i), i) for i in range(900))
    assert known.unknown({"5", "x", "899"}) == {"x"}
