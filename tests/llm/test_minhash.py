"""Order MinHash against a plain selection, and the row after each row."""

import hashlib
import random

import numpy as np

from spoorline.llm import minhash as m


def plain_signature(text, k=m.K, functions=m.FUNCTIONS):
    if not text:
        return [0] * functions
    k = min(k, len(text))
    hashes = m.kmer_hashes(m.points_of(text), k).tolist()
    seen, numbered = {}, []
    for i, h in enumerate(hashes):
        kmer = text[i : i + k]
        n = seen[kmer] = seen.get(kmer, -1) + 1
        numbered.append(int(m.mixed(np.array([(h + n * int(m.STEP)) % 2**64], dtype=np.uint64))[0]))
    out = []
    for odd in m.factors(functions).tolist():
        order = sorted(range(len(numbered)), key=lambda i: (numbered[i] * odd % 2**64, i))[:2]
        a, b = min(order), max(order)
        first = int(m.mixed(np.array([hashes[a]], dtype=np.uint64))[0])
        value = m.mixed(np.array([(first + hashes[b] * int(m.STEP)) % 2**64], dtype=np.uint64))
        out.append(int(value[0] >> np.uint64(32)) | 1)
    return out


def test_signature_equals_the_plain_one():
    rng = random.Random(2)
    texts = ["", "a", "abcdefgh", "aaaaaaaaaaaaaaaaaaaa", "Zoë ça va 😀 " * 9]
    texts += ["".join(rng.choices("ab c", k=rng.randrange(1, 200))) for _ in range(40)]
    for text in texts:
        assert m.signature(m.points_of(text)).tolist() == plain_signature(text)


def test_occurrences():
    rng = random.Random(3)
    values = np.array(rng.choices([1 << 30, 2 << 30, 3 << 40], k=500), dtype=np.uint64)
    want = [int((values[:i] == v).sum()) for i, v in enumerate(values)]
    assert m.occurrences(values).tolist() == want


def test_likeness_follows_edits():
    rng = random.Random(4)
    text = "".join(rng.choices("abcdefghij ", k=2000))
    mark = m.signature(m.points_of(text), functions=256)
    last = 1.0
    for edits in (0, 10, 60, 300):
        own = list(text)
        for i in rng.sample(range(len(own)), edits):
            own[i] = rng.choice("klmnop")
        now = m.likeness(mark, m.signature(m.points_of("".join(own)), functions=256))
        assert now < last or edits == 0
        last = now
    # The same k-mers in another order are less alike than a set would say.
    swapped = text[1000:] + text[:1000]
    assert m.likeness(mark, m.signature(m.points_of(swapped), functions=256)) < 0.7


def test_rows_and_their_successors(spark):
    rng = random.Random(5)
    rows = [(i * 7 - 50, "".join(rng.choices("abcd ", k=rng.randrange(60)))) for i in range(300)]
    rows += [(None, "null id"), (10_000, None), (10_001, "x" * 200_000), (10_002, "😀é")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in m.order_minhash(docs).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(order)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        row = got[i]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        mark, changed, follow = (m.signature(m.points_of(x)) for x in (text, new, after))
        assert row["fingerprint"] == m.shown(mark) and row["edited_fingerprint"] == m.shown(changed)
        assert row["near_edited"] == m.likeness(mark, changed) and row["near_next"] == m.likeness(mark, follow)


def test_ties_one_row_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", 0), (1, "abc", 0), (1, "abd", 0)], "doc_id long, text string, run int")
    assert len(m.order_minhash(docs).collect()) == 3
    one = m.order_minhash(docs.limit(1)).collect()
    assert [(r["near_next"], r["n_chars"]) for r in one] == [(1.0, 3)]
    assert m.order_minhash(docs.where("false")).collect() == []
