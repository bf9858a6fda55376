"""Line dedup against a plain version."""

import hashlib
import random

from spoorline.llm import lines as m

DIVISOR, WORDS = 2, 50


def plain_chunks(text):
    rows = text.split("\n")
    hashes = [int(hashlib.md5(r.encode()).hexdigest()[:8], 16) for r in rows]
    words = [r.count(" ") + 1 for r in rows]
    starts = [
        i
        for i in range(len(rows))
        if i == 0 or (hashes[i - 1] * 31 + hashes[i]) % DIVISOR == 0 or words[i] > WORDS or words[i - 1] > WORDS
    ]
    return [
        (s, e, sum(words[s:e]), "\n".join(rows[s:e])) for s, e in zip(starts, [*starts[1:], len(rows)], strict=True)
    ]


def plain_dedup(docs):
    """docs: (id, text), ids distinct; id -> (text, lines, removed)."""
    seen, out = set(), {}
    cuts = {i: plain_chunks(t) for i, t in docs if t is not None}
    order = sorted(cuts, key=lambda i: (i is not None, i or 0))
    for i in order:
        runs, gone = [], set()
        for s, e, words, text in cuts[i]:
            if text in seen:
                if runs and runs[-1][1] == s:
                    runs[-1][1:] = [e, runs[-1][2] + words]
                else:
                    runs.append([s, e, words])
            seen.add(text)
        for s, e, words in runs:
            if words > WORDS:
                gone.update(range(s, e))
        rows = dict(docs)[i].split("\n")
        out[i] = ("\n".join(r for k, r in enumerate(rows) if k not in gone), len(rows), len(gone))
    return out | {i: (None, 0, 0) for i, t in docs if t is None}


def result(rows):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in rows}


def some_docs(rng):
    line = lambda: " ".join(rng.choices(["the", "of", "an", "ere", "x"], k=rng.choice([1, 3, 12, 30, 70])))
    passages = [[line() for _ in range(rng.randrange(1, 6))] for _ in range(12)]
    docs = []
    for i in range(150):
        rows = [line() for _ in range(rng.randrange(5))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(rows) + 1)
            rows[at:at] = rng.choice(passages)
        docs.append((i, "\n".join(rows)))
    return docs


def test_equals_the_plain_version(spark):
    docs = some_docs(random.Random(1))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (None, docs[4][1]), (203, None), (204, ""), (205, "\n\n")]
    docs += [(206, "w " * 100_000 + "\nend"), (207, "w " * 100_000 + "\nother")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(m.dedup_lines(frame).collect()) == plain_dedup(docs)


def test_a_passage_moved_by_other_lines_is_found(spark):
    rng = random.Random(2)
    passage = [" ".join(rng.choices("abcdefgh", k=60)), " ".join(rng.choices("abcdefgh", k=70))]
    texts = ["\n".join([*(f"own {i} {k}" for k in range(i)), *passage, f"tail {i}"]) for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = result(m.dedup_lines(frame).collect())
    assert got[0][0] == texts[0]
    for i in range(1, 20):
        assert got[i][0] == "\n".join([*(f"own {i} {k}" for k in range(i)), f"tail {i}"])


def test_equal_rows_extra_columns_and_no_rows(spark):
    text = "word " * 60
    rows = [(1, text, "a", 1), (1, text, "a", 1), (2, text, "b", 2), (2, text + "\nmore", "b", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, mark string, h long")
    got = m.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "mark", "h", "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"] == text, r["n_removed"]) for r in got.collect()) == [
        (1, True, 0), (1, True, 0), (2, False, 1), (2, False, 1),
    ]
    assert m.dedup_lines(frame.limit(0)).collect() == []
