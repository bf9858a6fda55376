"""Repeated passages of several lines, wherever the chunks are cut."""

import random

import corpus_pipeline as c
import test_lines as old

from spoorline.llm import lines as m


def plain_whole(docs):
    """Lines of every range of over 50 words that stands at an earlier place; ids ascend."""
    seen, gone = set(), {}
    places = []
    for i, text in docs:
        rows = text.split("\n")
        for s in range(len(rows)):
            for e in range(s + 2, len(rows) + 1):
                if sum(r.count(" ") + 1 for r in rows[s:e]) > 50:
                    places.append((i, s, e, tuple(rows[s:e])))
    for i, s, e, text in places:
        if text in seen:
            gone.setdefault(i, set()).update(range(s, e))
        seen.add(text)
    return gone


def test_passages_beside_foreign_lines_go_whole(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choices("abcdefghijklm", k=n))
    passages = [[say(30), say(30)], [say(20), say(9), say(25), say(4)], [say(5) for _ in range(14)], [say(60), say(3)]]
    docs = []
    for i in range(40):
        rows = [say(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 4))]
        rows += passages[i % 4] + [say(rng.randrange(3, 30))]
        docs.append((i, "\n".join(rows)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    gone = plain_whole(docs)
    assert sum(map(len, gone.values())) >= 9 * sum(map(len, passages))
    got = old.result(m.dedup_lines(frame, whole=True).collect())
    for i, text in docs:
        rows = text.split("\n")
        assert got[i] == ("\n".join(r for k, r in enumerate(rows) if k not in gone.get(i, ())), len(rows), len(gone.get(i, ())))
    stage = {r["doc_id"]: r["text"] for r in c.line_dedup(spark, frame.selectExpr("*", "'aa' lang", "'s' source", "0L n_chars"), "").collect()}
    assert stage == {i: x[0] for i, x in got.items()}


def test_what_chunks_find_still_goes(spark):
    docs = old.some_docs(random.Random(8))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    before, now = old.plain_dedup(docs), old.result(m.dedup_lines(frame, whole=True).collect())
    gone = plain_whole(docs)
    for i, _ in docs:
        assert now[i][2] >= max(before[i][2], len(gone.get(i, ())))
    kept = {r for t, _, _ in now.values() for r in t.split("\n")}
    assert kept >= {r for _, t in docs for r in t.split("\n") if r}
