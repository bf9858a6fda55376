"""Licence scan: base phrases against a plain search, gates against ungated rules."""

import random
import re

from spoorline.llm import licenses as L

PIECES = [
    "Licensed under the Apache License, Version 2.0.", "MIT License", "CC BY-NC 4.0", "cc by", "All rights reserved",
    "GNU General Public License, version 3", "SPDX-License-Identifier: MPL-2.0", "see the Eclipse Public License v2.0",
    "the", "mit", "under", "public domain", "Ünïcode", "license", "of", "é", "(c)", "GPLv2", "cc", "by", "1999",
]


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(text):
    words = plain_words(text)
    return [(i, label) for i in range(len(words)) for p, label in L.BASE.items() if words[i : i + len(p.split())] == p.split()]


def some_texts():
    rng = random.Random(5)
    return [rng.choice([" ", ", ", "\n"]).join(rng.choices(PIECES, k=rng.randrange(1, 14))) for _ in range(400)]


def test_base_phrases_and_words():
    for text in [*some_texts(), "", "cc by cc by", "cc by cc", "x" * 100_000, "cc by " * 20_000]:
        found = plain_base(text)
        n, n_base, first, last, base, labels, score, _ = L.scan(text)
        starts = [i for i, _ in found]
        assert (n, n_base) == (len(plain_words(text)), len(found))
        assert (first, last) == (min(starts, default=None), max(starts, default=None))
        assert base == ",".join(sorted({x for _, x in found}))
        assert {x for x in base.split(",") if x} <= set(labels.split(",")) and 0 <= score <= 1


def test_gates_lose_no_match_and_kept_ones_are_not_contained():
    for text in some_texts():
        words = b" " + b" ".join(w.encode() for w in plain_words(text)) + b" "
        every = [
            (rule.priority, m.start(), m.end(), rule.label, rule.score)
            for own in L.rules().values() for rule in own for m in rule.pattern.finditer(words)
        ]
        every.sort(key=lambda d: (-d[0], d[1] - d[2], d[1], d[3]))
        want = []
        for _, a, b, label, score in every:
            if not any(x <= a and b <= y for x, y, _, _ in want):
                want.append((a, b, label, score))
        assert L.detections(words) == want


def test_known_labels():
    assert sum(map(len, L.rules().values())) > 400
    for text, want in [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("see the Eclipse Public License v2.0", "epl-2.0"),
        ("nothing of the kind, mit or not", ""),
    ]:
        assert L.scan(text)[5] == want


def test_nulls_ties_and_no_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "All rights reserved", "z"), (2, "All rights reserved", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = docs.select("doc_id", L.scan_texts(docs.text).alias("found")).select("found.*").collect()
    assert [r["n_words"] for r in got] == [0, 0, 3, 3] and got[0]["first_word"] is None
    assert [r["labels"] for r in got] == ["", "", "reserved", "reserved"]
    assert docs.limit(0).select(L.scan_texts(docs.text)).collect() == []
