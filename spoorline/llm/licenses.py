"""Licence mentions by ordered signature rules.

A text is reduced to its words: A-Z in lower case, everything else in ASCII but digits and
letters separates. Hundreds of rules, each a pattern over the words, are made of the names
of licences and the phrases that refer to a licence. A rule is tried only where the text
holds its keyword. Detections are taken by priority, then length, then place; one that
lies within the words of a detection already taken is suppressed.

Three base phrases are found everywhere and always reported. A null text is empty: no
words, no labels, score 0. Long texts are scanned whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spoorline.llm.common import bounded_batches

# Phrase and label.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Label, the words that name the licence, its short identifier as words.
NAMES = [
    ("mit", "mit|expat", "mit"),
    ("x11", "x11|x consortium", "x11"),
    ("isc", "isc|internet systems consortium", "isc"),
    ("zlib", "zlib|zlib libpng", "zlib"),
    ("ncsa", "university of illinois ncsa open source|ncsa open source", "ncsa"),
    ("postgresql", "postgresql", "postgresql"),
    ("curl", "curl", "curl"),
    ("json", "json", "json"),
    ("unicode", "unicode", "unicode dfs 2016"),
    ("w3c", "w3c|w3c software notice and", "w3c"),
    ("beerware", "beerware|beer ware", "beerware"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "wtfpl"),
    ("unlicense", "unlicense", "unlicense"),
    ("0bsd", "zero clause bsd|bsd zero clause|free public license 1 0 0", "0bsd"),
    ("bsd-2-clause", "2 clause bsd|bsd 2 clause|simplified bsd|freebsd|two clause bsd", "bsd 2 clause"),
    ("bsd-3-clause", "3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd|three clause bsd", "bsd 3 clause"),
    ("bsd-4-clause", "4 clause bsd|bsd 4 clause|original bsd|old bsd|four clause bsd", "bsd 4 clause"),
    ("bsd", "bsd", "bsd"),
    ("apache-1.0", "apache( software)?( license)?( version| v)? 1 0", "apache 1 0"),
    ("apache-1.1", "apache( software)?( license)?( version| v)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache( software)?( license)?( version| v)? ?2( 0)?|asl 2 0", "apache 2 0"),
    ("apache", "apache( software)?", "apache"),
    ("gpl-1.0", "gnu( general public license|gpl)( version| v)? ?1( 0)?|gplv1", "gpl 1 0"),
    ("gpl-2.0", "(gnu )?(general public license|gpl)( version| v)? ?2( 0)?|gplv2", "gpl 2 0"),
    ("gpl-3.0", "(gnu )?(general public license|gpl)( version| v)? ?3( 0)?|gplv3", "gpl 3 0"),
    ("gpl", "(gnu )?(general public license|gpl)", "gpl"),
    ("lgpl-2.0", "(gnu )?(library general public license|lgpl)( version| v)? ?2( 0)?|lgplv2", "lgpl 2 0"),
    ("lgpl-2.1", "(gnu )?(lesser general public license|lgpl)( version| v)? ?2 1|lgplv2 1", "lgpl 2 1"),
    ("lgpl-3.0", "(gnu )?(lesser general public license|lgpl)( version| v)? ?3( 0)?|lgplv3", "lgpl 3 0"),
    ("lgpl", "(gnu )?(lesser general public license|library general public license|lgpl)", "lgpl"),
    ("agpl-3.0", "(gnu )?(affero general public license|agpl)( version| v)? ?3( 0)?|agplv3", "agpl 3 0"),
    ("agpl", "(gnu )?(affero general public license|agpl)", "agpl"),
    ("gfdl", "(gnu )?(free documentation license|gfdl|fdl)( version| v)?( 1 [123])?", "gfdl 1 3"),
    ("mpl-1.0", "(mozilla public license|mpl)( version| v)? ?1 0", "mpl 1 0"),
    ("mpl-1.1", "(mozilla public license|mpl)( version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2.0", "(mozilla public license|mpl)( version| v)? ?2( 0)?", "mpl 2 0"),
    ("mpl", "mozilla public license|mpl", "mpl"),
    ("epl-1.0", "(eclipse public license|epl)( version| v)? ?1( 0)?", "epl 1 0"),
    ("epl-2.0", "(eclipse public license|epl)( version| v)? ?2( 0)?", "epl 2 0"),
    ("cddl-1.0", "(common development and distribution license|cddl)( version| v)? ?1 0", "cddl 1 0"),
    ("cddl-1.1", "(common development and distribution license|cddl)( version| v)? ?1 1", "cddl 1 1"),
    ("cpl-1.0", "common public license( version| v)?( 1 0)?", "cpl 1 0"),
    ("ipl-1.0", "ibm public license( version| v)?( 1 0)?", "ipl 1 0"),
    ("apsl-2.0", "apple public source license( version| v)?( 2 0)?", "apsl 2 0"),
    ("ms-pl", "microsoft public license|ms pl", "ms pl"),
    ("ms-rl", "microsoft reciprocal license|ms rl", "ms rl"),
    ("artistic-1.0", "artistic license 1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic license( version)? 2( 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic"),
    ("afl-3.0", "academic free license( version| v)?( 3 0)?", "afl 3 0"),
    ("osl-3.0", "open software license( version| v)?( 3 0)?", "osl 3 0"),
    ("bsl-1.0", "boost software license( version)?( 1 0)?|boost", "bsl 1 0"),
    ("eupl-1.1", "(european union public licen[cs]e|eupl)( version| v)? ?1 1", "eupl 1 1"),
    ("eupl-1.2", "(european union public licen[cs]e|eupl)( version| v)? ?1 2", "eupl 1 2"),
    ("cecill-2.1", "cecill( free software license agreement)?( version| v)?( 2 1)?", "cecill 2 1"),
    ("ofl-1.1", "sil open font license( version)?( 1 1)?|open font license", "ofl 1 1"),
    ("php-3.01", "php license( version)?( 3 01)?|php", "php 3 01"),
    ("psf-2.0", "python software foundation license( version)?( 2)?|psf", "psf 2 0"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("qpl-1.0", "q public license( version)?( 1 0)?", "qpl 1 0"),
    ("sleepycat", "sleepycat", "sleepycat"),
    ("vim", "vim", "vim"),
    ("upl-1.0", "universal permissive license( version| v)?( 1 0)?", "upl 1 0"),
    ("odbl-1.0", "open (data commons open )?database license( version| v)?( 1 0)?|odbl", "odbl 1 0"),
    ("pddl-1.0", "public domain dedication and license|pddl", "pddl 1 0"),
    ("sspl-1.0", "server side public license( version| v)?( 1)?|sspl", "sspl 1 0"),
    ("elastic-2.0", "elastic license( version)?( 2 0)?", "elastic 2 0"),
    ("busl-1.1", "business source license( version)?( 1 1)?", "busl 1 1"),
    ("commons-clause", "commons clause", "commons clause"),
    ("cc0-1.0", "cc0( 1 0)?( universal)?|creative commons zero|cc zero", "cc0 1 0"),
    ("cc-by-nc-nd", "(cc by nc nd|creative commons attribution non ?commercial no ?deriv(ative)?s)( [1234] [05])?", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", "(cc by nc sa|creative commons attribution non ?commercial share ?alike)( [1234] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc", "(cc by nc|creative commons attribution non ?commercial)( [1234] [05])?", "cc by nc 4 0"),
    ("cc-by-nd", "(cc by nd|creative commons attribution no ?deriv(ative)?s)( [1234] [05])?", "cc by nd 4 0"),
    ("cc-by-sa", "(cc by sa|creative commons attribution share ?alike)( [1234] [05])?", "cc by sa 4 0"),
    ("cc-by", "(cc by|creative commons attribution)( [1234] [05])?", "cc by 4 0"),
]

# How a text refers to a licence; {n} its name, {i} its identifier. Before
# it what every match holds, after it the priority and the score of a detection.
GRANT = "(licensed|released|distributed|available|published|provided|covered|shared|redistributed|used)"
PHRASES = [
    ((" spdx ", r"spdx license identifier {i}( only| or later)?"), 5, 1.0),
    ((" under ", GRANT + r" under( the)?( terms)?( and conditions)?( of)?( the)?( either)? ({n})( public| software)?( licen[cs]e)?"), 4, 0.95),
    ((" licen", r"(subject to|governed by|under|in compliance with|terms of|conditions of)( the)? ({n})( public| software)? licen[cs]e"), 3, 0.9),
    ((" licen", r"(a copy of|see|accept|read)( the)? ({n})( public| software)? licen[cs]e"), 3, 0.85),
    ((" licen", r"(the )?({n})( public| software)? licen[cs]e( agreement)?"), 2, 0.8),
    ((" licen", r"licen[cs]e( is)?( the)? ({n})"), 1, 0.7),
]

# Notices that are not built on a licence's name.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5, 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", 5, 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5, 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty", 4, 0.8),
    ("boost", "permission is hereby granted free of charge to any person or organization", 5, 1.0),
    ("public-domain", "(released|dedicated|placed|in)( in)?( in?to)?( the)? public domain", 3, 0.8),
    ("warranty-disclaimer", "without warranty of any kind|without warranties or conditions of any kind", 2, 0.6),
    ("proprietary", "(proprietary and confidential|unauthorized copying|may not be (copied|reproduced)|no part of this (work|publication))", 4, 0.8),
    ("copyright", r"(copyright|copyright c|©)( ©)? (19|20)\d\d( (19|20)\d\d)*", 2, 0.5),
    ("reserved", "(all|some|no) rights reserved", 2, 0.7),
]

SEPARATED = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256)
)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: frozenset[bytes]  # one of them stands in every match
    pattern: re.Pattern
    priority: int
    score: float


def cut_top(pattern: str, mark: str) -> list[str]:
    """The pattern parted at a mark that stands outside all groups."""
    depth, out = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == mark and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def keywords_of(pattern: str) -> frozenset[bytes]:
    """For each alternative its longest literal word, in groups where it has none outside."""
    out: set[bytes] = set()
    for way in cut_top(pattern, "|"):
        flat = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", "\n", way)
        words = re.findall(r"[a-z0-9\x80-\uffff]+(?![a-z0-9?\[])", re.sub(r"\[\w+\]\w*|\\d", "\n", flat))
        if words:
            out.add(max(words, key=len).encode())
        else:
            group = next(g for g in re.findall(r"\(((?:[^()]|\([^()]*\))*)\)(?!\?)", way))
            out |= keywords_of(group)
    return frozenset(out)


@lru_cache(maxsize=1)
def rules() -> dict[bytes, list[Rule]]:
    """The rules by the word that their phrase gives every match (none: empty), by priority."""
    made = [(b"", label, text, keywords_of(text), priority, score) for label, text, priority, score in NOTICES]
    for label, name, short in NAMES:
        for (gate, phrase), priority, score in PHRASES:
            text = phrase.replace("{n}", name).replace("{i}", short)
            keys = keywords_of(short if "{i}" in phrase else name)
            made.append((gate.encode(), label, text, keys, priority, score))
        # A title that says licence itself needs no phrase around it.
        titles = "|".join(way for way in cut_top(name, "|") if "licen" in way)
        if titles:
            made.append((b" licen", label, f"(the )?({titles})", keywords_of(titles), 2, 0.75))
    out: dict[bytes, list[Rule]] = {}
    for gate, label, text, keys, priority, score in sorted(made, key=lambda r: -r[4]):
        rule = Rule(label, keys, re.compile(rf"(?<= )(?:{text})(?= )".encode()), priority, score)
        out.setdefault(gate, []).append(rule)
    return out


@lru_cache(maxsize=1)
def all_keywords() -> dict[bytes, list[bytes]]:
    """The keywords of each gate's rules."""
    return {gate: sorted({k for rule in own for k in rule.keywords}) for gate, own in rules().items()}


def places(words: bytes, phrase: bytes) -> list[int]:
    """Word numbers where a phrase begins; `words` has a space at both ends."""
    out, at, number, seen = [], words.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        number += words.count(b" ", seen, at)
        seen = at
        out.append(number)
        at = words.find(b" " + phrase + b" ", at + 1)
    return out


def detections(words: bytes) -> list[tuple[int, int, str, float]]:
    """Detections that remain: (begin, end, label, score), offsets in `words`."""
    found = []
    for gate, own in rules().items():
        if gate not in words:
            continue
        there = {k for k in all_keywords()[gate] if k in words}
        for rule in own if there else ():
            if not there.isdisjoint(rule.keywords):
                found += [(rule.priority, m.start(), m.end(), rule.label, rule.score) for m in rule.pattern.finditer(words)]
    found.sort(key=lambda d: (-d[0], d[1] - d[2], d[1], d[3]))
    kept: list[tuple[int, int, str, float]] = []
    for _, begin, end, label, score in found:
        if not any(a <= begin and end <= b for a, b, _, _ in kept):
            kept.append((begin, end, label, score))
    return kept


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections' spans."""
    parts = text.encode("utf-8", "surrogatepass").translate(SEPARATED).split()
    words = b" " + b" ".join(parts) + b" "
    hits = {label: places(words, phrase.encode()) for phrase, label in BASE.items()}
    starts = [n for own in hits.values() for n in own]
    base = {label for label, own in hits.items() if own}
    kept = detections(words)
    labels = base | {label for _, _, label, _ in kept}
    score = max([s for *_, s in kept] + [0.6] * bool(base) + [0.0])
    spans = [f"{words.count(b' ', 0, a) - 1}:{words.count(b' ', 0, b)}:{label}" for a, b, label, _ in sorted(kept)]
    return (
        len(parts), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score, spans,
    )


FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<string>"
)


def scan_texts(text: Column) -> Column:
    """A struct of FOUND for each text."""
    bounded_batches(SparkSession.active())
    names = [part.split()[0] for part in FOUND.split(", ")]

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([scan(x or "") for x in texts], columns=names)
        return rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return run(text)
