"""SentencePiece vocabularies: encoding by a batched Viterbi search, decoding, exact round trip.

The normalized text falls into words; no piece of the vocabulary crosses their edges. Words that were not met before are grouped by length, and the words
of a length advance together: the hashes of all their substrings probe the sorted keys of
the pieces, and the maxima over the pieces that end at a place are kept as backpointers.

With a unigram vocabulary a piece scores its log probability and every transition is free;
of equal sums the earliest start of the last piece wins. With a merge vocabulary (the
public one) the score lies in the transitions: a piece may follow another if merging the
two pieces' characters ends in just these two. A sequence whose neighbours all may stand
together is the one that merging gives, and there is one for every prefix, so the search
finds the library's ids exactly. Pairs are tried once and remembered. Characters without
a piece become byte pieces, or the unknown id.

A null text counts as empty and gives no ids. Texts are handled whole, whatever their
length; a worker keeps at most about twice `KEPT` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spoorline.llm.common import Kept, bounded_batches

MARK = "▁"
BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FIRST = np.uint64(42)
UNKNOWN_PENALTY = 10.0
KEPT = 220_000
#: Pairs of pieces remembered, an entry of a few dozen bytes each.
PAIRS = 400_000
#: In a search's table of last pieces: no piece yet, a character without a piece.
NONE, ODD = -2, -1
#: Words of one length are worked on in blocks of about this many characters.
BLOCK = 1 << 18


def points_of(words: list[str]) -> np.ndarray:
    """The code points of words of equal length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1)


def word_pattern(touching: set[str]) -> re.Pattern:
    """Words: a run of marks and what follows up to a place that no piece crosses.

    Such places stand before a mark, and between a letter or digit and any other character
    that no piece joins with one. `touching` holds the characters that some piece does.
    """
    joins = "".join(map(re.escape, sorted(touching)))
    letters, others = "[^\\W_]", f"(?:[^\\w{MARK}{joins}]{'' if '_' in touching else '|_'})"
    alone = f"(?![{joins}])" if joins else ""
    return re.compile(f"{MARK}*(?:{letters}++{alone}|{others}++{alone}|[^{MARK}]+)|{MARK}+")


def varint(octets: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (octets[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if octets[at - 1] < 128:
            return value, at


def fields(octets: bytes) -> dict[int, int | bytes]:
    """The last value of each numbered field of a serialized message."""
    out: dict[int, int | bytes] = {}
    at = 0
    while at < len(octets):
        tag, at = varint(octets, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(octets, at)
        else:
            size, at = varint(octets, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = octets[at : at + size], at + size
        out[tag >> 3] = value
    return out


def is_unigram(model: bytes) -> bool:
    """Whether the trainer's settings (field 2) name the unigram type (field 3, its default)."""
    return fields(fields(model).get(2, b"")).get(3, 1) == 1


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            octets = file.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=octets)
        self.unigram = is_unigram(octets)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in ids if self.model.is_byte(i)}
        special = {
            i
            for i in ids
            if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)
        }
        plain = [i for i in ids if i not in special]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a word mark after its first letters")
        touching = {
            x
            for i in plain
            for pair in zip(pieces[i], pieces[i][1:], strict=False)
            for x in pair
            if MARK not in pair and pair[0].isalnum() != pair[1].isalnum() and not x.isalnum()
        }
        self.word = word_pattern(touching)
        self.unknown = self.model.unk_id()
        self.longest = max(map(len, (pieces[i] for i in plain)))
        scores = {i: self.model.get_score(i) for i in plain}
        self.unknown_score = min(scores.values()) - UNKNOWN_PENALTY
        keys = np.array([self.key(pieces[i]) for i in plain], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ids = np.array(plain, dtype=np.int32)[order]
        self.key_scores = np.array([scores[i] for i in plain])[order]
        # Most substrings are no piece: a table of the keys' first bits tells.
        self.first_bits = np.zeros(1 << (64 - int(FIRST)), dtype=bool)
        self.first_bits[self.keys >> FIRST] = True
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(2 * self.longest + 1)], dtype=np.uint64)
        self.words = Kept(KEPT)
        self.pairs: dict[int, bool] = {}
        self.octets = [self._octets(i, pieces[i]) for i in ids]
        self.pieces = pieces

    def _octets(self, i: int, piece: str) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if self.model.is_control(i):
            return b""
        return piece.replace(MARK, " ").encode()

    @staticmethod
    def prefix_hashes(points: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), points.shape[1] + 1), dtype=np.uint64)
        for j in range(points.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + (points[:, j].astype(np.uint64) + np.uint64(1)) * OTHER
        return out

    def key(self, piece: str) -> np.uint64:
        return self.prefix_hashes(points_of([piece]))[0, -1]

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and scores of the pieces with these hashes."""
        ids = np.full(hashes.shape, -1, dtype=np.int32)
        scores = np.full(hashes.shape, -np.inf)
        maybe = np.flatnonzero(self.first_bits[hashes >> FIRST])
        wanted = hashes.reshape(-1)[maybe]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[at] == wanted
        ids.reshape(-1)[maybe[hit]] = self.key_ids[at[hit]]
        scores.reshape(-1)[maybe[hit]] = self.key_scores[at[hit]]
        return ids, scores

    def search(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of words of equal length."""
        points = points_of(words)
        n, size = points.shape
        hashes = self.prefix_hashes(points)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        start = np.zeros((n, size + 1), dtype=np.int32)
        piece = np.full((n, size + 1), ODD, dtype=np.int32)
        piece[:, 0] = NONE
        rows = np.arange(n)
        for j in range(1, size + 1):
            first = max(0, j - self.longest)
            cut = hashes[:, j : j + 1] - hashes[:, first:j] * self.powers[j - first : 0 : -1]
            ids, scores = self.probe(cut)
            if self.unigram:
                scores[:, -1] = np.where(ids[:, -1] < 0, self.unknown_score, scores[:, -1])
                sums = best[:, first:j] + scores
            else:
                # One piece is right; if no longer one is, it is the single character.
                longer = ids >= 0
                longer[:, -1] = False
                sums = np.full(ids.shape, -np.inf)
                sums[longer] = np.where(self.may_follow(piece[:, first:j][longer], ids[longer]), 1.0, -np.inf)
                sums[:, -1] = 0.0
            top = sums.argmax(axis=1)
            best[:, j] = sums[rows, top]
            start[:, j] = top + first
            piece[:, j] = ids[rows, top]
        return self.traces(words, start, piece)

    def traces(self, words: list[str], start: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """The ids along the backpointers of all words at once."""
        n, size = len(words), start.shape[1] - 1
        found = np.zeros((n, size), dtype="<i4")
        count = np.zeros(n, dtype=np.int64)
        odd = np.zeros(n, dtype=bool)
        live, place = np.arange(n), np.full(n, size)
        while len(live):
            own = piece[live, place]
            odd[live] |= own < 0
            count[live] += 1
            found[live, size - count[live]] = own
            place = start[live, place]
            live, place = live[place > 0], place[place > 0]
        octets = found.tobytes()
        ends = (np.arange(1, n + 1) * (4 * size)).tolist()
        out = [octets[b - 4 * c : b] for b, c in zip(ends, count.tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.trace(words[k], start[k], piece[k])
        return out

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves both pieces as they are; a missing left one asks for the right alone."""
        codes = np.where(left < 0, -1, left).astype(np.int64) * len(self.pieces) + right
        different, where = np.unique(codes, return_inverse=True)
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        new = [c for c in different.tolist() if c not in self.pairs]
        by_size: dict[int, list[tuple[int, str, str]]] = {}
        for code in new:
            a, b = divmod(code, len(self.pieces))
            one, two = self.pieces[a] if a >= 0 else "", self.pieces[b]
            by_size.setdefault(len(one + two), []).append((code, one, two))
        for size, same in by_size.items():
            points = points_of([one + two for _, one, two in same])
            begins = self.merged(points)
            want = np.zeros(begins.shape, dtype=bool)
            want[:, 0] = True
            want[np.arange(len(same)), [len(one) % size for _, one, _ in same]] = True
            self.pairs.update(zip((c for c, _, _ in same), (begins == want).all(axis=1).tolist(), strict=True))
        return np.fromiter(map(self.pairs.__getitem__, different.tolist()), dtype=bool, count=len(different))[where]

    def merged(self, points: np.ndarray) -> np.ndarray:
        """Where pieces begin after all merges: best score first, then leftmost."""
        n, size = points.shape
        hashes = self.prefix_hashes(points)
        begins = np.ones((n, size), dtype=bool)
        after = np.tile(np.arange(1, size + 1), (n, 1))  # where the piece that begins here ends
        rows = np.arange(n)
        while True:
            middle = np.minimum(after, size - 1)
            end = np.where(after < size, np.take_along_axis(after, middle, axis=1), size)
            open_ = begins & (after < size)
            cut = np.take_along_axis(hashes, end, axis=1) - hashes[:, :size] * self.powers[end - np.arange(size)]
            ids, scores = self.probe(cut)
            scores = np.where(open_ & (ids >= 0), scores, -np.inf)
            top = scores.argmax(axis=1)
            go = np.flatnonzero(scores[rows, top] > -np.inf)
            if not len(go):
                return begins
            at = top[go]
            begins[go, after[go, at]] = False
            after[go, at] = end[go, at]

    def trace(self, word: str, start: np.ndarray, piece: np.ndarray) -> bytes:
        out: list[int] = []
        j = len(word)
        while j:
            i, own = int(start[j]), int(piece[j])
            if own >= 0:
                out.append(own)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(word[i:j].encode("utf-8", "surrogatepass"))]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            j = i
        return np.array(out[::-1], dtype="<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for word in words:
            by_size.setdefault(len(word), []).append(word)
        for size, same in by_size.items():
            step = max(1, BLOCK // size)
            for at in range(0, len(same), step):
                block = same[at : at + step]
                self.words.update(zip(block, self.search(block), strict=True))

    def cut(self, text: str) -> list[str]:
        """The words of a text with their marks."""
        return self.word.findall(self.model.normalize(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [self.cut(x) for x in texts]
        self.learn(self.words.unknown({w for words in cuts for w in words}))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype="<i4") for words in cuts]

    def decode(self, ids: np.ndarray) -> str:
        octets = self.octets
        text = b"".join([octets[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def shares(texts: pd.Series, size: int = 2_000_000) -> Iterator[list[str]]:
    """The texts of a batch in runs of about `size` characters."""
    held, total = [], 0
    for text in texts:
        held.append(text or "")
        total += len(held[-1])
        if total > size:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode(text: Column, path: str) -> Column:
    """The ids of a text's pieces."""
    bounded_batches(SparkSession.active())

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        own = vocabulary(path)
        return pd.Series([ids for part in shares(texts) for ids in own.encode(part)], dtype=object)

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of a list of ids; null for null."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        own = vocabulary(path)
        return pd.Series([None if x is None else own.decode(np.asarray(x)) for x in rows], dtype=object)

    return run(ids)


def round_trip(text: Column, path: str) -> Column:
    """A struct of the ids and the text they decode to, each worked out once."""
    bounded_batches(SparkSession.active())

    @F.pandas_udf("ids array<int>, back string")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = vocabulary(path)
        ids = [x for part in shares(texts) for x in own.encode(part)]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "back": [own.decode(x) for x in ids]})

    return run(text)
