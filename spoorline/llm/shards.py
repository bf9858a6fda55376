"""Token ids in compressed shards: a wavelet matrix per shard, read back from its file.

A shard holds the ids of consecutive documents. Its file is one blob: a header, then the
zstd-compressed sections: the documents' ids and ends, and for each bit of the ids, from
the highest, a plane of bits with counts of ones before every block of 512. In a plane
stand the shard's ids in the order that the planes above made: zeros first, ones after,
each stably. So access, counting and search for the n-th place of an id take one rank or
select per plane, and the whole sequence comes back by undoing the planes.

Blobs are rows of a Parquet table, so that any file system Spark writes to can hold them
and a lost task's shards are written anew. A shard closes with the document that takes it
past `SHARD` ids.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoorline.llm.common import Kept, bounded_batches, parts_of, shared_folder

MAGIC = b"WVM1"
RANK = 512
SHARD = 1 << 20
KEPT = 450_000
# The white space of Unicode, at which the tokenizer's words end.
SPACE = re.compile("[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What str.split() takes for white space besides.
SEPARATORS = re.compile("[\x1c-\x1f]")
# The tokenizer's own cut of lower-case text, for the first 256 code points.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}\t\n\v\f\r \x85\xa0]+")
#: Words encoded in one text, between two of the tokenizer's special tokens.
TOGETHER = 200


class Words:
    """A tokenizer whose words are encoded once and remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.border_id, self.border = next((i, t.content) for i, t in special.items() if t.special)
        self.known = Kept(KEPT)

    def cut(self, text: str) -> list[str]:
        """Parts of a text that are encoded alike alone and in the text."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return LATIN.findall(text.lower())
            except UnicodeEncodeError:
                pass
        if SEPARATORS.search(text):
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def learn(self, words: list[str]) -> None:
        """Encodes new words; a special token parts them, so that they share a text."""
        alone = [w for w in words if self.border in w]
        for word, code in zip(alone, self.tokenizer.encode_batch(alone, add_special_tokens=False), strict=True):
            self.known[word] = np.array(code.ids, dtype="<u4").tobytes()
        rest = [w for w in words if self.border not in w] if alone else words
        groups = [rest[at : at + TOGETHER] for at in range(0, len(rest), TOGETHER)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            texts = [self.border.join(group) for group in part]
            for group, code in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(code.ids, dtype="<u4")
                ends = np.flatnonzero(ids == self.border_id)
                octets = ids.tobytes()
                begins = [0, *(4 * (ends + 1)).tolist()]
                self.known.update(
                    (w, octets[a:b]) for w, a, b in zip(group, begins, [*(4 * ends).tolist(), len(octets)], strict=True)
                )

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        self.learn(list(self.known.unknown({w for words in cuts for w in words})))
        tail = struct.pack("<I", end)
        return [b"".join(map(self.known.__getitem__, words)) + tail for words in cuts]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


class Wavelet:
    """A sequence of numbers as bit planes with rank and select."""

    def __init__(self, size: int, planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.size, self.planes, self.ranks = size, planes, ranks
        self.zeros = [size - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, values: np.ndarray) -> Wavelet:
        depth = max(1, int(values.max()).bit_length()) if len(values) else 1
        now, planes, ranks = values.astype(np.uint16 if depth <= 16 else np.uint32), [], []
        for bit in range(depth - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)) != 0
            plane = np.packbits(ones, bitorder="little")
            planes.append(plane)
            ranks.append(cls.counts(plane))
            now = np.concatenate([now[~ones], now[ones]])
        return cls(len(values), planes, ranks)

    @staticmethod
    def counts(plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        step = RANK // 8
        padded = np.zeros(-(-max(1, len(plane)) // step) * step, dtype=np.uint8)
        padded[: len(plane)] = plane
        own = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(own)]).astype("<u4")

    def ones_before(self, level: int, place: int) -> int:
        block, plane = place // RANK, self.planes[level]
        part = plane[block * RANK // 8 : place // 8]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())
        return ones + (int(plane[place // 8]) & ((1 << place % 8) - 1)).bit_count() if place % 8 else ones

    def place_of(self, level: int, bit: int, nth: int) -> int:
        """The place of the nth (from 0) such bit of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * RANK, self.size) - ranks
        block = int(np.searchsorted(before, nth, side="right")) - 1
        part = self.planes[level][block * RANK // 8 : (block + 1) * RANK // 8]
        bits = np.unpackbits(part, bitorder="little")
        return block * RANK + int(np.flatnonzero(bits == bit)[nth - before[block]])

    def access(self, place: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            ones = self.ones_before(level, place)
            bit = int(self.planes[level][place // 8]) >> place % 8 & 1
            value = value << 1 | bit
            place = zeros + ones if bit else place - ones
        return value

    def interval(self, value: int, first: int, last: int) -> tuple[int, int]:
        """Where the value's places from first up to last stand below the lowest plane."""
        if value >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self.ones_before(level, first), self.ones_before(level, last)
            if value >> (len(self.planes) - 1 - level) & 1:
                first, last = zeros + a, zeros + b
            else:
                first, last = first - a, last - b
        return first, last

    def count(self, value: int, first: int = 0, last: int | None = None) -> int:
        a, b = self.interval(value, first, self.size if last is None else last)
        return b - a

    def find(self, value: int, nth: int) -> int:
        """The place of the nth occurrence (from 0) of a value."""
        first, last = self.interval(value, 0, self.size)
        if nth >= last - first:
            raise IndexError(nth)
        place = first + nth
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            place = self.place_of(level, bit, place - self.zeros[level] if bit else place)
        return place

    def values(self) -> np.ndarray:
        """The whole sequence."""
        now = np.zeros(self.size, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for bit, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            now[zeros:] |= now.dtype.type(1 << bit)
            ones = np.unpackbits(plane, count=self.size, bitorder="little").view(bool)
            back = np.empty_like(now)
            back[~ones], back[ones] = now[:zeros], now[zeros:]
            now = back
        return now


def pack(docs: np.ndarray, known: np.ndarray, ends: np.ndarray, values: np.ndarray) -> bytes:
    """A shard's file: documents' ids (known: not null) and ends, the ids' planes."""
    held = Wavelet.build(values)
    sections = [docs.astype("<i8"), known.astype("u1"), ends.astype("<u8"), *held.planes, *held.ranks]
    zip_ = zstandard.ZstdCompressor(level=1)
    packed = [zip_.compress(np.ascontiguousarray(x).tobytes()) for x in sections]
    head = struct.pack("<4sQQI", MAGIC, len(docs), len(values), len(held.planes))
    return head + struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Wavelet]:
    magic, n, size, depth = struct.unpack_from("<4sQQI", blob)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    at = struct.calcsize("<4sQQI")
    sizes = struct.unpack_from(f"<{3 + 2 * depth}Q", blob, at)
    at += 8 * len(sizes)
    unzip = zstandard.ZstdDecompressor()
    parts = []
    for length in sizes:
        parts.append(unzip.decompress(blob[at : at + length]))
        at += length
    docs, known, ends = (np.frombuffer(x, dtype=d) for x, d in zip(parts, ("<i8", "u1", "<u8"), strict=False))
    planes = [np.frombuffer(x, dtype="u1") for x in parts[3 : 3 + depth]]
    ranks = [np.frombuffer(x, dtype="<u4") for x in parts[3 + depth :]]
    return docs, known.astype(bool), ends, Wavelet(size, planes, ranks)


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end: int = 2, id: str = "doc_id", text: str = "text", size: int = SHARD
) -> None:
    """Writes the documents' ids, each with the end id, in ascending order of their id."""
    kind = "part int, seq int, before long, n_tokens long, n_docs long, file binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        codes: list[bytes] = []
        own = words_of(tokenizer)

        def shard() -> pd.DataFrame:
            nonlocal seq, before, ids, codes
            known = np.array([not pd.isna(x) for x in ids], dtype=bool)
            names = np.array([0 if pd.isna(x) else int(x) for x in ids], dtype=np.int64)
            ends = np.cumsum([len(c) // 4 for c in codes], dtype=np.uint64)
            values = np.frombuffer(b"".join(codes), dtype="<u4")
            row = (part, seq, before, len(values), len(ids), pack(names, known, ends, values))
            seq, before, ids, codes = seq + 1, before + len(values), [], []
            return pd.DataFrame([row], columns=["part", "seq", "before", "n_tokens", "n_docs", "file"])

        held = 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                for doc, code in zip(some["id"], own.encode(list(some["t"]), end), strict=True):
                    ids.append(doc)
                    codes.append(code)
                    held += len(code) // 4
                    if held >= size:
                        yield shard()
                        held = 0
        if ids:
            yield shard()

    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.xxhash64(text).alias("mark")
    )
    ordered = rows.repartitionByRange(parts_of(docs.sparkSession), "id", "mark").sortWithinPartitions("id", "mark")
    ordered.select("id", "t").mapInPandas(run, kind).write.option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The shards with `start`, the number of ids in all shards before."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    # A row for each writing task.
    earlier = F.sum("own").over(Window.orderBy("part")) - F.col("own")
    base = totals.select(F.col("part").alias("of"), earlier.alias("base"))
    joined = shards.join(base, shards["part"] == base["of"])
    return joined.withColumn("start", F.col("base") + F.col("before")).drop("of", "base", "before")


def digests(shards: DataFrame) -> DataFrame:
    """Per document from its shard's file: id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, blob in zip(batch["start"], batch["file"], strict=True):
                docs, known, ends, held = unpack(blob)
                octets = memoryview(held.values().astype("<u4").tobytes())
                begins = np.r_[0, ends[:-1]].astype(np.int64)
                crc = [zlib.crc32(octets[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame(
                    {
                        "id": pd.arrays.IntegerArray(docs.copy(), ~known),
                        "start": begins + start,
                        "n_tokens": ends.astype(np.int64) - begins,
                        "ids_crc32": crc,
                    }
                )

    return shards.select("start", "file").mapInPandas(run, "id long, start long, n_tokens long, ids_crc32 long")


def through_files(docs: DataFrame, tokenizer: str, end: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards to the shared folder and reads every document's digest back."""
    spark = docs.sparkSession
    path = shared_folder(spark, "shards")
    write_shards(docs, path, tokenizer, end, id, text)
    return digests(read_shards(spark, path)).withColumnRenamed("id", id)
