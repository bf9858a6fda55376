"""Order MinHash: fingerprints whose likeness follows edit distance, not sets alone.

A text's k-mers of code points are numbered by occurrence, so repeats stay apart. Each of
`functions` hash orders selects the two minimal numbered k-mers; their k-mers, in the
order in which they stand in the text, are hashed as a pair into one 32-bit value. The
likeness of two fingerprints is the share of equal values.

A text shorter than k is one k-mer; a null text counts as empty. The empty text has a
value of its own at all places, so it is like itself only. Texts are taken whole.

`with_next` gives every row its successor by id (after the last the first): ids are cut
into ranges, each range is one sorted run of rows, and only the first row of a range is
copied into the range before it. Null ids come first, equal ids by the text's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import bounded_batches, id_cuts, parts_of, range_number

K = 8
FUNCTIONS = 32
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PLACE_BITS = 24
#: Hash values held at a time.
ROOM = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def factors(functions: int) -> np.ndarray:
    """One odd factor for each hash order."""
    return mixed(np.arange(1, functions + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(points))
    n = len(points) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * STEP + points[i : i + n] + np.uint64(1)
    return mixed(out + np.uint64(k))


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each one."""
    n = len(hashes)
    if n < 1 << PLACE_BITS:
        low = np.uint64((1 << PLACE_BITS) - 1)
        packed = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
        place, value = (packed & low).astype(np.int64), packed >> np.uint64(PLACE_BITS)
    else:
        place = np.argsort(hashes, kind="stable")
        value = hashes[place]
    index = np.arange(n)
    new = np.r_[True, value[1:] != value[:-1]]
    out = np.empty(n, dtype=np.uint64)
    out[place] = index - np.maximum.accumulate(np.where(new, index, 0))
    return out


def signature(points: np.ndarray, k: int = K, functions: int = FUNCTIONS) -> np.ndarray:
    """The fingerprint of a text's code points: `functions` 32-bit values."""
    if not len(points):
        return np.zeros(functions, dtype=np.uint32)
    hashes = kmer_hashes(points, k)
    numbered = mixed(hashes + occurrences(hashes) * STEP)
    pairs = np.empty(functions, dtype=np.uint64)
    step = max(1, ROOM // len(numbered))
    odd = factors(functions)
    for at in range(0, functions, step):
        values = numbered[None, :] * odd[at : at + step, None]
        rows = np.arange(len(values))
        one = values.argmin(axis=1)
        values[rows, one] = np.uint64(0xFFFFFFFFFFFFFFFF)
        two = values.argmin(axis=1) if len(numbered) > 1 else one
        first, second = hashes[np.minimum(one, two)], hashes[np.maximum(one, two)]
        pairs[at : at + step] = mixed(mixed(first) + second * STEP)
    return (pairs >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def with_next(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (run, copy, id, mark, t) in runs; a copy only serves the row before it."""
    parts = 4 * parts_of(docs.sparkSession)
    number = range_number(F.col(id), id_cuts(docs, id, parts))
    rank = F.struct(F.col(id).isNotNull().alias("known"), F.col(id).cast("long").alias("id"))
    found = docs.select(number.alias("run"), rank.alias("rank")).groupBy("run").agg(F.min("rank").alias("r"))
    heads = sorted((r["run"], r["r"]["id"]) for r in found.collect())
    before = [heads[i - 1][0] for i in range(len(heads))]
    rows = [(head, run) for (_, head), run in zip(heads, before, strict=True)]
    # At most as many rows as there are ranges.
    small = docs.sparkSession.createDataFrame(rows, "head long, to int")
    narrow = docs.select(
        number.alias("run"), F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    joined = narrow.join(F.broadcast(small), narrow["id"].eqNullSafe(small["head"]), "left")
    own = F.struct(F.col("run"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("to").alias("run"), F.lit(True).alias("copy"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))
    spread = joined.select(F.explode(places).alias("p"), "id", "t").select("p.*", "id", "t")
    return (
        spread.withColumn("mark", F.xxhash64("t"))
        .repartition(parts_of(docs.sparkSession), "run")
        .sortWithinPartitions("run", "copy", "id", "mark")
    )


def edited(text: str, after: str) -> str:
    """The last half of the text's code points replaced by the first of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def order_minhash(
    docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, functions: int = FUNCTIONS
) -> DataFrame:
    """Per row: id, n_chars, fingerprints of the text and its edited text, both likenesses."""
    kind = (
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    names = [part.split()[0] for part in kind.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out = []
            for number, copy, doc, body in zip(batch["run"], batch["copy"], batch["id"], batch["t"], strict=True):
                own = signature(points_of(body), k, functions)
                if last and last[0] == number and not last[1]:
                    _, _, one, before, mark = last
                    new = edited(before, body)
                    changed = signature(points_of(new), k, functions)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    near = likeness(mark, changed), likeness(mark, own)
                    out.append((one, len(before), digest, shown(mark), shown(changed), *near))
                last = (number, copy, doc, body, own)
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    bounded_batches(docs.sparkSession)
    rows = with_next(docs, id, text).select("run", "copy", "id", "t").mapInPandas(run, kind)
    return rows.withColumnRenamed("id", id)
