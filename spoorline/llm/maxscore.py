"""Exact top-k by inner product of integer vectors, with MaxScore in each shard.

The terms of a query are the dimensions of its vector, their postings the components of a
shard's vectors, and a term's bound is the most that any vector of the shard can gain by it.
With the terms in falling order of bounds, those at the end whose bounds together stay below
the k-th best score so far are non-essential: a vector has to earn the difference in the
essential ones. So the essential postings are traversed for all vectors of the shard, and
the others are probed, a few at a time, only for vectors whose score so far plus all bounds
still open reaches the k-th best. A first piece of the shard, scored whole, gives the k-th
best to begin with. Nothing is approximate: a vector is dropped when it cannot reach it.

Shards are cut by a hash of row and id, queries into blocks; a task has one shard and one
block, both of bounded size. The best k of every shard meet in a row number per query.

Equal rows (id and vector) are counted before they are dealt out, as at most k + 1 of them
can show; a query's own row is one of them. Inputs: vectors that are null or hold a null or
a non-finite component take no part; a shorter vector has zeros at its end; a null id is
no query by divisibility, and as a candidate comes after all ids in a tie. Repeated query
rows have their results repeated. Other columns are ignored; no vectors, no rows. Scores
have to fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.llm.common import bounded_batches, written

K = 20
SCALE = 64
#: Most rows of a shard and of a block of queries: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 1 << 16, 1 << 14
#: Fewer rows are not worth a shard.
LEAST_ROWS = 1 << 10
#: Non-essential terms are probed so many at a time.
PROBED = 8
RESULT = "query_key long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; unusable vectors are left out."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return vectors.where(x.isNotNull() & sound).select("vec_id", whole.cast("array<bigint>").alias("v"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    """The vectors as rows of equal width, zeros at the end of shorter ones."""
    sizes = rows.map(len).to_numpy()
    out = np.zeros((len(rows), width), dtype=np.int64)
    if len(rows) and (sizes == width).all():
        return np.stack(rows.to_list()).astype(np.int64, copy=False).reshape(len(rows), width)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Shard:
    """The postings of a shard's vectors and the best rows of a query in it."""

    def __init__(self, vectors: np.ndarray, dtype: type) -> None:
        self.postings = np.ascontiguousarray(vectors.T.astype(dtype))
        self.high = self.postings.max(axis=1)
        self.low = self.postings.min(axis=1)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The most each term of the query can add to a score."""
        return np.maximum(np.maximum(query * self.high, query * self.low), 0)

    def search(self, query: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, ties to the smaller row; `own` is not a candidate."""
        terms, rows = self.postings.shape
        bound = self.bounds(query)
        order = np.argsort(-bound, kind="stable")
        left = np.concatenate((np.cumsum(bound[order][::-1])[::-1], np.zeros(1, bound.dtype)))
        # The k-th best of the first rows is a floor for all of them.
        first = query @ self.postings[:, : min(rows, max(4 * k, rows // 16))]
        if own is not None and own < len(first):
            first = np.delete(first, own)
        floor = np.partition(first, -k)[-k] if len(first) >= k else None
        essential = terms if floor is None else int(np.argmax(np.append(left < floor, True)))
        essential = min(essential, terms)
        used = order[:essential]
        score = query[used] @ self.postings[used]
        alive = np.arange(rows) if floor is None else np.flatnonzero(score + left[essential] >= floor)
        score = score[alive]
        at = essential
        while at < terms and len(alive):
            used = order[at : at + PROBED]
            at += len(used)
            score = score + query[used] @ self.postings[np.ix_(used, alive)]
            if floor is not None:
                still = score + left[at] >= floor
                alive, score = alive[still], score[still]
        if own is not None:
            other = alive != own
            alive, score = alive[other], score[other]
        if len(alive) > k:
            # The scores' k-th best and all that equal it; the sort below keeps k of them.
            enough = score >= np.partition(score, -k)[-k]
            alive, score = alive[enough], score[enough]
        best = np.lexsort((alive, -score))[:k]
        return alive[best], score[best]


def search_block(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best candidates of a shard for each query of a block."""
    if not len(candidates) or not len(queries):
        return
    candidates = candidates.sort_values("vec_id", kind="stable", na_position="last").reset_index(drop=True)
    width = int(max(candidates["v"].map(len).max(), queries["v"].map(len).max(), 1))
    vectors, wanted = matrix(candidates["v"], width), matrix(queries["v"], width)
    largest = float(np.abs(wanted.astype(np.float64)).sum(axis=1).max()) * float(np.abs(vectors.astype(np.float64)).max())
    dtype = np.float64 if largest < 2.0**52 else np.int64
    shard = Shard(vectors, dtype)
    places: dict[int, list[int]] = {}
    ids = candidates["vec_id"].astype("Int64")
    asked = set(queries["query_id"].dropna().astype("int64"))
    for row, i in enumerate(ids):
        if i is not pd.NA and int(i) in asked:
            places.setdefault(int(i), []).append(row)
    for key, i, query, raw in zip(queries["query_key"], queries["query_id"], wanted.astype(dtype), wanted):
        own = None if pd.isna(i) else next((r for r in places.get(int(i), ()) if (vectors[r] == raw).all()), None)
        rows, scores = shard.search(query, k, own)
        yield pd.DataFrame(
            {"query_key": int(key), "vec_id": ids.iloc[rows].to_numpy(), "score": scores.astype(np.int64)}
        )


def exact_topk(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `is_query`, the k best other rows.

    `vectors`: (vec_id, v array<bigint>).
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    counted = vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    distinct = written(
        counted.select("*", F.monotonically_increasing_id().alias("query_key"), F.coalesce(is_query, F.lit(False)).alias("asked")),
        "vectors",
    )
    total, asked = distinct.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    tasks = 2 * spark.sparkContext.defaultParallelism
    shard_rows = min(SHARD_ROWS, max(LEAST_ROWS, total // tasks))
    shards, blocks = -(-total // shard_rows) or 1, -(-asked // BLOCK_ROWS) or 1
    queries = written(distinct.where("asked").select("query_key", F.col("vec_id").alias("query_id"), "v", "copies"), "queries")

    place = F.xxhash64("query_key", F.lit("place"))
    left = distinct.select(
        F.pmod(place, F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        "vec_id",
        "v",
        F.least("copies", F.lit(k + 1)).cast("int").alias("shown"),
    ).select("shard", "block", "vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("shown"))).alias("copy"))
    right = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(place, F.lit(blocks)).alias("block"),
        "query_key",
        "query_id",
        "v",
    )

    def best(_, candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        parts = list(search_block(candidates, wanted, k))
        empty = pd.DataFrame({"query_key": [], "vec_id": [], "score": []}).astype("int64")
        return pd.concat(parts, ignore_index=True) if parts else empty

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(best, RESULT)
    in_order = Window.partitionBy("query_key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    merged = found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    copies = queries.select("query_key", "query_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return merged.join(copies, "query_key").select("query_id", "rank", "vec_id", "score")


#: The same from all pairs, for the table `embeddings`.
TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(
    range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.place <> c.place WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
