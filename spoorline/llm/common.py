"""What the operators share: tables, the cluster's shared folder, ranges of an id, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below `spark.checkpoint.dir`, which all executors share.

    Only where the session names none (tests on one machine) a local folder is set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to a size that a small Python worker can hold.

    Texts vary from nothing to megabytes, so the default of 10,000 rows bounds nothing.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows as one column `row`, so that no name of theirs meets the operator's own."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *more)


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` and the new ones; a new one takes the place of its namesake."""
    names = {c.lower() for c in docs.columns}
    known = {k.lower(): v for k, v in new.items()}
    old = [known.get(c.lower(), F.col("row").getField(c)).alias(c) for c in docs.columns]
    return rows.select(*old, *(v.alias(k) for k, v in new.items() if k.lower() not in names))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ids that cut the table into ranges of about equal row counts."""
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    got = df.select(F.col(key).cast("double").alias("k")).approxQuantile(
        "k", shares, 1 / (4 * parts)
    )
    return sorted({int(x) for x in got})


def range_number(key: Column, cuts: list[int]) -> Column:
    """Which range an id falls in, from 0; a null id comes before all others."""
    edges = np.array(cuts, dtype="float64")

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy(dtype="float64", na_value=-np.inf)
        return pd.Series(np.searchsorted(edges, values, side="right").astype("int32"))

    return number(key.cast("long"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of longs: rows (node, label), label the smallest.

    Alternating large and small stars; every half step is written, so a join's two sides
    are both shuffled and Spark can split the key of a hub. Nodes without a link to
    another node are absent. Null ends are ignored.
    """
    links = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select("v", "u"))
        low = written(
            both.groupBy(F.col("u").alias("k")).agg(F.least("k", F.min("v")).alias("m")), "low"
        )
        large = (
            both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        links = written(large.distinct(), "links")
        low = written(links.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "low")
        small = (
            links.join(low, F.col("u") == F.col("k"))
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        links = written(small.union(low.select("k", "m")).distinct(), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        links.select("v", "v").distinct()
    )


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


class Kept(dict):
    """A dictionary of at most about two times `size` entries: those of late use stay."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size
        self.older: dict = {}

    def unknown(self, keys: set) -> set:
        """The keys that have no value; what is known among them is taken over."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        # Not keys.difference(self): for a kind of dict that reads every key of it.
        new = {k for k in keys if k not in self}
        if self.older:
            old = new.intersection(self.older)
            self.update((k, self.older[k]) for k in old)
            new -= old
        return new
