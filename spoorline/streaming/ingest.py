"""Micro-batch ingest: every batch goes through the batch operators.

The normalizers keep state within a file only, so a batch that holds whole files
gives the same events as one big run. Nothing is kept between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spoorline.sources.lines import plain_path


def stream_texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as (path, text, mtime), one row per file."""
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("value").alias("text"),
            F.col("_metadata.file_modification_time").alias("mtime"),
        )
    )


def texts_to_lines(texts: DataFrame) -> DataFrame:
    """The lines the batch reader gives: no carriage returns, no empty line after the last end."""
    ended = F.regexp_replace("text", r"\r+(?=\n|\z)", "")
    lines = F.split(F.regexp_replace(ended, r"\n\z", ""), "\n")
    return texts.select("path", "mtime", F.posexplode(lines).alias("__at", "value")).select(
        "path", (F.col("__at") + 1).cast("long").alias("line_no"), "value", "mtime"
    )


def ingest(
    texts: DataFrame,
    normalizer: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append each batch's events under its batch number; a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        events = normalizer(texts_to_lines(batch))
        events.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        texts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
