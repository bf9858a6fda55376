"""Persisted events and the timeline export formats."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.functions.text import SEP, blank_to_null, or_blank, pretty
from spoorline.schema import LEVEL_RANK

# The columns of the foreign formats, in order.
TIMESKETCH_COLUMNS = (
    "message", "datetime", "timestamp_desc", "data_type", "host", "user",
    "source", "tag", "attck", "severity",
)
L2T_COLUMNS = (
    "date", "time", "timezone", "MACB", "source", "sourcetype", "type", "user",
    "host", "short", "desc", "version", "filename", "inode", "notes", "format", "extra",
)
CSV_COLUMNS = (
    "Timestamp", "Level", "Title", "Host", "Channel", "EventID", "User", "Details",
    "Type", "TimestampDesc", "ATTCK", "Tags", "Source", "RecordId", "ExtraFields",
    "ArtifactPath", "Id",
)


def _clustered(events: DataFrame):
    """Rows dealt out by day, host and time: each file holds one stretch of that order.

    Tasks hold ranges, so all days together have at most a file for each task and one more
    for each day, and a reader of one host or hour opens few of them.
    """
    order = ["event_date", "host", "ts_epoch", "id"]
    return events.repartitionByRange(*order[:3]).sortWithinPartitions(*order).write.partitionBy("event_date")


def write_events(events: DataFrame, path: str) -> None:
    """Replace the case at ``path``, one folder per day.

    The new case is written beside the old one and takes its place only when it is whole: a
    run that fails leaves the old case as it was. On a file system the change of place is a
    rename; on an object store give each run a path of its own instead.
    """
    spark = events.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    base, run = path.rstrip("/"), uuid.uuid4().hex
    staged, old = f"{base}_staged_{run}", f"{base}_old_{run}"
    system = at(base).getFileSystem(conf)
    try:
        _clustered(events).parquet(staged)
    except BaseException:
        system.delete(at(staged), True)
        raise
    if system.exists(at(base)) and not system.rename(at(base), at(old)):
        raise OSError(f"{base} could not be moved aside")
    if not system.rename(at(staged), at(base)):
        system.rename(at(old), at(base))
        raise OSError(f"{staged} could not take the place of {base}")
    system.delete(at(old), True)


def write_days(events: DataFrame, path: str) -> None:
    """Replace only the days that ``events`` has; the committer moves them in when all are written."""
    (
        _clustered(events)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def write_bucketed(rows: DataFrame, name: str, path: str, key: str, buckets: int = 64) -> DataFrame:
    """The rows as table ``name`` at ``path``, dealt into buckets by ``key`` and sorted in them.

    Tables of equal bucket number are joined and grouped by their keys without an exchange,
    however often. Choose buckets so that one holds some hundred MB.
    """
    (
        rows.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )
    return rows.sparkSession.table(name)


def hit_links(hits: DataFrame) -> DataFrame:
    """(matched_id, id, rule, severity) of hit events: what leads from a hit to its event."""
    data = F.col("data")
    return hits.select(
        data["matched_event_id"].cast("long").alias("matched_id"), "id", data["rule"].alias("rule"), "severity"
    )


def linked_events(links: DataFrame, events: DataFrame) -> DataFrame:
    """The events that hits point at, each once, with the number of hits and their worst level."""
    rank = F.element_at(F.create_map(*[x for k, v in LEVEL_RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("severity"))
    told = links.groupBy("matched_id").agg(F.count(F.lit(1)).alias("hits"), F.max(rank).alias("worst"))
    return events.join(told, events["id"] == told["matched_id"]).drop("matched_id")


def _text(name: str):
    return or_blank(F.col(name).cast("string"))


def timeline_rows(events: DataFrame) -> DataFrame:
    """The 17 columns a person reads; title and details are never blank."""
    values = {
        "Timestamp": _text("ts"),
        "Level": F.coalesce(blank_to_null(F.col("severity")), F.lit("info")),
        "Title": F.coalesce(blank_to_null(F.col("title")), pretty(F.col("event_type"))),
        "Host": _text("host"),
        "Channel": _text("channel"),
        "EventID": _text("event_id"),
        "User": _text("user"),
        "Details": F.coalesce(blank_to_null(F.col("details")), _text("message")),
        "Type": _text("event_type"),
        "TimestampDesc": _text("ts_desc"),
        "ATTCK": F.concat_ws(" ", "attck"),
        "Tags": F.concat_ws(" ", "tags"),
        "Source": _text("source_artifact"),
        "RecordId": _text("record_id"),
        "ExtraFields": _text("extra_fields"),
        "ArtifactPath": _text("artifact_path"),
        "Id": _text("id"),
    }
    return events.select(*[values[c].alias(c) for c in CSV_COLUMNS])


def triage_rows(events: DataFrame) -> DataFrame:
    return timeline_rows(events.filter(F.col("sev_rank") >= LEVEL_RANK["med"]))


def timesketch_rows(events: DataFrame) -> DataFrame:
    values = {
        "message": F.coalesce(
            blank_to_null(F.col("message")),
            F.concat_ws(SEP, blank_to_null(F.col("title")), blank_to_null(F.col("details"))),
        ),
        "datetime": F.concat(F.translate(F.col("ts"), " ", "T"), F.lit("Z")),
        "timestamp_desc": F.coalesce(blank_to_null(F.col("ts_desc")), F.lit("Event Logged")),
        "data_type": F.coalesce(blank_to_null(F.col("event_type")), F.lit("generic")),
        "host": _text("host"),
        "user": _text("user"),
        "source": _text("source_artifact"),
        "tag": F.concat_ws(" ", "tags"),
        "attck": F.concat_ws(" ", "attck"),
        "severity": F.coalesce(blank_to_null(F.col("severity")), F.lit("info")),
    }
    return events.select(*[values[c].alias(c) for c in TIMESKETCH_COLUMNS])


def l2t_rows(events: DataFrame) -> DataFrame:
    message = _text("message")
    values = {
        "date": F.date_format("event_time", "MM/dd/yyyy"),
        "time": F.date_format("event_time", "HH:mm:ss"),
        "timezone": F.lit("UTC"),
        "MACB": F.coalesce(F.col("data")["macb"], F.lit("....")),
        "source": F.coalesce(blank_to_null(F.col("parser")), F.lit("spoorline")),
        "sourcetype": _text("source_artifact"),
        "type": _text("ts_desc"),
        "user": _text("user"),
        "host": _text("host"),
        "short": F.left(message, F.lit(80)),
        "desc": message,
        "version": F.lit("2"),
        "filename": _text("artifact_path"),
        "inode": F.lit("-"),
        "notes": F.concat_ws(" ", "attck"),
        "format": _text("parser"),
        "extra": F.coalesce(F.to_json("data"), F.lit("{}")),
    }
    return events.select(*[values[c].alias(c) for c in L2T_COLUMNS])


def _write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_timeline_csv(events: DataFrame, path: str) -> None:
    _write_csv(timeline_rows(events), path)


def to_triage_csv(events: DataFrame, path: str) -> None:
    _write_csv(triage_rows(events), path)


def to_jsonl(events: DataFrame, path: str) -> None:
    """One lossless object per line."""
    events.write.mode("overwrite").json(path)


def to_timesketch_csv(events: DataFrame, path: str) -> None:
    _write_csv(timesketch_rows(events), path)


def to_l2tcsv(events: DataFrame, path: str) -> None:
    _write_csv(l2t_rows(events), path)


EXPORTS: dict[str, Callable[[DataFrame, str], None]] = {
    "csv": to_timeline_csv,
    "triage": to_triage_csv,
    "jsonl": to_jsonl,
    "timesketch": to_timesketch_csv,
    "l2tcsv": to_l2tcsv,
}


def export(events: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt not in EXPORTS:
        raise ValueError(f"unknown format {fmt!r}: choose from {', '.join(sorted(EXPORTS))}")
    EXPORTS[fmt](events, path)
