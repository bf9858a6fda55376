"""The events table: one wide row per thing that happened."""

from __future__ import annotations

from pyspark.sql import types as T

# Severity levels, least serious first (the index is the rank).
LEVELS = ("info", "low", "med", "high", "crit")
LEVEL_RANK = {name: rank for rank, name in enumerate(LEVELS)}

# Where an event's time comes from: the evidence recorded it; a file's change time
# stands in for it; a scan of ours found it and it carries the time of what was scanned.
LOGGED, FILE_TIME, SCAN_TIME = "logged", "file", "scan"

_S = T.StringType()

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("ts", _S),
        T.StructField("ts_epoch", T.LongType()),
        T.StructField("ts_desc", _S),
        T.StructField("time_kind", _S),
        T.StructField("host", _S),
        T.StructField("user", _S),
        T.StructField("event_type", _S),
        T.StructField("source_artifact", _S),
        T.StructField("artifact_id", T.LongType()),
        T.StructField("artifact_path", _S),
        T.StructField("parser", _S),
        T.StructField("event_id", _S),
        T.StructField("channel", _S),
        T.StructField("record_id", _S),
        T.StructField("severity", _S),
        T.StructField("sev_rank", T.IntegerType()),
        T.StructField("message", _S),
        T.StructField("title", _S),
        T.StructField("details", _S),
        T.StructField("extra_fields", _S),
        T.StructField("raw", _S),
        T.StructField("data", T.MapType(_S, _S)),
        T.StructField("tags", T.ArrayType(_S)),
        T.StructField("attck", T.ArrayType(_S)),
    ]
)

EVENT_COLUMNS = tuple(EVENTS_SCHEMA.fieldNames())

# One row per file of a case.
ARTIFACTS_SCHEMA = T.StructType(
    [
        T.StructField("artifact_id", T.LongType()),
        T.StructField("path", _S),
        T.StructField("sha256", _S),
        T.StructField("kind", _S),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
    ]
)
