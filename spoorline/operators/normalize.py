"""Source rows become rows of the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.levels import clamp_level, level_rank
from spoorline.functions.text import SEP, blank_to_null, or_blank, pretty, strings
from spoorline.functions.times import seconds_text, to_utc
from spoorline.operators.running import RunningSum, running
from spoorline.schema import EVENTS_SCHEMA, LOGGED

ID_DIGITS = 15


def wide_id(*parts: Column | str | int) -> Column:
    """The first 60 bits of the MD5 of the parts, one a line: positive, the same everywhere."""
    texts = [part.cast("string") if isinstance(part, Column) else F.lit(str(part)) for part in parts]
    digest = F.md5(F.array_join(F.array(*texts), "\n", ""))
    return F.conv(F.substring(digest, 1, ID_DIGITS), 16, 10).cast("long")


def line_id(path: Column, line_no: Column, emission: Column | int | str = 0) -> Column:
    """A stable event id from the file's path, the line number and the place among its events.

    It needs no numbering of the files, so parts of a case that are read apart can be
    put together, and files and lines have no upper limit.
    """
    return wide_id(path, line_no, emission)


def number_artifacts(artifacts: DataFrame) -> DataFrame:
    """Adds a dense ``artifact_id``, the same on every run over the same files.

    Numbered in hash order, so no task holds more than 1/4096 of the files.
    """
    keyed = artifacts.dropDuplicates(["path", "sha256"]).withColumn(
        "__h", F.sha2(F.concat_ws("\n", "path", "sha256"), 256)
    )
    bucket = F.conv(F.left(F.col("__h"), F.lit(3)), 16, 10).cast("long")
    numbered = running(
        keyed.withColumn("__all", F.lit(0)),
        ["__all"],
        ["__h"],
        bucket,
        artifact_id=RunningSum(F.lit(1), inclusive=True),
    )
    return numbered.drop("__h", "__all")


def valid_techniques(ids: Column, known: Column | None = None) -> Column:
    """Upper-cased, distinct, in order; unknown ids dropped when a table is given."""
    tidy = F.array_distinct(
        F.filter(F.transform(ids, lambda t: F.upper(F.trim(t))), lambda t: t != "")
    )
    if known is None:
        return tidy
    return F.array_intersect(tidy, known)


def with_valid_techniques(
    events: DataFrame, techniques: DataFrame | None, column: str = "attck"
) -> DataFrame:
    """``valid_techniques`` against a dimension table with a ``technique_id`` column.

    The table becomes one array through a scalar subquery (a few thousand ids,
    fixed by the published matrix). An empty table keeps every id.
    """
    if techniques is None:
        return events.withColumn(column, valid_techniques(F.col(column)))
    ids = techniques.agg(F.collect_set(F.upper("technique_id")).alias("ids"))
    known = ids.scalar()
    kept = F.when(F.size(known) == 0, valid_techniques(F.col(column))).otherwise(
        valid_techniques(F.col(column), known)
    )
    return events.withColumn(column, kept)


def normalize(df: DataFrame, host: str = "", zone: Column | str = "UTC") -> DataFrame:
    """Complete partial event rows to the full schema.

    Expects ``event_time`` (UTC), or ``local_time`` without a zone which is
    read in ``zone``. A row without any time is left out: an event always has
    one. Title, details and message fill each other in.
    """
    have = set(df.columns)

    def col(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    blank = F.lit("")
    at = F.col("event_time") if "event_time" in have else F.lit(None).cast("timestamp")
    if "local_time" in have:
        at = F.coalesce(at, to_utc(F.col("local_time"), zone))

    title, details = col("title", blank), col("details", blank)
    # Values used more than once become columns first, so that each is worked
    # out once; the second step only reads columns.
    staged = df.filter(at.isNotNull()).select(
        *df.columns,
        at.alias("__at"),
        F.coalesce(
            blank_to_null(col("message", blank)),
            F.concat_ws(SEP, blank_to_null(title), blank_to_null(details)),
        ).alias("__message"),
        clamp_level(col("severity", F.lit("info"))).alias("__severity"),
        col("event_type", F.lit("generic")).alias("__type"),
    )
    at, message = F.col("__at"), F.col("__message")
    after = F.when(
        message.contains(SEP), message.substr(F.instr(message, SEP) + len(SEP), F.length(message))
    ).otherwise(message)
    values = {
        "id": F.col("id") if "id" in have else F.lit(None),
        "event_time": at,
        "event_date": F.to_date(at),
        "ts": seconds_text(at),
        "ts_epoch": F.unix_micros(at),
        "ts_desc": col("ts_desc", blank),
        "time_kind": col("time_kind", F.lit(LOGGED)),
        "host": F.coalesce(blank_to_null(col("host", blank)), F.lit(host)),
        "event_type": F.col("__type"),
        "severity": F.col("__severity"),
        "sev_rank": level_rank(F.col("__severity")),
        "message": message,
        "title": F.coalesce(blank_to_null(title), pretty(F.col("__type"))),
        "details": F.coalesce(blank_to_null(details), after),
        "data": col("data", F.create_map().cast("map<string,string>")),
        "tags": col("tags", strings([])),
        "attck": valid_techniques(col("attck", strings([]))),
    }
    optional = {"artifact_id", "event_id", "record_id", "raw"}
    for field in EVENTS_SCHEMA.fields:
        if field.name in values:
            continue
        present = F.col(field.name) if field.name in have else F.lit(None)
        values[field.name] = present if field.name in optional else or_blank(
            present.cast("string")
        )
    return staged.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in EVENTS_SCHEMA.fields]
    )


def union_events(*parts: DataFrame) -> DataFrame:
    """Outputs of several normalizers as one table."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
