"""Counts, facets, coverage and case figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.paths import is_collector_noise
from spoorline.functions.text import blank_to_null, file_name
from spoorline.operators.filters import EventFilter, events_where

# Columns a facet may be taken of.
FACETS = (
    "host", "user", "event_type", "source_artifact", "parser", "severity",
    "event_id", "channel", "title",
)
NOISE_TAGS = ("private", "allowlisted", "loopback", "reserved")


def count_events(events: DataFrame, wanted: EventFilter = EventFilter()) -> DataFrame:
    return events.filter(events_where(wanted)).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-blank values and their counts, most frequent first."""
    value = F.col(column)
    return (
        df.filter(value.isNotNull() & (value.cast("string") != ""))
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "value")
    )


def facets(events: DataFrame, column: str) -> DataFrame:
    if column not in FACETS:
        raise ValueError(f"not a facet column: {column}")
    return value_counts(events, column)


def level_counts(events: DataFrame) -> DataFrame:
    level = F.coalesce(blank_to_null(F.col("severity")), F.lit("info"))
    return events.groupBy(level.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def attck_summary(events: DataFrame) -> DataFrame:
    return (
        events.select(F.explode("attck").alias("technique_id"))
        .groupBy("technique_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "technique_id")
    )


def with_technique_names(summary: DataFrame, techniques: DataFrame) -> DataFrame:
    """Adds name and tactics from a user-supplied ``techniques`` dimension."""
    names = techniques.select(
        F.upper("technique_id").alias("technique_id"), "name", "tactics"
    )
    return summary.join(names, "technique_id", "left")


def coverage(events: DataFrame, limit: int = 6, parser: str = "evtx") -> DataFrame:
    """Per channel: rows, rows without a template, templated share in percent."""
    channel = F.coalesce(
        blank_to_null(F.col("channel")), blank_to_null(F.col("source_artifact")),
        F.lit("(unknown)"),
    )
    total = F.count(F.lit(1))
    auto = F.count_if(F.array_contains("tags", "auto_fields"))
    return (
        events.filter(F.col("parser") == parser)
        .groupBy(channel.alias("channel"))
        .agg(
            total.alias("total"),
            auto.alias("auto"),
            (F.lit(100.0) * (total - auto) / total).alias("templated_pct"),
        )
        .orderBy(F.col("total").desc(), "channel")
        .limit(limit)
    )


def top_unrecognized(events: DataFrame, limit: int = 8, parser: str = "evtx") -> DataFrame:
    """Untemplated (provider, event id) by volume: the templates worth writing next."""
    provider = F.coalesce(blank_to_null(F.col("data")["provider"]), F.lit("?"))
    channel = F.coalesce(blank_to_null(F.col("channel")), F.lit("?"))
    return (
        events.filter((F.col("parser") == parser) & F.array_contains("tags", "auto_fields"))
        .groupBy(provider.alias("provider"), "event_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min(channel).alias("channel"))
        .orderBy(F.col("n").desc(), "provider", "event_id")
        .limit(limit)
    )


def artifact_status(
    artifacts: DataFrame, events: DataFrame, problems: DataFrame | None = None
) -> DataFrame:
    """Per file: parsed / error / unsupported, with parser, event count and hint.

    ``problems``: (path, error) of files that could not be read.
    """
    counts = events.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))
    rows = artifacts.join(counts, "artifact_id", "left").withColumn(
        "event_count", F.coalesce("n", F.lit(0))
    )
    if problems is None:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    else:
        rows = rows.join(problems.select("path", "error"), "path", "left")
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("parser").isNull(), "unsupported")
        .otherwise("parsed")
    )
    return rows.withColumn("status", status).drop("n")


def _unparsed(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status").isin("unsupported", "error"))


def _extension(path: Column) -> Column:
    name = file_name(path)
    return F.when(
        name.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))
    ).otherwise("(no extension)")


def not_parsed_by_type(status: DataFrame) -> DataFrame:
    """Unparsed files that may be evidence, per extension: count, largest, example."""
    gaps = _unparsed(status).filter(~is_collector_noise(F.col("path")))
    return (
        gaps.groupBy(_extension(F.col("path")).alias("extension"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.max("size").alias("largest"),
            F.max(F.struct("size", file_name(F.col("path")).alias("name")))["name"].alias(
                "example"
            ),
        )
        .orderBy(F.col("files").desc(), "extension")
    )


def sweepings(status: DataFrame) -> DataFrame:
    """How many unparsed files are collector sweepings, one row."""
    return _unparsed(status).agg(
        F.count_if(is_collector_noise(F.col("path"))).alias("sweepings"),
        F.count_if(~is_collector_noise(F.col("path"))).alias("gaps"),
    )


def largest_unparsed(status: DataFrame, limit: int = 8, over: int = 100_000) -> DataFrame:
    """The biggest unparsed files that may be evidence."""
    return (
        _unparsed(status)
        .filter(~is_collector_noise(F.col("path")) & (F.col("size") > over))
        .select(file_name(F.col("path")).alias("name"), "size", "status", "error")
        .orderBy(F.col("size").desc(), "name")
        .limit(limit)
    )


def top_artifacts(status: DataFrame, limit: int = 200) -> DataFrame:
    """Parsed and failed files by what they gave."""
    return (
        status.filter(F.col("status").isin("parsed", "error"))
        .orderBy(F.col("event_count").desc(), "path")
        .limit(limit)
    )


def case_summary(
    status: DataFrame, events: DataFrame, findings: DataFrame, iocs: DataFrame
) -> DataFrame:
    """One row of figures: files, events, high rows, detections, indicators."""
    noisy = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in NOISE_TAGS]))
    files = status.agg(
        F.count_if(F.col("status") == "parsed").alias("parsed"),
        F.count_if(F.col("status") == "unsupported").alias("unsupported"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    of_events = events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("severity").isin("high", "crit")).alias("high_events"),
    )
    of_iocs = iocs.agg(
        F.count(F.lit(1)).alias("indicators"),
        F.count_if(~F.coalesce(noisy, F.lit(False))).alias("interesting_indicators"),
    )
    of_findings = findings.agg(F.count(F.lit(1)).alias("detections"))
    # One-row results are read as scalar subqueries: nothing is joined.
    return beside(files, of_events, of_findings, of_iocs)


def beside(row: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side, the others as scalar subqueries of structs."""
    for number, other in enumerate(others):
        name = f"__r{number}"
        packed = other.select(F.struct(*other.columns).alias("s")).scalar()
        row = row.withColumn(name, packed).select(
            *row.columns, *[F.col(name)[c].alias(c) for c in other.columns]
        )
    return row


def events_with_artifacts(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Provenance: kind, size and hash of the file each event came from."""
    facts = artifacts.select("artifact_id", "sha256", "kind", "size")
    return events.join(facts, "artifact_id", "left")


def diagnostics(*causes: DataFrame) -> DataFrame:
    """(path, cause, lines) of every reader's own diagnostics."""
    whole = causes[0]
    for part in causes[1:]:
        whole = whole.unionByName(part)
    return whole
