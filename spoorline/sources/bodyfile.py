"""Filesystem timelines: eleven fields between pipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.text import SEP, blank_to_null, if_any, let, payload, strings
from spoorline.functions.times import epoch_time
from spoorline.operators.correlate import distinct_time_flags
from spoorline.operators.normalize import line_id, normalize, union_events
from spoorline.operators.scoring import score_file_entry

PARSER = "bodyfile"
FIELDS = 11


def bodyfile_fields(line: Column) -> Column:
    """struct(md5, name, inode, mode, uid, gid, size, a, m, c, b), null if not one.

    Names may hold pipes: the last nine fields are bound from the right.
    """
    def bound(parts: Column) -> Column:
        count = F.size(parts)
        tail = F.slice(parts, -9, 9)
        name = F.array_join(F.slice(parts, 2, F.greatest(count - 10, F.lit(0))), "|")
        field = lambda i: F.get(tail, F.lit(i))
        digest = F.get(parts, F.lit(0))
        return F.when(
            (count >= FIELDS) & (name != ""),
            F.struct(
                F.when(digest == "0", "").otherwise(digest).alias("md5"),
                name.alias("name"),
                field(0).alias("inode"),
                field(1).alias("mode"),
                field(2).alias("uid"),
                field(3).alias("gid"),
                field(4).alias("size"),
                epoch_time(field(5)).alias("a"),
                epoch_time(field(6)).alias("m"),
                epoch_time(field(7)).alias("c"),
                epoch_time(field(8)).alias("b"),
            ),
        )

    # Ten pipes at least, so that the slices below are never out of range.
    usable = ~line.startswith("#") & line.rlike(r"^(?:[^|]*\|){10}")
    return F.when(usable, let(F.split(line, r"\|"), bound))


def read_bodyfile(lines: DataFrame) -> DataFrame:
    """One row per filesystem entry; other lines are left out."""
    parsed = lines.select("*", if_any(bodyfile_fields(F.col("value"))).alias("entry"))
    return parsed.select(*[c for c in lines.columns if c != "value"], "entry.*")


def macb_rows(entries: DataFrame) -> DataFrame:
    """One row per distinct time of an entry; ``macb`` says what the time is."""
    return distinct_time_flags(
        entries, {"m": "m", "a": "a", "c": "c", "b": "b"}, at="event_time", flags="macb"
    )


def macb_meaning(macb: Column) -> Column:
    words = F.array_compact(
        F.array(
            F.when(macb.contains("m"), F.lit("Modified")),
            F.when(macb.contains("a"), F.lit("Accessed")),
            F.when(macb.contains("c"), F.lit("Changed")),
            F.when(macb.contains("b"), F.lit("Created")),
        )
    )
    return F.coalesce(blank_to_null(F.array_join(words, "/")), F.lit("File timestamp"))


def macb_title(macb: Column, mode: Column) -> Column:
    kind = (
        F.when(mode.startswith("d"), "Directory")
        .when(mode.startswith("l"), "Symlink")
        .otherwise("File")
    )
    what = (
        F.when(macb == "...b", " created")
        .when(macb.startswith("m") & macb.contains("b"), " created and written")
        .when(macb.startswith("m"), " modified")
        .when(macb.contains("c"), " metadata changed")
        .when(macb == ".a..", " accessed")
        .otherwise(" timestamp")
    )
    return F.concat(kind, what)


def scored_entries(lines: DataFrame) -> DataFrame:
    return read_bodyfile(lines).withColumn(
        "verdict", score_file_entry(F.col("name"), F.col("mode"), F.col("uid"))
    )


def bodyfile_summary(entries: DataFrame) -> DataFrame:
    """Per file: entries, events, notable entries, first and last time."""
    times = F.array_distinct(F.array_compact(F.array("m", "a", "c", "b")))
    return (
        entries.withColumn("__t", times)
        .groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.sum(F.size("__t")).alias("events"),
            F.count_if((F.size("__t") > 0) & (F.col("verdict.severity") != "info")).alias(
                "notable"
            ),
            F.min(F.array_min("__t")).alias("earliest"),
            F.max(F.array_max("__t")).alias("latest"),
            F.max("line_no").alias("line_no"),
        )
    )


def bodyfile_events(lines: DataFrame, *, host: str = "") -> DataFrame:
    """One event per distinct timestamp of every entry, and one summary per file."""
    with_id = lines if "artifact_id" in lines.columns else lines.withColumn(
        "artifact_id", F.lit(0).cast("long")
    )
    entries = scored_entries(with_id)
    rows = macb_rows(entries)
    order = F.array_position(
        F.array_sort(F.array_distinct(F.array_compact(F.array("m", "a", "c", "b")))),
        F.col("event_time"),
    ).cast("long")
    md5 = blank_to_null(F.col("md5"))
    why = blank_to_null(F.col("verdict.why"))
    common = [
        F.lit(PARSER).alias("source_artifact"),
        F.col("path").alias("artifact_path"),
        F.lit(PARSER).alias("parser"),
    ]
    details = F.concat(
        F.lit("MACB: "), "macb", F.lit(f"{SEP}Path: "), "name", F.lit(f"{SEP}Mode: "), "mode",
        F.lit(f"{SEP}UID: "), "uid", F.lit(f"{SEP}Size: "), "size",
        F.coalesce(F.concat(F.lit(f"{SEP}MD5: "), md5), F.lit("")),
    )
    events = rows.select(
        line_id(F.col("path"), F.col("line_no"), order - 1).alias("id"),
        "artifact_id",
        "event_time",
        macb_meaning(F.col("macb")).alias("ts_desc"),
        F.lit("file_timestamp").alias("event_type"),
        macb_title(F.col("macb"), F.col("mode")).alias("title"),
        details.alias("details"),
        payload(
            path=F.col("name"), macb=F.col("macb"), mode=F.col("mode"), uid=F.col("uid"),
            gid=F.col("gid"), size=F.col("size"), inode=F.col("inode"), md5=md5, why=why,
        ).alias("data"),
        F.col("verdict.severity").alias("severity"),
        F.col("verdict.tags").alias("tags"),
        *common,
    )
    artifact_ids = with_id.groupBy("path").agg(F.max("artifact_id").alias("artifact_id"))
    totals = bodyfile_summary(entries).join(artifact_ids, "path")
    counted = [F.format_number(c, 0) for c in ("entries", "events", "notable")]
    span = F.coalesce(
        F.concat(
            F.lit(f"{SEP}Span: "), F.to_date("earliest").cast("string"), F.lit(" to "),
            F.to_date("latest").cast("string"),
        ),
        F.lit(""),
    )
    summary = totals.select(
        line_id(F.col("path"), F.col("line_no"), "summary").alias("id"),
        "artifact_id",
        F.col("latest").alias("event_time"),
        F.lit("Bodyfile summary").alias("ts_desc"),
        F.lit("filesystem_timeline").alias("event_type"),
        F.lit("Filesystem timeline ingested").alias("title"),
        F.concat(
            F.lit("Entries: "), counted[0], F.lit(f"{SEP}Events: "), counted[1],
            F.lit(f"{SEP}Notable: "), counted[2], span,
        ).alias("details"),
        payload(
            entries=F.col("entries"), events=F.col("events"), notable=F.col("notable")
        ).alias("data"),
        F.lit("info").alias("severity"),
        strings([]).alias("tags"),
        *common,
    )
    return union_events(normalize(events, host=host), normalize(summary, host=host))


def malformed(lines: DataFrame) -> DataFrame:
    """Non-blank lines per file that are not entries (diagnostics)."""
    value = F.col("value")
    return (
        lines.filter(value.rlike(r"\S") & bodyfile_fields(value).isNull())
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select("path", F.lit("not a bodyfile record").alias("cause"), "lines")
    )
