"""Text nobody else claims: timestamped lines, and files without any timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.paths import source_label
from spoorline.functions.text import blank_to_null, cut, file_name, let, payload, strings
from spoorline.functions.times import any_clock
from spoorline.operators.normalize import line_id, normalize, union_events
from spoorline.operators.running import RunningSum, line_chunks, running
from spoorline.operators.skew import salted_join
from spoorline.operators.textkind import describe_text, kind_of, line_flags
from spoorline.schema import FILE_TIME

PARSER = "generic_text"
BLOCK_CHARS, SHOWN_CHARS = 16 * 1024, 500


def file_kinds(lines: DataFrame) -> DataFrame:
    """(path, kind): every file classified from all of its lines, by aggregation."""
    flags = line_flags(F.col("value"))
    rows = lines.select("path", "line_no", *[v.alias(k) for k, v in flags.items()])
    counted = running(
        rows, ["path"], ["line_no"], line_chunks(), __seen=RunningSum(F.col("filled"))
    )
    totals = counted.groupBy("path").agg(
        *[F.sum(k).alias(k) for k in flags if k != "not_path"],
        F.sum(F.when(F.col("__seen") < 20, F.col("not_path")).otherwise(0)).alias("not_path"),
    )
    facts = {k: F.col(k) for k in flags}
    return totals.select("path", kind_of(file_name(F.col("path")), facts).alias("kind"))


def untimed_blocks(untimed: DataFrame) -> DataFrame:
    """All untimed lines of a file, whole, in blocks of about 16 KB.

    ``untimed``: (path, line_no, value, mtime). The running length decides a line's
    block before anything is gathered, so one group gathers no more than a block and
    the line that ends it.
    """
    sized = running(
        untimed, ["path"], ["line_no"], line_chunks(),
        __before=RunningSum(F.length("value")),
    ).withColumn("block", F.floor(F.col("__before") / BLOCK_CHARS))
    gathered = sized.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("lines"),
        F.array_sort(F.collect_list(F.struct("line_no", F.col("value").alias("v")))).alias("__lines"),
        F.max("mtime").alias("mtime"),
        F.min("line_no").alias("line_no"),
    )
    body = F.array_join(F.transform("__lines", lambda r: r["v"]), "\n")
    return gathered.select("path", "block", "line_no", "mtime", "lines", body.alias("raw"))


def generic_text_events(
    lines: DataFrame, *, host: str = "", zone: Column | str = "UTC"
) -> DataFrame:
    """Each timestamped line an event; all other lines in rows of about 16 KB, dated by the file."""
    with_id = lines if "artifact_id" in lines.columns else lines.withColumn(
        "artifact_id", F.lit(0).cast("long")
    )
    filled = with_id.filter(F.col("value").rlike(r"\S")).withColumn(
        "event_time", any_clock(F.col("value"), zone)
    )
    kinds = file_kinds(lines)
    common = lambda path: [
        source_label(path).alias("source_artifact"),
        path.alias("artifact_path"),
        F.lit(PARSER).alias("parser"),
    ]
    worth = F.when(F.col("why") != "", strings(["worth_reading"])).otherwise(strings([]))

    timed = salted_join(
        filled.filter(F.col("event_time").isNotNull()), kinds, ["path"], ["line_no"]
    ).withColumn("why", F.col("kind.why"))
    line_rows = timed.select(
        line_id(F.col("path"), F.col("line_no")).alias("id"),
        "artifact_id",
        "event_time",
        F.lit("Log line time").alias("ts_desc"),
        F.lit("log_line").alias("event_type"),
        F.col("kind.label").alias("title"),
        cut(F.col("value"), SHOWN_CHARS).alias("details"),
        payload(why=blank_to_null(F.col("why"))).alias("data"),
        worth.alias("tags"),
        F.col("value").alias("raw"),
        *common(F.col("path")),
    )

    files = filled.groupBy("path").agg(
        F.count("event_time").alias("timed"), F.max("artifact_id").alias("artifact_id")
    )
    facts = files.join(kinds, "path")
    blocks = salted_join(
        untimed_blocks(filled.filter(F.col("event_time").isNull())), facts, ["path"], ["line_no"]
    )
    told = describe_text(file_name(F.col("path")), F.col("kind"), F.col("lines"))
    rows = blocks.withColumn("told", told).withColumn("why", F.col("told.why"))
    file_rows = rows.select(
        line_id(F.col("path"), F.col("line_no")).alias("id"),
        "artifact_id",
        F.col("mtime").alias("event_time"),
        F.when(F.col("timed") == 0, "Artifact mtime (no timestamps in content)")
        .otherwise("Artifact mtime (lines without a timestamp)")
        .alias("ts_desc"),
        F.lit(FILE_TIME).alias("time_kind"),
        F.lit("text_artifact").alias("event_type"),
        F.col("told.title").alias("title"),
        F.col("told.details").alias("details"),
        F.col("told.severity").alias("severity"),
        payload(lines=F.col("lines"), block=F.col("block"), why=blank_to_null(F.col("why"))).alias("data"),
        worth.alias("tags"),
        "raw",
        *common(F.col("path")),
    )
    return union_events(normalize(line_rows, host=host), normalize(file_rows, host=host))


# Numbered questions, bare questions, and names of task files.
NUMBERED = r"(?imd)^\s*(?:\d+|Q\d+|Task\s*\d+)[\).:\-]?\s*(.+\?)\s*$"
BARE = r"(?md)^\s*(.{12,300}\?)\s*$"
TASK_NAME = r"(read ?me|task|question|brief|scenario|instruction|challenge|note)s?\b"
TASK_SUFFIXES = ("", ".txt", ".md", ".rst", ".pdf", ".html")
TASK_BYTES = 256 * 1024


def extract_questions(text: Column) -> Column:
    """Questions of a task text in order: numbered ones, else any line ending in ``?``."""
    numbered = F.regexp_extract_all(text, F.lit(NUMBERED), 1)
    bare = F.regexp_extract_all(text, F.lit(BARE), 1)
    listed = let(numbered, lambda some: F.when(F.size(some) > 0, some).otherwise(bare))
    return let(F.transform(listed, lambda q: F.regexp_replace(q, r"^\s+|\s+$", "")), first_of_each)


def first_of_each(found: Column) -> Column:
    """The texts in order, each at its first place, whatever its case: one hashed pass.

    Read backwards, a map keeps the first place of each by the session's map setting.
    """
    lowered, numbers = F.transform(found, lambda q: F.lower(q)), F.transform(found, lambda q, i: i)
    places = F.map_from_arrays(F.reverse(lowered), F.reverse(numbers))
    return F.transform(F.array_sort(F.map_values(places)), lambda i: F.get(found, i))


def is_task_file(path: Column, size: Column) -> Column:
    """A small text file whose name promises the questions of an investigation."""
    name = file_name(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
    return (
        (size <= TASK_BYTES) & suffix.isin(*TASK_SUFFIXES) & stem.rlike("(?i)" + TASK_NAME)
    )


def questions_table(texts: DataFrame) -> DataFrame:
    """(path, position, question) of a (path, text) table of task files."""
    return texts.select(
        "path", F.posexplode(extract_questions(F.col("text"))).alias("position", "question")
    )
