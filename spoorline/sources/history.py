"""Shell and database-client command histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.functions.paths import history_owner
from spoorline.functions.text import (
    SEP,
    blank_to_null,
    cut,
    file_name,
    payload,
    strings,
    strip_ws,
)
from spoorline.functions.times import epoch_time
from spoorline.operators.normalize import line_id, normalize
from spoorline.operators.running import GroupTotal, Previous, RunningSum, line_chunks, running
from spoorline.operators.scoring import classify_command
from spoorline.schema import FILE_TIME, LOGGED

PARSER = "shell_history"
SHOWN_CHARS = 800

# An epoch on a line of its own, and the one-line extended form.
EPOCH_MARKER = r"^#(\d{9,11})\s*$"
EXTENDED = r"^:\s*(\d{9,11}):\d+;(.*)$"


def read_shell_history(lines: DataFrame) -> DataFrame:
    """One row per command with ``command`` and ``run_time`` (null when unknown).

    An epoch marker dates only the very next non-blank line.
    """
    value = F.col("value")
    filled = lines.filter(value.rlike(r"\S"))
    above = running(filled, ["path"], ["line_no"], line_chunks(), __above=Previous(value))
    extended = value.rlike(EXTENDED)
    marked = epoch_time(F.regexp_extract(F.coalesce("__above", F.lit("")), EPOCH_MARKER, 1))
    return (
        above.filter(~value.rlike(EPOCH_MARKER))
        .withColumn(
            "run_time",
            F.when(extended, epoch_time(F.regexp_extract(value, EXTENDED, 1))).otherwise(marked),
        )
        .withColumn(
            "command",
            strip_ws(F.when(extended, F.regexp_extract(value, EXTENDED, 2)).otherwise(value)),
        )
        .drop("__above", "value")
    )


def placed_commands(commands: DataFrame) -> DataFrame:
    """Adds ``event_time``: untimed commands one second apart, ending at the mtime."""
    untimed = F.when(F.col("run_time").isNull(), 1).otherwise(0)
    counted = running(
        commands,
        ["path"],
        ["line_no"],
        line_chunks(),
        __step=RunningSum(untimed, inclusive=True),
        __untimed=GroupTotal(untimed),
    )
    back = F.col("__untimed") - F.col("__step")
    placed = F.timestamp_micros(F.unix_micros("mtime") - back * 1_000_000)
    return counted.withColumn("event_time", F.coalesce("run_time", placed)).drop(
        "__step", "__untimed"
    )


def history_events(lines: DataFrame, *, host: str = "") -> DataFrame:
    rows = placed_commands(read_shell_history(lines))
    artifact = F.col("artifact_id") if "artifact_id" in lines.columns else F.lit(0)
    owner = history_owner(F.col("path"))
    shell = F.regexp_replace(
        F.regexp_replace(F.lower(file_name(F.col("path"))), r"^\.+", ""), "_history", ""
    )
    rows = (
        rows.withColumn("owner", owner)
        .withColumn("shell", shell)
        .withColumn("what", classify_command(F.col("command")))
    )
    number = F.col("line_no").cast("string")
    named = blank_to_null(F.col("owner"))
    events = rows.select(
        line_id(F.col("path"), F.col("line_no")).alias("id"),
        artifact.cast("long").alias("artifact_id"),
        "event_time",
        F.when(F.col("run_time").isNotNull(), "Command run")
        .otherwise(
            F.concat(
                F.lit("History order (line "), number, F.lit("; file mtime, not the run time)")
            )
        )
        .alias("ts_desc"),
        F.when(F.col("run_time").isNotNull(), LOGGED).otherwise(FILE_TIME).alias("time_kind"),
        F.lit("shell_command").alias("event_type"),
        F.when(F.col("what.label") != "Command", F.col("what.label"))
        .otherwise(F.concat(F.lit("Command typed by "), F.coalesce(named, F.lit("?"))))
        .alias("title"),
        F.concat(
            F.lit("Cmd: "), cut(F.col("command"), SHOWN_CHARS),
            F.coalesce(F.concat(F.lit(f"{SEP}User: "), named), F.lit("")),
            F.lit(f"{SEP}Line: "), number,
        ).alias("details"),
        payload(
            command=F.col("command"), line=F.col("line_no"), shell=F.col("shell"),
            history_file=F.col("path"), account=named, why=blank_to_null(F.col("what.why")),
        ).alias("data"),
        F.col("what.severity").alias("severity"),
        F.col("what.attck").alias("attck"),
        F.when(
            F.col("what.severity").isin("high", "crit"), strings(["shell_history", "suspicious"])
        )
        .otherwise(strings(["shell_history"]))
        .alias("tags"),
        F.col("command").alias("raw"),
        F.concat(F.lit("history/"), "shell").alias("source_artifact"),
        F.col("path").alias("artifact_path"),
        F.lit(PARSER).alias("parser"),
        F.col("owner").alias("user"),
    )
    return normalize(events, host=host)


def untimed(lines: DataFrame) -> DataFrame:
    """Commands per file whose time is not known (diagnostics)."""
    return (
        read_shell_history(lines)
        .filter(F.col("run_time").isNull())
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select("path", F.lit("command without a time").alias("cause"), "lines")
    )
