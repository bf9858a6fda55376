"""Linux authentication and system logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.levels import level_name
from spoorline.functions.text import cut, group, if_any, or_blank, payload, strings, strip_ws
from spoorline.functions.times import check_zone, syslog_clock
from spoorline.operators.correlate import success_after_failure
from spoorline.operators.normalize import line_id, normalize
from spoorline.operators.running import line_chunks
from spoorline.operators.scoring import sudo_risk
from spoorline.operators.skew import salted_join

PARSER = "linux_syslog"

# Line shapes.
FAILED = r"Failed password for (?:invalid user )?([^\s]+) from ([0-9a-fA-F:.]+)"
ACCEPTED = r"Accepted (\w+) for ([^\s]+) from ([0-9a-fA-F:.]+)"
INVALID = r"Invalid user ([^\s]+) from ([0-9a-fA-F:.]+)"
NEW_USER = r"new user: name=([^,]+)"
NEW_GROUP = r"new group: name=([^,]+)"
SUDO = r"sudo:\s+([^\s]+).*?(?:COMMAND=|COMMAND\s*=\s*)(.+)$"
SUDO_FAILED = r"sudo:.*authentication failure.*?user=([^\s]+)"
SESSION_OPEN = r"session opened for user ([^\s(]+)"
HOST = r"^(?:\S+\s+){3}([A-Za-z0-9._-]+)\s"


def _shape(
    kind: str,
    user: Column | None = None,
    source: Column | None = None,
    method: Column | None = None,
    detail: Column | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        (none if user is None else user).alias("user"),
        (none if source is None else source).alias("source"),
        (none if method is None else method).alias("method"),
        (none if detail is None else detail).alias("detail"),
    )


def line_shape(line: Column) -> Column:
    """struct(kind, user, source, method, detail) of the first shape that fits."""

    def part(pattern: str, n: int) -> Column:
        return group(line, pattern, n)

    def fits(pattern: str) -> Column:
        return line.rlike("(?d)" + pattern)

    return (
        F.when(fits(FAILED), _shape("failed", part(FAILED, 1), part(FAILED, 2)))
        .when(
            fits(ACCEPTED),
            _shape("accepted", part(ACCEPTED, 2), part(ACCEPTED, 3), part(ACCEPTED, 1)),
        )
        .when(fits(INVALID), _shape("invalid", part(INVALID, 1), part(INVALID, 2)))
        .when(fits(NEW_USER), _shape("new_user", strip_ws(part(NEW_USER, 1))))
        .when(fits(NEW_GROUP), _shape("new_group", detail=strip_ws(part(NEW_GROUP, 1))))
        .when(fits(SUDO), _shape("sudo", part(SUDO, 1), detail=strip_ws(part(SUDO, 2))))
        .when(fits(SUDO_FAILED), _shape("sudo_failed", part(SUDO_FAILED, 1)))
        .when(fits(SESSION_OPEN), _shape("session", part(SESSION_OPEN, 1)))
    )


def timed_lines(lines: DataFrame, zone: str = "UTC", year: int | None = None) -> DataFrame:
    """Lines with a readable clock: adds ``event_time`` and ``explicit``."""
    clock = syslog_clock(
        F.col("value"), F.col("mtime"), check_zone(zone), F.lit(year).cast("int")
    )
    dated = F.explode(F.filter(F.array(clock), lambda c: c["time"].isNotNull()))
    rows = lines.select("*", dated.alias("__clock"))
    return rows.select(
        *lines.columns,
        F.col("__clock.time").alias("event_time"),
        F.col("__clock.explicit").alias("explicit"),
    )


def file_host(timed: DataFrame) -> DataFrame:
    """Adds ``file_host``: the first host seen in the file, from that line on.

    The first sighting per file is one small aggregate, so no row order is kept.
    """
    seen = group(F.col("value"), HOST)
    first = timed.groupBy("path").agg(
        F.min(F.when(seen.isNotNull(), F.struct("line_no", seen.alias("host")))).alias("__first")
    )
    known = salted_join(timed, first, ["path"], ["line_no"])
    here = F.when(F.col("line_no") >= F.col("__first.line_no"), F.col("__first.host"))
    return known.withColumn("file_host", here).drop("__first")


def syslog_logins(lines: DataFrame, zone: str = "UTC", year: int | None = None) -> DataFrame:
    """Parsed lines with the running failure counts of their source address."""
    hosted = file_host(timed_lines(lines, zone, year))
    shaped = (
        hosted.select("*", if_any(line_shape(F.col("value"))).alias("shape"))
        .withColumn("source", or_blank(F.col("shape.source")))
        .withColumn("account", or_blank(F.col("shape.user")))
    )
    return success_after_failure(
        shaped,
        scope=["path"],
        source="source",
        account="account",
        order="line_no",
        failed=F.col("shape.kind") == "failed",
        accepted=F.col("shape.kind") == "accepted",
        exempt=F.lower(or_blank(F.col("shape.method"))) == "publickey",
        chunk=line_chunks(),
    )


def syslog_events(
    lines: DataFrame,
    *,
    host: str = "",
    zone: str = "UTC",
    year: int | None = None,
) -> DataFrame:
    """Log lines as events; lines of no known shape give none.

    ``lines``: (path, line_no, value, mtime[, artifact_id]).
    """
    zone = check_zone(zone)
    rows = syslog_logins(lines, zone, year)
    kind, user = F.col("shape.kind"), or_blank(F.col("shape.user"))
    source, detail = F.col("shape.source"), F.col("shape.detail")
    method = F.col("shape.method")
    cracked = F.col("cracked")
    rows = rows.withColumn("risk", F.when(kind == "sudo", sudo_risk(detail)))
    risk = F.col("risk")

    def per_kind(default=None, **values) -> Column:
        result: Column | None = None
        for name, value in values.items():
            result = (
                F.when(kind == name, value) if result is None else result.when(kind == name, value)
            )
        return result if default is None else result.otherwise(default)

    clock_name = per_kind(
        failed=F.lit("SSH auth attempt"),
        accepted=F.lit("SSH logon"),
        invalid=F.lit("SSH auth attempt"),
        new_user=F.lit("Account created"),
        new_group=F.lit("Group created"),
        sudo=F.lit("Privilege escalation"),
        sudo_failed=F.lit("sudo failure"),
        session=F.lit("Session opened"),
    )
    # Event type per line shape.
    event_type = per_kind(
        failed=F.lit("ssh_failed_login"),
        accepted=F.lit("ssh_login_success"),
        invalid=F.lit("ssh_invalid_user"),
        new_user=F.lit("account_created"),
        new_group=F.lit("group_created"),
        sudo=F.lit("sudo_command"),
        sudo_failed=F.lit("sudo_failed"),
        session=F.lit("session_open"),
    )
    attck = per_kind(
        failed=strings(["T1110.001"]),
        accepted=F.when(cracked, strings(["T1078", "T1110.001"])).otherwise(strings(["T1078"])),
        invalid=strings(["T1110.001", "T1087.001"]),
        new_user=strings(["T1136.001"]),
        new_group=strings(["T1136"]),
        sudo=F.concat(strings(["T1548.003"]), risk["attck"]),
        sudo_failed=strings(["T1548.003"]),
        session=strings(["T1078"]),
    )
    severity = (
        F.when((kind == "accepted") & cracked, F.lit("high"))
        .when(kind == "new_user", F.lit("high"))
        .when(kind == "sudo", level_name(risk["rank"]))
        .otherwise(F.lit("info"))
    )
    prior = F.col("prior_failures").cast("string")

    def words(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    message = per_kind(
        failed=words("Failed SSH password for ", user, " from ", source),
        accepted=F.when(
            cracked,
            words(
                "Brute-force SUCCESS: ", user, " from ", source, " via ", method, " after ",
                prior, " failures",
            ),
        ).otherwise(words("SSH login: ", user, " from ", source, " via ", method)),
        invalid=words("SSH attempt for nonexistent user ", user, " from ", source),
        new_user=words("Local account created: ", user),
        new_group=words("Local group created: ", detail),
        sudo=words("sudo: ", user, " ran ", cut(detail, 120)),
        sudo_failed=words("sudo authentication failure for ", user),
        session=words("Session opened for ", user),
    )
    data = payload(
        source_ip=F.when(kind.isin("failed", "accepted", "invalid"), source),
        attempt=F.when(kind == "failed", F.col("attempt")),
        method=F.when(kind == "accepted", method),
        prior_failures=F.when(kind == "accepted", F.col("prior_failures")),
        group=F.when(kind == "new_group", detail),
        cmd=F.when(kind == "sudo", detail),
    )
    assumed = F.when(F.col("explicit"), "").otherwise(f" (tz assumed {zone})")
    artifact = F.col("artifact_id") if "artifact_id" in lines.columns else F.lit(0)
    events = rows.select(
        line_id(F.col("path"), F.col("line_no")).alias("id"),
        artifact.cast("long").alias("artifact_id"),
        "event_time",
        F.concat(clock_name, assumed).alias("ts_desc"),
        F.coalesce(F.lit(host or None).cast("string"), F.col("file_host"), F.lit("")).alias("host"),
        F.when(kind == "new_group", "").otherwise(user).alias("user"),
        event_type.alias("event_type"),
        F.lit(PARSER).alias("source_artifact"),
        F.col("path").alias("artifact_path"),
        F.lit(PARSER).alias("parser"),
        severity.alias("severity"),
        message.alias("message"),
        data.alias("data"),
        F.when((kind == "accepted") & cracked, strings(["brute_force_success"]))
        .otherwise(strings([]))
        .alias("tags"),
        attck.alias("attck"),
        F.col("value").alias("raw"),
    )
    return normalize(events, host=host)


def year_assumed(lines: DataFrame, zone: str = "UTC", year: int | None = None) -> DataFrame:
    """Files whose lines carry no zone or year while no year was given (diagnostics)."""
    timed = timed_lines(lines, zone, year)
    return (
        timed.groupBy("path")
        .agg(F.count_if(~F.col("explicit")).alias("lines"))
        .filter((F.col("lines") > 0) & F.lit(year is None))
        .select("path", F.lit("year or zone assumed").alias("cause"), "lines")
    )
