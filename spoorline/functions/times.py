"""Timestamps out of text, and zone arithmetic."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline.functions.text import let, rx, strings

# Month names of the classic log clock.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# An ISO time as it appears inside a line.
ISO_TIME = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?)"
CLF_TIME = r"(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}(?:\s+[+-]\d{4})?)"
SLASH_TIME = r"(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})"

# Epochs outside 1980..2100 are placeholders, not evidence.
EPOCH_MIN, EPOCH_MAX = 315_532_800, 4_102_444_800

# Zone names as the registry spells them, and their standard-time
# offset from UTC in minutes.
WINDOWS_ZONES = {
    "utc": 0,
    "gmt standard time": 0,
    "greenwich standard time": 0,
    "w. europe standard time": 60,
    "central europe standard time": 60,
    "central european standard time": 60,
    "romance standard time": 60,
    "e. europe standard time": 120,
    "gtb standard time": 120,
    "israel standard time": 120,
    "south africa standard time": 120,
    "russian standard time": 180,
    "arab standard time": 180,
    "arabic standard time": 180,
    "iran standard time": 210,
    "arabian standard time": 240,
    "india standard time": 330,
    "central asia standard time": 360,
    "se asia standard time": 420,
    "china standard time": 480,
    "singapore standard time": 480,
    "w. australia standard time": 480,
    "tokyo standard time": 540,
    "korea standard time": 540,
    "aus eastern standard time": 600,
    "new zealand standard time": 720,
    "hawaiian standard time": -600,
    "alaskan standard time": -540,
    "pacific standard time": -480,
    "us mountain standard time": -420,
    "mountain standard time": -420,
    "central standard time": -360,
    "canada central standard time": -360,
    "eastern standard time": -300,
    "us eastern standard time": -300,
    "atlantic standard time": -240,
    "sa western standard time": -240,
    "e. south america standard time": -180,
    "argentina standard time": -180,
}


def check_zone(name: str | None) -> str:
    """A zone spelling Spark accepts, or ValueError: UTC is never assumed quietly."""
    text = (name or "").strip()
    if not text or text.upper() in ("UTC", "Z", "GMT"):
        return "UTC"
    offset = re.fullmatch(r"([+-])(\d{2}):?(\d{2})", text)
    if offset:
        sign, hours, minutes = offset.groups()
        if int(hours) * 60 + int(minutes) > 18 * 60 or int(minutes) > 59:
            raise ValueError(f"offset out of range: {name!r}")
        return f"{sign}{hours}:{minutes}"
    try:
        ZoneInfo(text)
    except (ZoneInfoNotFoundError, ValueError, OSError) as error:
        raise ValueError(f"unknown timezone {name!r}") from error
    return text


def _zone_object(name: str) -> tzinfo:
    if name == "UTC":
        return timezone.utc
    if name[0] in "+-":
        sign = 1 if name[0] == "+" else -1
        return timezone(sign * timedelta(hours=int(name[1:3]), minutes=int(name[4:6])))
    return ZoneInfo(name)


def parse_time(text: str, zone: str = "UTC") -> datetime:
    """A filter bound typed by a person, as an aware UTC time; junk is an error."""
    raw = (text or "").strip().replace("Z", "")
    found: datetime | None = None
    for shape in (
        "%Y-%m-%d %H:%M:%S",
        "%Y-%m-%dT%H:%M:%S",
        "%Y-%m-%d %H:%M",
        "%Y-%m-%d",
        "%Y/%m/%d %H:%M:%S",
        "%Y/%m/%d",
    ):
        try:
            found = datetime.strptime(raw, shape)
            break
        except ValueError:
            pass
    if found is None:
        try:
            found = datetime.fromisoformat(raw)
        except ValueError:
            raise ValueError(
                f"unrecognized time {text!r}: use YYYY-MM-DD or YYYY-MM-DD HH:MM:SS"
            ) from None
    if found.tzinfo is None:
        found = found.replace(tzinfo=_zone_object(check_zone(zone)))
    return found.astimezone(timezone.utc)


def to_utc(naive: Column, zone: Column | str) -> Column:
    """A wall-clock time read in ``zone`` (session zone is UTC)."""
    zone = F.lit(check_zone(zone)) if isinstance(zone, str) else zone
    return F.to_utc_timestamp(naive.cast("timestamp"), zone)


def iso_time(text: Column, zone: Column | str) -> Column:
    """An ISO text as UTC; without an offset it is read in ``zone``.

    The session zone is UTC, so a text with an offset parses to UTC as it is,
    and ``to_utc`` of a UTC zone changes nothing.
    """
    def read(t: Column) -> Column:
        tidy = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")
        return F.when(is_offset_iso(t), tidy).otherwise(to_utc(tidy, zone))

    return let(text, read)


def is_offset_iso(text: Column) -> Column:
    return text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")


def month_number(name: Column) -> Column:
    """1..12, or 0 for something that is not a month name."""
    return F.array_position(strings(MONTHS), name).cast("int")


def syslog_clock(line: Column, mtime: Column, zone: Column | str, year_hint: Column) -> Column:
    """struct(time, explicit) of a log line: ISO first, else ``Mon d HH:MM:SS``.

    A classic line has no year: the hint, else the year the file was last
    written, one less when the line's month is later than the file's.
    """
    classic = F.regexp_extract(line, r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", 0)

    def wall(text: Column) -> Column:
        month = month_number(F.left(text, F.lit(3)))
        year = F.coalesce(
            year_hint, F.year(mtime) - F.when(month > F.month(mtime), 1).otherwise(0)
        )
        dated = F.concat(year.cast("string"), F.lit(" "), F.regexp_replace(text, r"\s+", " "))
        return to_utc(F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss")), zone)

    def both(iso: Column) -> Column:
        return F.struct(
            F.when(iso != "", iso_time(iso, zone)).alias("iso"),
            is_offset_iso(iso).alias("explicit"),
        )

    def answer(read: Column) -> Column:
        return F.struct(
            F.coalesce(read["iso"], let(classic, wall)).alias("time"),
            (read["iso"].isNotNull() & read["explicit"]).alias("explicit"),
        )

    return let(let(F.regexp_extract(line, "^" + ISO_TIME, 1), both), answer)


def any_clock(line: Column, zone: Column | str) -> Column:
    """First readable time anywhere in a line: ISO, then web log, then slashes."""
    def clf_time(text: Column) -> Column:
        return F.when(
            text.rlike(r"[+-]\d{4}$"),
            F.try_to_timestamp(
                F.regexp_replace(text, r"\s+", " "), F.lit("dd/MMM/yyyy:HH:mm:ss xx")
            ),
        ).otherwise(to_utc(F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss")), zone))

    def slash_time(text: Column) -> Column:
        plain = F.regexp_replace(text, r"\s+", " ")
        return to_utc(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm:ss")), zone)

    return F.coalesce(
        iso_time(F.regexp_extract(line, ISO_TIME, 1), zone),
        let(F.regexp_extract(line, CLF_TIME, 1), clf_time),
        let(F.regexp_extract(line, SLASH_TIME, 1), slash_time),
    )


def epoch_time(seconds: Column) -> Column:
    """Whole epoch seconds as a timestamp, null outside the believable range."""
    return let(
        F.floor(seconds.try_cast("double")).cast("long"),
        lambda s: F.when(s.between(EPOCH_MIN, EPOCH_MAX), F.timestamp_seconds(s)),
    )


def seconds_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def offset_minutes(text: Column) -> Column:
    """``UTC-05:00`` -> -300; null when it is not such a text."""
    pattern = rx(r"^UTC([+-])(\d{2}):(\d{2})", ignore_case=False)
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(text, pattern, 2).try_cast("int")
    minutes = F.regexp_extract(text, pattern, 3).try_cast("int")
    return sign * (hours * 60 + minutes)


def offset_label(minutes: Column) -> Column:
    """-300 -> ``-05:00``, a spelling Spark accepts as a zone."""
    size = F.abs(minutes)
    return F.concat(
        F.when(minutes < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def bias_offset(bias: Column) -> Column:
    """A registry bias (minutes to add to reach UTC) as ``UTC±hh:mm``."""
    return F.when(bias.isNotNull(), F.concat(F.lit("UTC"), offset_label(-bias)))
