"""Structured (one JSON object per line) document-database server logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.levels import level_name, level_rank, rank_lit
from spoorline.functions.text import (
    SEP,
    blank_to_null,
    contains_any,
    cut,
    let,
    or_blank,
    payload,
    put,
    strings,
    strip_ws,
)
from spoorline.functions.times import iso_time
from spoorline.operators.correlate import connection_flood
from spoorline.operators.normalize import line_id, normalize, union_events
from spoorline.operators.running import LastKnown, line_chunks, running

PARSER = "mongodb"
SHOWN_CHARS = 700

# Level of a record's severity letter; anything else is info.
LETTER_LEVEL = {"F": "high", "E": "high", "W": "low"}
STARTUP_ADVICE = (
    "we suggest setting", "for customers running the current memory allocator",
    "use of deprecated server parameter", "deprecated", "vm.max_map_count",
    "soft rlimits", "transparent hugepage",
)
# Message, title, event type, lowest level.
MESSAGES = (
    ("Connection accepted", "Connection accepted", "db_connection", "info"),
    ("Connection ended", "Connection ended", "db_connection", "info"),
    ("MongoDB starting", "MongoDB server starting", "service_start", "low"),
    ("Listening on", "Listening on", "db_listen", "low"),
    ("Build Info", "Build info", "software_version", "info"),
    ("Operating System", "Host operating system", "system_info", "info"),
    ("Access control is not enabled for the database",
     "ACCESS CONTROL DISABLED — no authentication required", "db_no_auth", "high"),
    ("Authentication failed", "Authentication failed", "db_auth_failed", "med"),
    ("Authentication succeeded", "Authentication succeeded", "db_auth_success", "low"),
    ("Successfully authenticated as principal", "Authenticated", "db_auth_success", "low"),
    ("Failed to authenticate", "Authentication failed", "db_auth_failed", "med"),
    ("createUser", "Database user created", "db_user_created", "high"),
    ("dropDatabase", "Database dropped", "db_dropped", "high"),
    ("dropCollection", "Collection dropped", "db_dropped", "high"),
    ("Index build: done building", "Index build finished", "db_index", "info"),
    ("Shutting down", "MongoDB shutting down", "service_stop", "low"),
    ("Received signal", "Signal received", "service_signal", "low"),
)
FLOOD_MINIMUM, FLOOD_SECONDS = 200, 600


def read_mongod(lines: DataFrame) -> DataFrame:
    """Parsed records: event_time, letter, component, mongo_id, ctx, msg, attr.

    Lines that are no such record keep a null ``event_time``; see ``malformed``.
    """
    line = strip_ws(F.col("value"))
    record = F.when(line.startswith("{"), F.from_json(line, "map<string,string>"))

    def fields(attr: Column) -> Column:
        found = (
            F.when(attr.startswith("{"), F.from_json(attr, "map<string,string>"))
            .when(or_blank(attr) != "", F.create_map(F.lit("attr"), attr))
            .otherwise(F.create_map().cast("map<string,string>"))
        )
        return F.map_filter(found, lambda k, v: v.isNotNull())

    def parsed(r: Column) -> Column:
        when = F.when(
            r["t"].startswith("{"), F.from_json(r["t"], "map<string,string>")["$date"]
        ).otherwise(r["t"])
        return F.struct(
            iso_time(strip_ws(when), "UTC").alias("event_time"),
            F.trim(F.coalesce(blank_to_null(r["s"]), F.lit("I"))).alias("letter"),
            F.trim(or_blank(r["c"])).alias("component"),
            r["id"].alias("mongo_id"),
            r["ctx"].alias("ctx"),
            or_blank(r["msg"]).alias("msg"),
            fields(r["attr"]).alias("attr"),
        )

    rows = lines.select("*", F.explode(F.array(let(record, parsed))).alias("__r"))
    return rows.select(*lines.columns, "__r.*")


def read_records(lines: DataFrame) -> DataFrame:
    """Lines with ``record``, the whole record as a variant; null where a line is none.

    Each line is parsed once; any attribute, however deep, is then read by its path with its
    own type: see :func:`attribute`.
    """
    return lines.select("*", F.try_parse_json(strip_ws(F.col("value"))).alias("record"))


def attribute(path: str, kind: str) -> Column:
    """A value of a record by its path below ``attr`` (``uuid.a``); null if absent or of no such type."""
    return F.try_variant_get(F.col("record"), f"$.attr.{path}", kind)


def message_meaning(msg: Column) -> Column:
    """struct(title, event_type, floor): exact message, else a contained one."""

    def row(title: str, event_type: str, floor: str) -> Column:
        return F.struct(
            F.lit(title).alias("title"),
            F.lit(event_type).alias("event_type"),
            F.lit(floor).alias("floor"),
        )

    lowered = F.lower(msg)
    result: Column | None = None
    for text, *meaning in MESSAGES:
        test = msg == text
        result = F.when(test, row(*meaning)) if result is None else result.when(test, row(*meaning))
    for text, *meaning in MESSAGES:
        result = result.when(lowered.contains(text.lower()), row(*meaning))
    return result.otherwise(
        F.struct(
            F.coalesce(blank_to_null(cut(msg, 120)), F.lit("MongoDB event")).alias("title"),
            F.lit("db_event").alias("event_type"),
            F.lit("info").alias("floor"),
        )
    )


def record_level(letter: Column, floor: Column) -> Column:
    """The letter's level, raised to the floor of the message."""
    rank = F.lit(0)
    for known, level in LETTER_LEVEL.items():
        rank = F.when(letter == known, rank_lit(level)).otherwise(rank)
    return level_name(F.greatest(rank, level_rank(floor)))


def source_address(remote: Column) -> Column:
    """``address:port`` without the port."""
    return F.regexp_replace(remote, r":[^:]*$", "")


def mongod_host(records: DataFrame) -> DataFrame:
    """Adds ``file_host``: the host of the last server start above the line."""
    started = F.when(
        F.col("msg") == "MongoDB starting", blank_to_null(F.col("attr")["host"])
    )
    return running(
        records, ["path"], ["line_no"], line_chunks(), file_host=LastKnown(started)
    )


def mongod_connections(records: DataFrame) -> DataFrame:
    """Accepted connections with their source address."""
    remote = or_blank(F.col("attr")["remote"])
    return records.filter((F.col("msg") == "Connection accepted") & (remote != "")).withColumn(
        "source_ip", source_address(remote)
    )


def mongod_floods(
    records: DataFrame, minimum: int = FLOOD_MINIMUM, window_seconds: int = FLOOD_SECONDS
) -> DataFrame:
    """Per file and address: many accepted connections within a short span."""
    return connection_flood(
        mongod_connections(records),
        keys=["path", "source_ip"],
        at="event_time",
        minimum=minimum,
        window_seconds=window_seconds,
    )


def _iso(at: Column) -> Column:
    base = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    fraction = F.when(micros == 0, "").otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(base, fraction, F.lit("+00:00"))


def mongod_events(lines: DataFrame, *, host: str = "") -> DataFrame:
    """Every record as an event, plus one finding per flooding address."""
    records = read_mongod(lines).filter(F.col("event_time").isNotNull())
    artifact = F.col("artifact_id") if "artifact_id" in lines.columns else F.lit(0)
    meaning = message_meaning(F.col("msg"))
    advice = contains_any(F.lower("msg"), STARTUP_ADVICE)
    component = F.col("component")
    shown = F.transform(
        F.slice(F.map_entries("attr"), 1, 10),
        lambda e: F.concat(e["key"], F.lit(": "), cut(e["value"], SHOWN_CHARS)),
    )
    remote = blank_to_null(F.col("attr")["remote"])
    base = payload(
        component=component, mongo_id=F.col("mongo_id"), ctx=F.col("ctx"), msg=F.col("msg")
    )
    rows = mongod_host(records).withColumn("meaning", meaning)
    fixed = dict(
        source_artifact=F.lit(PARSER),
        artifact_path=F.col("path"),
        parser=F.lit(PARSER),
        ts_desc=F.lit("Logged"),
    )
    common = [value.alias(name) for name, value in fixed.items()]
    events = rows.select(
        line_id(F.col("path"), F.col("line_no")).alias("id"),
        artifact.cast("long").alias("artifact_id"),
        "event_time",
        F.when(advice, "db_tuning_advice").otherwise(F.col("meaning.event_type")).alias(
            "event_type"
        ),
        F.when(component == "", F.col("meaning.title"))
        .otherwise(F.concat(F.col("meaning.title"), F.lit(" ["), component, F.lit("]")))
        .alias("title"),
        F.when(F.size(shown) > 0, F.array_join(shown, SEP))
        .otherwise(
            F.concat(F.lit("component: "), F.coalesce(blank_to_null(component), F.lit("-")))
        )
        .alias("details"),
        put(put(base, F.col("attr")), payload(source_ip=source_address(remote))).alias("data"),
        or_blank(F.col("file_host")).alias("host"),
        F.when(advice, "info")
        .otherwise(record_level(F.col("letter"), F.col("meaning.floor")))
        .alias("severity"),
        F.when(component == "", "mongodb")
        .otherwise(F.concat(F.lit("mongodb/"), component))
        .alias("channel"),
        *common,
    )

    last_host = (
        records.filter(
            (F.col("msg") == "MongoDB starting") & (or_blank(F.col("attr")["host"]) != "")
        )
        .groupBy("path")
        .agg(F.max_by(F.col("attr")["host"], "line_no").alias("file_host"))
    )
    connected = mongod_connections(records).withColumn("artifact_id", artifact.cast("long"))
    ends = connected.groupBy("path", "source_ip").agg(
        F.max("line_no").alias("line_no"), F.max("artifact_id").alias("artifact_id")
    )
    floods = (
        mongod_floods(records).join(ends, ["path", "source_ip"]).join(last_host, "path", "left")
    )
    count = F.format_number("connections", 0)
    seconds = F.format_string("%.0f", F.col("span_seconds"))
    flood_events = floods.select(
        line_id(F.col("path"), F.col("line_no"), 1).alias("id"),
        "artifact_id",
        F.col("first_time").alias("event_time"),
        F.lit("db_connection_flood").alias("event_type"),
        F.lit("Connection flood from a single address").alias("title"),
        F.concat(
            F.lit("SrcIP: "), "source_ip", F.lit(f"{SEP}Connections: "), count,
            F.lit(f"{SEP}Window: "), seconds, F.lit(f"s{SEP}Rate: "),
            F.format_string("%.0f", F.col("connections") / F.col("span_seconds")),
            F.lit(f"/s{SEP}First: "), _iso(F.col("first_time")),
            F.lit(f"{SEP}Last: "), _iso(F.col("last_time")),
        ).alias("details"),
        payload(
            source_ip=F.col("source_ip"),
            connections=F.col("connections"),
            window_seconds=F.col("window_seconds"),
            rate_per_second=F.col("rate_per_second"),
            why=F.concat(count, F.lit(" connections by one address within "), seconds, F.lit("s")),
        ).alias("data"),
        or_blank(F.col("file_host")).alias("host"),
        F.lit("high").alias("severity"),
        strings(["T1046"]).alias("attck"),
        strings(["connection_flood", "suspicious"]).alias("tags"),
        F.lit("mongodb/NETWORK").alias("channel"),
        *common,
    )
    return union_events(normalize(events, host=host), normalize(flood_events, host=host))


def malformed(lines: DataFrame) -> DataFrame:
    """Non-blank lines per file that are not records (diagnostics)."""
    return (
        read_mongod(lines)
        .filter((strip_ws(F.col("value")) != "") & F.col("event_time").isNull())
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select("path", F.lit("not a JSON record").alias("cause"), "lines")
    )


def unauthenticated(lines: DataFrame) -> DataFrame:
    """Files whose server said that access control is off (diagnostics)."""
    records = read_mongod(lines).filter(F.col("event_time").isNotNull())
    return (
        records.filter(F.col("msg").contains("Access control is not enabled"))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("lines"))
        .select("path", F.lit("access control is disabled").alias("cause"), "lines")
    )
