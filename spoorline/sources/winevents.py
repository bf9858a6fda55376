"""Windows event records that are already decoded to name/value pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.details import build_details
from spoorline.functions.levels import level_name, level_rank
from spoorline.functions.network import normalize_ip
from spoorline.functions.text import (
    blank_to_null,
    entry,
    file_name,
    if_any,
    or_blank,
    payload,
    put,
    snake,
    strings,
    summarize_reasons,
)
from spoorline.functions.times import iso_time
from spoorline.operators.normalize import line_id, normalize
from spoorline.operators.scoring import escalate_cmdline, score_event

PARSER = "evtx"

# Spellings of the container fields.
EVENT_ID_KEYS = ("EventID", "EventID_", "EventId")
TIME_KEYS = ("TimeCreated_SystemTime", "TimeCreated", "SystemTime")
PROVIDER_KEYS = ("Provider_Name", "Provider", "ProviderName", "Provider_Guid")
CHANNEL_KEYS = ("Channel",)
COMPUTER_KEYS = ("Computer", "Computer_", "ComputerName")
RECORD_KEYS = ("EventRecordID", "RecordId", "RecordNumber")
USER_KEYS = ("TargetUserName", "SubjectUserName", "User", "AccountName", "TargetAccount")

# Container fields that are not payload.
CONTAINER_KEYS = (
    "eventid", "eventid_", "eventid_qualifiers", "eventidqualifiers",
    "timecreated", "timecreated_systemtime", "systemtime", "provider",
    "provider_name", "providername", "provider_guid", "channel", "computer",
    "computer_", "computername", "eventrecordid", "recordid", "recordnumber",
    "level", "task", "opcode", "keywords", "version", "correlation",
    "correlation_activityid", "execution", "execution_processid",
    "execution_threadid", "security", "security_userid", "eventsourcename",
)
# Providers whose ids carry the system meaning.
SYSTEM_PROVIDERS = (
    "service control manager", "eventlog", "microsoft-windows-eventlog", "user32",
    "microsoft-windows-winlogon", "microsoft-windows-kernel-general",
    "microsoft-windows-kernel-power",
)
# A researched level never exceeds med.
RESEARCHED_LEVEL = {
    "critical": "med", "high": "med", "medium": "med", "low": "low", "informational": "info",
}
# Family, event id, event type, techniques, level.
TAXONOMY = (
    ("security", "4624", "logon_success", ("T1078",), "info"),
    ("security", "4625", "logon_failed", ("T1110",), "info"),
    ("security", "4634", "logoff", (), "info"),
    ("security", "4647", "logoff", (), "info"),
    ("security", "4648", "explicit_cred_logon", ("T1078", "T1550.002"), "med"),
    ("security", "4672", "special_privileges", ("T1078.002",), "info"),
    ("security", "4688", "process_created", ("T1059",), "info"),
    ("security", "4697", "service_installed", ("T1543.003",), "high"),
    ("security", "4698", "scheduled_task_created", ("T1053.005",), "high"),
    ("security", "4699", "scheduled_task_deleted", ("T1053.005",), "med"),
    ("security", "4702", "scheduled_task_updated", ("T1053.005",), "med"),
    ("security", "4720", "account_created", ("T1136.001",), "high"),
    ("security", "4722", "account_enabled", ("T1098",), "med"),
    ("security", "4724", "password_reset", ("T1098",), "med"),
    ("security", "4726", "account_deleted", ("T1531",), "med"),
    ("security", "4728", "added_to_global_group", ("T1098",), "med"),
    ("security", "4732", "added_to_local_group", ("T1098",), "high"),
    ("security", "4735", "local_group_changed", ("T1098",), "med"),
    ("security", "4738", "account_changed", ("T1098",), "info"),
    ("security", "4740", "account_lockout", ("T1110",), "med"),
    ("security", "4768", "kerberos_tgt_request", ("T1078",), "info"),
    ("security", "4769", "kerberos_tgs_request", ("T1558.003",), "info"),
    ("security", "4771", "kerberos_preauth_failed", ("T1110",), "info"),
    ("security", "4776", "ntlm_validation", ("T1110",), "info"),
    ("security", "5140", "share_accessed", ("T1021.002",), "med"),
    ("security", "5145", "share_object_checked", ("T1021.002",), "info"),
    ("security", "1102", "audit_log_cleared", ("T1070.001",), "high"),
    ("system", "7045", "service_installed", ("T1543.003",), "high"),
    ("system", "7040", "service_startmode_changed", ("T1543.003",), "med"),
    ("system", "7034", "service_crashed", (), "info"),
    ("system", "7036", "service_state_changed", (), "info"),
    ("system", "104", "audit_log_cleared", ("T1070.001",), "high"),
    ("system", "1074", "system_shutdown", (), "info"),
    ("system", "6005", "eventlog_started", (), "info"),
    ("powershell", "4103", "powershell_module_log", ("T1059.001",), "info"),
    ("powershell", "4104", "powershell_scriptblock", ("T1059.001",), "med"),
    ("powershell", "400", "powershell_engine_start", ("T1059.001",), "info"),
    ("powershell", "600", "powershell_provider_start", ("T1059.001",), "info"),
    ("sysmon", "1", "process_created", ("T1059",), "info"),
    ("sysmon", "2", "file_time_changed", ("T1070.006",), "med"),
    ("sysmon", "3", "network_connection", ("T1071",), "info"),
    ("sysmon", "7", "image_loaded", ("T1574.002",), "info"),
    ("sysmon", "8", "remote_thread_created", ("T1055",), "high"),
    ("sysmon", "10", "process_access", ("T1003.001",), "med"),
    ("sysmon", "11", "file_created", (), "info"),
    ("sysmon", "12", "registry_key_event", ("T1112",), "info"),
    ("sysmon", "13", "registry_value_set", ("T1112",), "info"),
    ("sysmon", "15", "file_stream_created", ("T1564.004",), "med"),
    ("sysmon", "22", "dns_query", ("T1071.004",), "info"),
    ("sysmon", "23", "file_deleted", ("T1070.004",), "med"),
    ("task", "106", "scheduled_task_registered", ("T1053.005",), "med"),
    ("task", "129", "scheduled_task_process", ("T1053.005",), "info"),
    ("task", "200", "scheduled_task_executed", ("T1053.005",), "info"),
    ("task", "201", "scheduled_task_completed", ("T1053.005",), "info"),
    ("rdp", "1149", "rdp_connection", ("T1021.001",), "med"),
    ("rdp", "21", "rdp_logon", ("T1021.001",), "med"),
    ("rdp", "24", "rdp_disconnect", ("T1021.001",), "info"),
    ("defender", "1116", "malware_detected", (), "high"),
    ("defender", "1117", "malware_action_taken", (), "med"),
    ("defender", "5001", "defender_disabled", ("T1562.001",), "high"),
)
TEMPLATE_FIELDS = "array<struct<label:string,names:array<string>>>"


def read_winevents(table: DataFrame, record: str = "record") -> DataFrame:
    """Decoded records: ``path``, ``record_no`` and a string map of all fields.

    The map may come as a JSON object column instead.
    """
    kind = dict(table.dtypes)[record]
    if kind == "string":
        table = table.withColumn(record, F.from_json(record, "map<string,string>"))
    return table.withColumn(
        record, F.map_filter(record, lambda k, v: v.isNotNull())
    )


def family(provider: Column, channel: Column) -> Column:
    """The log family an event id is read in; unknown providers are ``other``."""
    own, where = F.lower(F.trim(provider)), F.lower(F.trim(channel))
    text = F.lower(F.concat_ws(" ", provider, channel))
    return (
        F.when(text.contains("sysmon"), "sysmon")
        .when(text.contains("powershell"), "powershell")
        .when(text.contains("taskscheduler") | text.contains("task scheduler"), "task")
        .when(
            text.contains("terminalservices") | text.contains("remoteconnectionmanager"), "rdp"
        )
        .when(text.contains("defender"), "defender")
        .when(text.contains("security-auditing") | (where == "security"), "security")
        .when(own.isin(*SYSTEM_PROVIDERS) | (where == "system"), "system")
        .otherwise("other")
    )


def taxonomy(table: DataFrame) -> DataFrame:
    """The fixed taxonomy as a table: small by construction, so it is broadcast."""
    rows = [(f, i, t, list(a), s) for f, i, t, a, s in TAXONOMY]
    return table.sparkSession.createDataFrame(
        rows, "family string, event_id string, t_type string, t_attck array<string>, t_level string"
    )


def capture_fields(record: Column) -> Column:
    """Every payload field whole, its name in snake case."""

    def kept(e: Column) -> Column:
        name = F.lower(e["key"])
        is_ip = name.contains("ipaddress") | name.endswith("address")
        value = F.when(is_ip, normalize_ip(e["value"])).otherwise(e["value"])
        return F.struct(snake(e["key"]).alias("key"), value.alias("value"))

    fields = F.filter(
        F.map_entries(record),
        lambda e: ~F.lower(e["key"]).isin(*CONTAINER_KEYS) & (or_blank(e["value"]) != ""),
    )
    return F.map_from_entries(F.filter(F.transform(fields, kept), lambda e: e["value"] != ""))


def split_hashes(hashes: Column) -> Column:
    """``SHA256=…,MD5=…`` as a map of lower-case algorithm to digest."""
    pieces = F.transform(
        F.filter(F.split(or_blank(hashes), ","), lambda p: p.contains("=")),
        lambda p: F.struct(
            F.lower(F.trim(F.substring_index(p, "=", 1))).alias("key"),
            F.lower(F.trim(p.substr(F.instr(p, "=") + 1, F.length(p)))).alias("value"),
        ),
    )
    known = F.filter(pieces, lambda e: e["key"].isin("md5", "sha1", "sha256", "imphash"))
    return F.map_from_entries(known)


def winevent_rows(records: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Records with their family, taxonomy and template columns resolved.

    ``templates``: (provider, event_id, title, level, fields, attck) keyed by
    lower-case provider; a user-supplied dimension table.
    """
    record = F.col("record")
    stem = F.regexp_replace(file_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    # Records without a time leave here; see ``if_any`` for why not by a filter.
    dated = records.select(
        "*", if_any(iso_time(F.trim(entry(record, *TIME_KEYS)), "UTC")).alias("event_time")
    )
    rows = dated.select(
        "*",
        or_blank(F.trim(entry(record, *EVENT_ID_KEYS))).alias("event_id"),
        or_blank(entry(record, *PROVIDER_KEYS)).alias("provider"),
        F.coalesce(entry(record, *CHANNEL_KEYS), blank_to_null(stem), F.lit("evtx")).alias(
            "channel"
        ),
        F.coalesce(blank_to_null(stem), F.lit("evtx")).alias("log"),
    )
    rows = rows.withColumn("family", family(F.col("provider"), F.col("channel")))
    rows = rows.join(F.broadcast(taxonomy(records)), ["family", "event_id"], "left")
    if templates is None:
        return rows.select(
            "*",
            F.lit(None).cast("string").alias("p_title"),
            F.lit(None).cast("string").alias("p_level"),
            F.lit(None).cast(TEMPLATE_FIELDS).alias("p_fields"),
            F.lit(None).cast("array<string>").alias("p_attck"),
        )
    keyed = templates.select(
        F.lower("provider").alias("p_provider"),
        F.col("event_id").alias("p_event_id"),
        F.col("title").alias("p_title"),
        F.col("level").alias("p_level"),
        F.col("fields").cast(TEMPLATE_FIELDS).alias("p_fields"),
        F.col("attck").alias("p_attck"),
    )
    on = (F.lower(F.trim("provider")) == F.col("p_provider")) & (
        F.col("event_id") == F.col("p_event_id")
    )
    return rows.join(keyed, on, "left").drop("p_provider", "p_event_id")


def winevent_events(
    records: DataFrame, templates: DataFrame | None = None, *, host: str = ""
) -> DataFrame:
    """Decoded records as events: taxonomy, payload, details, scoring and tags."""
    rows = winevent_rows(records, templates)
    record = F.col("record")
    templated = F.col("p_title").isNotNull()
    researched = F.lit("info")
    for level, ours in RESEARCHED_LEVEL.items():
        researched = F.when(F.lower(or_blank(F.col("p_level"))) == level, ours).otherwise(researched)

    captured = capture_fields(record)
    data = put(
        captured,
        payload(
            event_id=F.col("event_id"),
            channel=F.col("channel"),
            provider=blank_to_null(F.col("provider")),
            script=blank_to_null(record["ScriptBlockText"]),
        ),
    )
    rows = rows.withColumn("__data", data)
    rows = rows.withColumn("__data", put(F.col("__data"), split_hashes(F.col("__data")["hashes"])))
    d = F.col("__data")
    command = or_blank(entry(d, "command_line", "process_command_line"))
    haystack = F.concat_ws(
        " ",
        blank_to_null(command),
        blank_to_null(record["ScriptBlockText"]),
        *[
            blank_to_null(d[k])
            for k in ("image_path", "service_file_name", "new_process_name", "image")
        ],
    )
    event_type = F.coalesce(
        F.col("t_type"),
        F.when(F.col("family") == "other", F.lit("windows_event")).otherwise(
            F.concat("family", F.lit("_event"))
        ),
    )
    base_level = F.coalesce(F.col("t_level"), researched)
    rows = (
        rows.withColumn("__type", event_type)
        .withColumn("__command", command)
        .withColumn("__risk", escalate_cmdline(haystack, level_rank(base_level)))
        .withColumn(
            "__score", score_event(F.col("__type"), d, F.col("__risk.rank"))
        )
        .withColumn(
            "__details",
            build_details(
                record, F.col("p_fields"), F.col("provider"), F.col("channel"), F.col("event_id")
            ),
        )
    )
    none = strings([])
    rank = F.coalesce(F.col("__score.rank"), F.col("__risk.rank"))
    tags = F.concat(
        F.coalesce(F.col("__score.tags"), none),
        F.array_compact(
            F.array(
                F.when(F.col("__data")["logon_type"] == "10", F.lit("rdp")),
                F.when((F.col("__type") == "process_created") & (rank >= 3), F.lit("suspicious")),
                F.when(~templated, F.lit("auto_fields")),
            )
        ),
    )
    extra = payload(
        suspicious_cmdline=F.when(
            (F.col("__risk.rank") == 3) & (F.col("__command") != ""), F.lit("true")
        ),
        why=summarize_reasons(F.col("__score.reasons")),
    )
    artifact = F.col("artifact_id") if "artifact_id" in records.columns else F.lit(0)
    events = rows.select(
        line_id(F.col("path"), F.col("record_no")).alias("id"),
        artifact.cast("long").alias("artifact_id"),
        "event_time",
        F.lit("Event Logged").alias("ts_desc"),
        F.col("__type").alias("event_type"),
        F.coalesce(
            F.col("p_title"),
            F.concat(
                F.lit("EventID "), "event_id", F.lit(" — "),
                F.coalesce(
                    blank_to_null(F.col("provider")), blank_to_null(F.col("channel")),
                    F.lit("unknown provider"),
                ),
                F.lit(" (no template)"),
            ),
        ).alias("title"),
        F.col("__details.details").alias("details"),
        F.col("__details.extra").alias("extra_fields"),
        "channel",
        blank_to_null(F.trim(entry(record, *RECORD_KEYS))).alias("record_id"),
        blank_to_null(F.col("event_id")).alias("event_id"),
        put(F.col("__data"), extra).alias("data"),
        or_blank(entry(record, *USER_KEYS)).alias("user"),
        or_blank(entry(record, *COMPUTER_KEYS)).alias("host"),
        F.concat(
            F.coalesce(F.col("t_attck"), F.col("p_attck"), none),
            F.col("__risk.attck"),
            F.coalesce(F.col("__score.attck"), none),
        ).alias("attck"),
        tags.alias("tags"),
        level_name(rank).alias("severity"),
        F.concat(F.lit("evtx/"), "log").alias("source_artifact"),
        F.col("path").alias("artifact_path"),
        F.lit(PARSER).alias("parser"),
    )
    return normalize(events, host=host)
