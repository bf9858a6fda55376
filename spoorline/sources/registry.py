"""Windows registry values that are already decoded to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.levels import level_name, level_rank, rank_lit
from spoorline.functions.text import (
    blank_to_null,
    cut,
    file_name,
    matches,
    or_blank,
    payload,
    pretty,
    strings,
    summarize_reasons,
)
from spoorline.functions.times import bias_offset
from spoorline.operators.normalize import line_id, normalize, union_events
from spoorline.operators.scoring import SUSPECT_IMAGE, is_pasted_lure, score_autorun
from spoorline.schema import FILE_TIME, LOGGED

PARSER = "registry"
MESSAGE_LIMIT = 400

# Keys worth reading per hive, with type, techniques and level.
RUN_KEYS = (
    r"Microsoft\Windows\CurrentVersion\Run",
    r"Microsoft\Windows\CurrentVersion\RunOnce",
    r"Microsoft\Windows\CurrentVersion\RunServices",
    r"Microsoft\Windows\CurrentVersion\RunServicesOnce",
    r"Microsoft\Windows\CurrentVersion\Policies\Explorer\Run",
)
HIVE_KEYS = (
    ("software", r"Microsoft\Windows NT\CurrentVersion\Winlogon", "winlogon_config",
     ("T1547.004",), "med"),
    ("software", r"Microsoft\Windows NT\CurrentVersion\Image File Execution Options",
     "ifeo_hijack", ("T1546.012",), "high"),
    ("software", r"Microsoft\Windows\CurrentVersion\Explorer\FileExts", "file_assoc", (), "info"),
    ("software", r"Microsoft\Windows Defender\Exclusions\Paths", "defender_exclusion",
     ("T1562.001",), "high"),
    ("software", r"Microsoft\Windows Defender\Exclusions\Extensions", "defender_exclusion",
     ("T1562.001",), "high"),
    ("system", r"Select", "hive_select", (), "info"),
    ("system", r"ControlSet001\Control\ComputerName\ComputerName", "computer_name", (), "info"),
    ("system", r"ControlSet001\Control\TimeZoneInformation", "system_timezone", (), "info"),
    ("system", r"ControlSet001\Services", "service_list", ("T1543.003",), "med"),
    ("system", r"ControlSet001\Enum\USBSTOR", "usb_device", ("T1091",), "med"),
    ("system", r"MountedDevices", "mounted_device", ("T1091",), "info"),
    ("system", r"ControlSet001\Control\Session Manager\Memory Management", "memory_config",
     (), "info"),
    ("system", r"ControlSet001\Control\Terminal Server", "rdp_config", ("T1021.001",), "med"),
    ("system", r"ControlSet001\Control\Lsa", "lsa_config", ("T1003.001",), "med"),
    ("ntuser", r"Software\Microsoft\Windows\CurrentVersion\Explorer\TypedPaths", "typed_path",
     (), "info"),
    ("ntuser", r"Software\Microsoft\Windows\CurrentVersion\Explorer\RunMRU", "run_mru",
     ("T1059",), "med"),
    ("ntuser", r"Software\Microsoft\Windows\CurrentVersion\Explorer\RecentDocs", "recent_doc",
     (), "info"),
    ("ntuser", r"Software\Microsoft\Terminal Server Client\Servers", "rdp_client_history",
     ("T1021.001",), "med"),
    ("ntuser", r"Software\Microsoft\Windows\CurrentVersion\Explorer\UserAssist",
     "userassist_exec", ("T1204.002",), "info"),
    ("ntuser", r"Environment", "user_environment", (), "info"),
    ("usrclass", r"Local Settings\Software\Microsoft\Windows\Shell\BagMRU", "shellbag",
     (), "info"),
    ("sam", r"SAM\Domains\Account\Users\Names", "local_account", ("T1087.001",), "info"),
    ("amcache", r"Root\InventoryApplicationFile", "amcache_exec", ("T1204",), "med"),
    ("amcache", r"Root\File", "amcache_exec", ("T1204",), "med"),
)
CONTAINERS = (
    "service_list", "usb_device", "local_account", "amcache_exec", "rdp_client_history",
    "shellbag", "file_assoc",
)
ROT13_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT13_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def rot13(text: Column) -> Column:
    return F.translate(text, ROT13_FROM, ROT13_TO)


def hive_type(path: Column, root_names: Column | None = None) -> Column:
    """Which hive a file is: by its name, else by the keys at its root."""
    name = F.lower(file_name(path))
    result = (
        F.when(name.startswith("ntuser"), "ntuser")
        .when(name.startswith("usrclass"), "usrclass")
        .when(name.contains("amcache"), "amcache")
    )
    for hive in ("sam", "system", "software", "security"):
        result = result.when(name.isin(hive, f"{hive}.hve"), hive)
    if root_names is None:
        return result.otherwise("unknown")
    roots = F.transform(root_names, lambda n: F.lower(n))
    has = lambda key: F.array_contains(roots, key)
    return (
        result.when(has("select") | has("controlset001"), "system")
        .when(has("microsoft") & ~has("classes"), "software")
        .when(has("sam"), "sam")
        .when(F.exists(roots, lambda n: n.startswith("root")), "amcache")
        .when(has("local settings"), "usrclass")
        .when(has("environment") | has("volatile environment"), "ntuser")
        .otherwise("unknown")
    )


def key_table(table: DataFrame) -> DataFrame:
    """The fixed key list as a table: small by construction, so it is broadcast."""
    rows = [
        (hive, key, "autostart_run_key", ["T1547.001"], "high")
        for hive in ("software", "ntuser")
        for key in RUN_KEYS
    ] + [(h, k, t, list(a), s) for h, k, t, a, s in HIVE_KEYS]
    return table.sparkSession.createDataFrame(
        rows,
        "hive_type string, key_path string, event_type string, k_attck array<string>, "
        "k_level string",
    )


def known_keys(values: DataFrame) -> DataFrame:
    """Decoded rows under a listed key.

    ``values``: (path, hive_type, key_path, subkey, value_name, value, key_time,
    mtime, value_no); ``subkey`` is null for a value of the key itself.
    """
    if "hive_type" not in values.columns:
        roots = values.columns and "root_names" in values.columns
        named = hive_type(F.col("path"), F.col("root_names") if roots else None)
        values = values.withColumn("hive_type", named)
    return values.join(F.broadcast(key_table(values)), ["hive_type", "key_path"])


def _words(event_type: Column) -> Column:
    return F.translate(event_type, "_", " ")


def leaf_events(values: DataFrame) -> DataFrame:
    """One event per value of a key that is not a container."""
    kind, raw_name = F.col("event_type"), F.coalesce(blank_to_null(F.col("value_name")), F.lit("(Default)"))
    name, lowered = raw_name, F.lower(raw_name)
    text = or_blank(F.col("value"))
    zone, run_key = kind == "system_timezone", kind == "autostart_run_key"
    bias = lowered.isin("activetimebias", "bias")
    zone_names = lowered.isin("timezonekeyname", "standardname", "daylightname")
    autorun = score_autorun(text, level_rank(F.col("k_level")))
    lure = (kind == "run_mru") & is_pasted_lure(text)
    rows = (
        known_keys(values)
        .filter(~kind.isin(*CONTAINERS) & F.col("subkey").isNull())
        .filter(~zone | bias | zone_names)
        .filter((text != "") | kind.isin("system_timezone", "computer_name"))
        .withColumn("__auto", F.when(run_key, autorun))
        .withColumn(
            "__bare",
            run_key & matches(text, SUSPECT_IMAGE) & (F.col("__auto.rank") != rank_lit("crit")),
        )
    )
    rank = (
        F.when(F.col("__bare"), rank_lit("high"))
        .when(run_key, F.col("__auto.rank"))
        .when(lure, rank_lit("high"))
        .when(kind == "defender_exclusion", rank_lit("high"))
        .otherwise(level_rank(F.col("k_level")))
    )
    reasons = F.when(
        F.col("__bare"),
        F.concat(F.col("__auto.reasons"), strings(["it is a script, a shell or a temporary file"])),
    ).otherwise(F.col("__auto.reasons"))
    program = F.when(kind == "userassist_exec", rot13(name))
    none = strings([])
    return rows.select(
        "path", "hive_type", "key_time", "mtime", "value_no", "event_type",
        cut(
            F.concat(_words(kind), F.lit(": "), F.coalesce(program, name), F.lit(" = "), text),
            MESSAGE_LIMIT,
        ).alias("message"),
        payload(
            key=F.col("key_path"), name=name, value=text,
            utc_offset=F.when(zone & bias, bias_offset(text.try_cast("long"))),
            program=program,
            why=summarize_reasons(reasons),
            suspicious=F.when((run_key & (rank >= 3)) | lure, F.lit("true")),
        ).alias("data"),
        level_name(rank).alias("severity"),
        F.when(lure, F.concat("k_attck", strings(["T1204.004"])))
        .otherwise(F.col("k_attck"))
        .alias("attck"),
        F.when(run_key, F.col("__auto.tags"))
        .when(lure, strings(["pasted_command", "suspicious"]))
        .otherwise(none)
        .alias("tags"),
    )


def subkey_events(values: DataFrame) -> DataFrame:
    """One event per subkey of a container, shaped by what the container means."""
    rows = known_keys(values).filter(
        F.col("event_type").isin(*CONTAINERS) & F.col("subkey").isNotNull()
    )
    keys = ["path", "hive_type", "key_path", "subkey", "event_type", "k_attck", "k_level"]

    def named(*names: str) -> Column:
        tests = [F.max(F.when(F.col("value_name") == n, F.col("value"))) for n in names]
        return or_blank(F.coalesce(*[blank_to_null(t) for t in tests]))

    facts = rows.groupBy(*keys).agg(
        F.max("key_time").alias("key_time"),
        F.max("mtime").alias("mtime"),
        F.min("value_no").alias("value_no"),
        named("ImagePath").alias("image"),
        named("Start").alias("start"),
        named("Type").alias("type"),
        named("DisplayName").alias("display"),
        named("LowerCaseLongPath", "15").alias("program_path"),
        named("FileId", "101").alias("sha1"),
        named("UsernameHint").alias("user_hint"),
    )
    listed = (
        rows.filter(F.col("event_type").isin("shellbag", "file_assoc"))
        .filter(F.col("value_name").isNotNull())
        .groupBy("path", "key_path", "subkey")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("value_name", "value"))
            ).alias("listed")
        )
    )
    facts = facts.join(listed, ["path", "key_path", "subkey"], "left")
    kind, sub = F.col("event_type"), F.col("subkey")
    service = kind == "service_list"
    bad = service & matches(F.col("image"), SUSPECT_IMAGE)
    sha1 = F.lower(
        F.when(F.col("sha1").startswith("0000"), F.col("sha1").substr(F.lit(5), F.length("sha1")))
        .otherwise(F.col("sha1"))
    )
    amcache, rdp = kind == "amcache_exec", kind == "rdp_client_history"
    only = lambda test, value: F.when(test, value)
    message = (
        F.when(bad, F.concat(F.lit("suspicious service: "), sub, F.lit(" -> "), "image"))
        .when(service, F.concat(F.lit("service: "), sub, F.lit(" -> "), "image"))
        .when(kind == "usb_device", F.concat(F.lit("USB device: "), sub))
        .when(kind == "local_account", F.concat(F.lit("local account: "), sub))
        .when(
            amcache,
            F.concat(F.lit("amcache: "), F.coalesce(blank_to_null(F.col("program_path")), sub)),
        )
        .when(rdp, F.concat(F.lit("RDP client target: "), sub))
        .otherwise(F.concat(_words(kind), F.lit(": "), sub))
    )
    return facts.filter(~service | (F.col("image") != "")).select(
        "path", "hive_type", "key_time", "mtime", "value_no", "event_type",
        cut(message, MESSAGE_LIMIT).alias("message"),
        payload(
            key=F.concat("key_path", F.lit("\\"), sub), name=sub,
            service_name=only(service, sub), image_path=only(service, F.col("image")),
            start=only(service, F.col("start")), type=only(service, F.col("type")),
            display_name=only(service, F.col("display")),
            suspicious=only(bad, F.lit("true")),
            device=only(kind == "usb_device", sub),
            account=only(kind == "local_account", sub),
            program_path=only(amcache, F.col("program_path")), sha1=only(amcache, sha1),
            server=only(rdp, sub), username_hint=only(rdp, F.col("user_hint")),
            values=F.to_json("listed"),
        ).alias("data"),
        F.when(bad, "high").when(service, "info").otherwise(F.col("k_level")).alias("severity"),
        F.col("k_attck").alias("attck"),
        strings([]).alias("tags"),
    )


def hive_events(values: DataFrame) -> DataFrame:
    """One event per hive file: it exists, and when its root was last written."""
    if "hive_type" not in values.columns:
        values = values.withColumn("hive_type", hive_type(F.col("path")))
    root = F.max(F.when(F.col("key_path") == "", F.col("key_time")))
    hives = values.groupBy("path", "hive_type").agg(
        root.alias("key_time"), F.max("mtime").alias("mtime")
    )
    return hives.select(
        "path", "hive_type", "key_time", "mtime",
        F.lit(0).cast("long").alias("value_no"),
        F.lit("registry_hive").alias("event_type"),
        F.concat(file_name(F.col("path")), F.lit(": "), "hive_type", F.lit(" hive ingested"))
        .alias("message"),
        payload(hive_type=F.col("hive_type")).alias("data"),
        F.lit("info").alias("severity"),
        strings([]).alias("attck"),
        strings([]).alias("tags"),
    )


def registry_events(values: DataFrame, *, host: str = "") -> DataFrame:
    """Decoded registry values as events, dated by the key's last write."""
    artifact = F.lit(0)
    rows = union_events(hive_events(values), leaf_events(values), subkey_events(values))
    if "artifact_id" in values.columns:
        numbers = values.groupBy("path").agg(F.max("artifact_id").alias("artifact_id"))
        rows, artifact = rows.join(numbers, "path"), F.col("artifact_id")
    events = rows.select(
        line_id(F.col("path"), F.col("value_no"), F.col("hive_type")).alias("id"),
        artifact.cast("long").alias("artifact_id"),
        F.coalesce("key_time", "mtime").alias("event_time"),
        F.when(F.col("event_type") == "registry_hive", "Hive root last write")
        .otherwise("Registry key last write")
        .alias("ts_desc"),
        F.when(F.col("key_time").isNotNull(), LOGGED).otherwise(FILE_TIME).alias("time_kind"),
        "event_type",
        pretty(F.col("event_type")).alias("title"),
        F.col("message").alias("details"),
        "message", "data", "severity", "attck", "tags",
        F.concat(F.lit("registry/"), "hive_type").alias("source_artifact"),
        F.col("path").alias("artifact_path"),
        F.lit(PARSER).alias("parser"),
    )
    return normalize(events, host=host)
