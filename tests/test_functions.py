import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from spoorline.functions import details, levels, network, paths, text, times


def one(spark, value, dtype="string", **columns):
    """Values of expressions over one input column ``v``."""
    df = spark.createDataFrame([(v,) for v in value], f"v {dtype}")
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_ip_tags_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    v4 = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    v4 += ["10.1.2.3", "127.0.0.1", "0.0.0.0", "192.0.0.9", "192.0.0.8", "224.0.0.1", "255.255.255.255",
           "172.31.0.1", "172.32.0.1", "100.64.0.1", "198.19.0.1", "203.0.113.9"]
    v6 = [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(100)]
    v6 += [ipaddress.IPv6Address(a).exploded for a in ("::1", "fe80::1", "fc00::9", "2001:db8::1", "ff02::1",
           "2001:4860::8888", "2001:20::5", "64:ff9b:1::1")]

    def expected(value):
        a = ipaddress.ip_address(value)
        tags = [n for n in ("private", "loopback", "multicast") if getattr(a, f"is_{n}")]
        return tags + (["reserved"] if a.is_reserved or a.is_unspecified else [])

    rows = one(spark, v4 + v6, v=F.col("v"), tags=network.ip_tags(F.col("v")))
    for row in rows:
        assert row["tags"] == expected(row["v"]), row
    bad = one(spark, ["01.2.3.4", "1.2.3.256", "1.2.3", "x"], t=network.ip_tags(F.col("v")))
    assert all(r["t"] is None for r in bad)


@pytest.mark.parametrize(
    "name, odd",
    [("qXzRt7Kp", True), ("kWvBq9Zr2T", True), ("WINWORD.EXE", False), ("node.exe", False),
     ("RtkService64.exe", False), ("short", False), ("deadbeefcafe0123", False), ("ÄxQz7kPw", False)],
)
def test_machine_generated_names(spark, name, odd):
    assert one(spark, [name], x=paths.looks_machine_generated(F.col("v")))[0]["x"] is odd


def test_random_segments_keep_case(spark):
    got = one(spark, ['"C:/Users/a/AppData/Local/qXzRt7Kp/node.exe"'], x=paths.random_segments(F.col("v")))
    assert got[0]["x"] == ["qXzRt7Kp"]


def test_level_arithmetic(spark):
    got = one(spark, ["crit", "med", "nonsense", None], r=levels.level_rank(F.col("v")),
              c=levels.level_name(levels.level_rank(F.col("v"))))
    assert [(g["r"], g["c"]) for g in got] == [(4, "crit"), (2, "med"), (0, "info"), (0, "info")]
    raised = one(spark, [0, 1, 2, 3], "int", x=levels.raised(F.col("v"), F.lit(2)))
    assert [r["x"] for r in raised] == [2, 2, 2, 3]


def test_times_are_checked():
    assert times.parse_time("2024-03-01 05:00", "+05:00").isoformat() == "2024-03-01T00:00:00+00:00"
    assert times.check_zone("-0600") == "-06:00"
    for bad in ("yesterday", ""):
        with pytest.raises(ValueError):
            times.parse_time(bad)
    with pytest.raises(ValueError):
        times.check_zone("Nowhere/Land")


def test_log_clock(spark):
    mtime = F.lit("2024-01-03 00:00:00").cast("timestamp")
    lines = ["Dec  9 23:00:01 h p: m", "Jan  2 01:02:03 h p: m", "2024-01-01T10:00:00+02:00 h p: m",
             "2024-01-01 10:00:00 h p: m", "Feb 30 00:00:00 h p: m", "nothing"]
    clock = times.syslog_clock(F.col("v"), mtime, "+01:00", F.lit(None).cast("int"))
    got = one(spark, lines, t=times.seconds_text(clock["time"]), e=clock["explicit"])
    assert [g["t"] for g in got] == [
        "2023-12-09 22:00:01", "2024-01-02 00:02:03", "2024-01-01 08:00:00", "2024-01-01 09:00:00", None, None]
    assert got[2]["e"] is True and got[3]["e"] is False
    hinted = times.syslog_clock(F.col("v"), mtime, "UTC", F.lit(2020))
    assert one(spark, lines[:1], t=times.seconds_text(hinted["time"]))[0]["t"] == "2020-12-09 23:00:01"


def test_any_clock(spark):
    lines = ["x [01/Mar/2024:12:00:00 +0100] y", "a 2024/03/01 12:00:00 b", "a 2024-03-01T12:00:00Z b", "none",
             "[45/Mar/2024:12:00:00 +0100] 2024/03/01 01:00:00"]
    got = one(spark, lines, t=times.seconds_text(times.any_clock(F.col("v"), "+02:00")))
    assert [g["t"] for g in got] == [
        "2024-03-01 11:00:00", "2024-03-01 10:00:00", "2024-03-01 12:00:00", None, "2024-02-29 23:00:00"]


def test_offsets(spark):
    got = one(spark, ["UTC-05:30", "UTC+02:00", "x"], m=times.offset_minutes(F.col("v")))
    assert [g["m"] for g in got] == [-330, 120, None]
    back = one(spark, [300, -60, 0], "long", b=times.bias_offset(F.col("v")))
    assert [b["b"] for b in back] == ["UTC-05:00", "UTC+01:00", "UTC+00:00"]


def test_names(spark):
    got = one(spark, ["TargetUserName"], s=text.snake(F.col("v")))[0]
    assert got["s"] == "target_user_name"
    got = one(spark, ['"C:/Tools/Run.EXE"'], b=text.basename(F.col("v")))[0]
    assert got["b"] == "run.exe"
    assert one(spark, ["service_installed", ""], p=text.pretty(F.col("v")))[0]["p"] == "Service installed"


def test_pairs_that_do_not_fit_are_counted(spark):
    pairs = F.array(*[details.pair(F.lit(k), F.lit(v)) for k, v in (("a", "x" * 20), ("b", "y" * 200), ("c", "z"))])
    got = one(spark, ["-"], p=details.render_pairs(pairs, 60))[0]["p"]
    assert got == f"a: {'x' * 20} ¦ c: z ¦ +1 more"


def test_details_have_three_tiers(spark):
    rows = [({"param10": "b", "param2": "a", "LogonType": "3"}, "4624"), ({"Channel": "x"}, "1"), ({}, "7")]
    df = spark.createDataFrame(rows, "d map<string,string>, e string")
    none = F.lit(None).cast("array<struct<label:string,names:array<string>>>")
    template = F.array(F.struct(F.lit("Type").alias("label"), F.array(F.lit("logontype")).alias("names")))
    auto = df.select(details.build_details(F.col("d"), none, F.lit("P"), F.lit("C"), F.col("e")).alias("x")).collect()
    assert auto[0].x.details == "LogonType: 3 (Network) ¦ param2: a ¦ param10: b"
    assert auto[2].x.details == "Provider: P ¦ Channel: C ¦ EventID: 7 ¦ NoFieldData: record carries no EventData"
    used = df.select(details.build_details(F.col("d"), template, F.lit("P"), F.lit("C"), F.col("e")).alias("x")).first()
    assert used.x.details == "Type: 3 (Network)" and used.x.extra == "param2: a ¦ param10: b"
    back = df.select(details.parse_details(F.lit("a: 1 ¦ b: x: y ¦ ")).alias("m")).first()
    assert back.m == {"a": "1", "b": "x: y"}


def test_coded_values(spark):
    cases = [("Status", "0x18", "4771", "0x18 (bad password (pre-auth failed))"), ("Status", "0x18", "4625", "0x18"),
             ("PreAuthType", "0", "4768", "0 (none — AS-REP roastable)"), ("StartType", "2", "", "2 (auto)"),
             ("Other", "2", "", "2")]
    df = spark.createDataFrame(cases, "f string, v string, e string, want string")
    for row in df.select("want", details.decode_field(F.col("f"), F.col("v"), F.col("e")).alias("got")).collect():
        assert row.got == row.want


def test_defanged_text_and_domains(spark):
    got = one(spark, ["hxxps://bad[.]site(.)net/x at user[at]mail[dot]org"], r=network.refang(F.col("v")))
    assert got[0]["r"] == "https://bad.site.net/x at user@mail.org"
    names = ["evil.exe", "good.org", "1.2.foo", "-a.com", "a.localdomain"]
    assert [r["k"] for r in one(spark, names, k=network.domain_ok(F.col("v")))] == [False, True, False, False, False]
    hosts = ["https://u@Host.com:8/x", "a@b.org", "http://h/?q@z"]
    assert [r["h"] for r in one(spark, hosts, h=network.host_of(F.col("v")))] == ["host.com", "b.org", "z"]
    listed = one(spark, ["microsoft.com", "x.microsoft.com", "notmicrosoft.com"], a=network.allowlisted(F.col("v")))
    assert [r["a"] for r in listed] == [True, True, False]


def test_paths(spark):
    rows = ["/x/etc/ssl/certs/a.pem", "/x/etc/ssh/sshd_config", "/x/etc/cron.d/job.service", "/x/.bash_history",
            "/usr/lib/systemd/system/a.service", "/x/653b494a.0", "/x/notes.txt"]
    got = one(spark, rows, n=paths.is_collector_noise(F.col("v")), e=paths.is_evidence_config(F.col("v")))
    assert [g["n"] for g in got] == [True, False, False, False, True, True, False]
    assert [g["e"] for g in got] == [False, True, True, True, False, False, False]
    owners = one(spark, ["/c/[root]/home/ann/.zsh_history", "/root/.bash_history", "/srv/x"], o=paths.history_owner(F.col("v")))
    assert [o["o"] for o in owners] == ["ann", "root", ""]
    homes = one(spark, ["/root/.ssh/k", "/c/home/bo/.ssh/k", "/etc/x"], o=paths.home_owner(F.col("v")))
    assert [o["o"] for o in homes] == ["root", "bo", ""]


def test_addresses_and_networks_as_bits(spark):
    import ipaddress

    from spoorline.functions.network import address_bits, network_bits

    good = ["10.1.2.3", "0.0.0.0", "::", "::1", "1::", "2001:db8::8:800:200C:417A", "1:2:3:4:5:6:7:8", "fe80::1:2", "1:2:3:4:5:6:7::"]
    bad = ["1.2.3", "256.1.1.1", "1:2:3", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "g::1", "", None, ":", "12345::"]
    rows = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", address_bits(F.col("v")).alias("b")).collect()
    for r in rows:
        if r.v in bad:
            assert r.b is None, r
        else:
            ip = ipaddress.ip_address(r.v)
            assert r.b == f"{ip.version}" + format(int(ip), f"0{ip.max_prefixlen}b")
    mapped = spark.range(1).select(address_bits(F.lit("::FFFF:10.0.0.1")).alias("m"), network_bits(F.lit("10.0.0.0/8")).alias("n"),
                                   network_bits(F.lit("::1")).alias("h"), network_bits(F.lit("x/8")).alias("x")).first()
    assert mapped.m == "4" + format(0x0A000001, "032b") and mapped.n == "400001010" and len(mapped.h) == 129 and mapped.x is None


def test_folding_follows_the_character_data(spark):
    from spoorline.operators.filters import folded

    cases = {"Ἀθῆναι": "αθηναι", "Việt Nam": "viet nam", "İstanbul ŞİŞLİ": "istanbul sisli", "Čeština": "cestina", "Øst-Łódź": "ost lodz", "e\u0301te\u0301": "ete", "Ёлка": "елка", "straße": "straße"}
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", folded(F.col("t")).alias("f")).collect()}
    assert got == cases


def test_fields_are_ranked_and_decoded_without_a_scan_of_lists(spark):
    from spoorline.functions import details
    from spoorline.functions.text import strings

    data = {"x10": "c", "x2": "b  b", "Status": "0x0", "user": "u", "LogonType": "10", "a,b": "\tq\n", "Hidden": " ", "Channel": "no", "gone": "1"}
    frame = spark.createDataFrame([(data,)], "d map<string,string>")
    pairs = details.auto_pairs(F.col("d"), strings(["gone"]), F.lit("1"))
    got = [(r.label, r.value) for r in frame.select(pairs.alias("p")).first().p]
    assert got == [("user", "u"), ("Status", "0x0 (success)"), ("LogonType", "10 (RemoteInteractive)"), ("a,b", "q"), ("x2", "b b"), ("x10", "c")]
    # A scan of the names for each field of each record costs more than all else of it.
    plan = frame.select(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan and "find_in_set" in plan
