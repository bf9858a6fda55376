"""Ranked candidate answers to investigation questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.functions.text import entry, or_blank, strip_ws, strings
from spoorline.functions.times import seconds_text

# --- formatters ---------------------------------------------------------------


def fmt_utc(value: Column) -> Column:
    """``2024-03-01 09:15:14`` from any readable time; other text is kept."""
    text = strip_ws(value)
    return F.coalesce(seconds_text(text.try_cast("timestamp")), text)


def fmt_hash(value: Column) -> Column:
    return F.upper(strip_ws(value))


def fmt_int(value: Column) -> Column:
    """A bare integer without separators; other text is kept."""
    number = F.translate(value, ",", "").try_cast("double")
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.coalesce(whole.cast("string"), strip_ws(value))


def fmt_path(value: Column) -> Column:
    return F.regexp_replace(strip_ws(value), '^"+|"+$', "")


FORMATTERS: dict[str, Callable[[Column], Column]] = {
    "plain": strip_ws, "utc": fmt_utc, "hash": fmt_hash, "int": fmt_int, "path": fmt_path,
}


# --- rules --------------------------------------------------------------------


@dataclass(frozen=True)
class AnswerRule:
    """Maps a shape of question to where its answer lives.

    ``field`` lists payload keys in order; ``@ts``, ``@user``, ``@host`` and
    ``@message`` are columns. ``prefer``: first, last, most_common or given
    (the order of ``value_names``).
    """

    label: str
    patterns: tuple[str, ...]
    field: tuple[str, ...]
    event_types: tuple[str, ...] = ()
    confidence: float = 0.6
    prefer: str = "first"
    form: str = "plain"
    severity: str = ""
    value_names: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


# Addresses a remote login never comes from, and the answer rules.
NOT_REMOTE = ("127.0.0.1", "::1", "0.0.0.0", "::", "-", "localhost")
WHOSE_ADDRESS = (
    r"attacker'?s? ip", r"source ip", r"ip address of the attack", r"which ip", r"what ip",
    r"originat\w+ ip", r"remote ip",
)
FLOODS = ("db_connection_flood", "connection_flood")
ANSWER_RULES: tuple[AnswerRule, ...] = (
    AnswerRule(
        "Attacker source IP", WHOSE_ADDRESS, ("source_ip", "ip_address"),
        ("logon_failed", "ssh_failed_login", "ssh_invalid_user", "ssh_login_success",
         "logon_success", "rdp_connection"),
        0.8, "most_common", exclude=NOT_REMOTE,
    ),
    AnswerRule(
        "Attacker source IP", (*WHOSE_ADDRESS, r"scann?(?:ed|ing|er)", r"brute ?forc"),
        ("source_ip",), FLOODS, 0.9, "most_common", exclude=NOT_REMOTE,
    ),
    AnswerRule(
        "First connection from the attacker",
        (r"when .*(?:first )?(?:connect|access|reach)", r"time .*(?:first )?connect",
         r"start of the attack", r"when did the (?:attack|scan|flood)"),
        ("@ts",), FLOODS, 0.85, form="utc",
    ),
    AnswerRule(
        "Connections from the attacker",
        (r"how many connection", r"number of connection", r"connection count",
         r"how many time.*connect"),
        ("connections",), FLOODS, 0.85, form="int",
    ),
    AnswerRule(
        "Misconfiguration that allowed this",
        (r"what .*(?:vulnerabilit|misconfig|weakness|exposed the)",
         r"how was .*(?:exposed|compromised|accessed)",
         r"why .*(?:unauthenticated|no auth|allowed)", r"root cause", r"initial access vector"),
        ("why",),
        ("config_exposed_service", "config_no_auth", "config_sshd_risk", "config_uid0_account",
         "config_empty_password", "config_ld_preload", "config_nopasswd_sudo"),
        0.8,
    ),
    AnswerRule(
        "Exposed service port",
        (r"what port", r"which port", r"port .*(?:listen|expos|open)", r"listening on"),
        ("port", "address"), ("db_listen", "service_start"), 0.75,
    ),
    AnswerRule(
        "Compromised account",
        (r"which account", r"what account", r"compromised (?:user|account)",
         r"account was (?:compromised|breached)", r"successful\w* (?:logon|login) .*user"),
        ("@user",), ("ssh_login_success", "logon_success"), 0.7, "most_common",
    ),
    AnswerRule(
        "Account created by attacker",
        (r"account\b.{0,30}\bcreat", r"creat\w*\b.{0,30}\baccount", r"new (?:user|account)",
         r"account (?:was )?(?:added|made)", r"backdoor account", r"persistence account"),
        ("@user",), ("account_created",), 0.85,
    ),
    AnswerRule(
        "First successful logon time",
        (r"when did .*(?:log|sign) ?(?:on|in)", r"time of .*(?:logon|login)",
         r"first (?:successful )?(?:logon|login)", r"initial access"),
        ("@ts",), ("ssh_login_success", "logon_success"), 0.75, form="utc",
    ),
    AnswerRule(
        "Brute-force success time",
        (r"brute ?forc", r"password spray", r"guessed the password"),
        ("@ts",), ("ssh_login_success",), 0.8, form="utc", severity="high",
    ),
    AnswerRule(
        "Executed process / command line",
        (r"what command", r"command line", r"which (?:process|binary|executable)",
         r"what (?:process|binary|executable)", r"was executed", r"did .* run"),
        ("cmdline", "cmd", "script", "process", "image_path"),
        ("process_created", "sudo_command", "powershell_scriptblock"), 0.65,
    ),
    AnswerRule(
        "First execution time",
        (r"first (?:run|execut)", r"when .*(?:executed|ran)", r"execution time",
         r"time .* was run"),
        ("@ts",),
        ("process_created", "amcache_exec", "userassist_exec", "scheduled_task_executed"),
        0.7, form="utc",
    ),
    AnswerRule(
        "Persistence mechanism",
        (r"persist", r"auto ?(?:start|run)", r"run key", r"scheduled task",
         r"service (?:was )?(?:created|installed)", r"maintain access"),
        ("@message",),
        ("autostart_run_key", "service_installed", "scheduled_task_created",
         "scheduled_task_registered", "ifeo_hijack", "winlogon_config"),
        0.7,
    ),
    AnswerRule(
        "Service name", (r"(?:name of the )?service", r"service name"),
        ("service_name",), ("service_installed",), 0.7,
    ),
    AnswerRule(
        "Malicious file path",
        (r"(?:file|malware|payload|binary) path", r"where was .* (?:dropped|written|saved)",
         r"full path", r"dropped file"),
        ("image_path", "target_filename", "program_path", "process", "value"),
        ("service_installed", "file_created", "amcache_exec"), 0.6, form="path",
    ),
    AnswerRule(
        "File hash", (r"\bsha ?256\b", r"\bsha ?1\b", r"\bmd5\b", r"\bhash\b"),
        ("sha256", "sha1", "md5", "hashes"), (), 0.7, form="hash",
    ),
    AnswerRule(
        "C2 destination IP",
        (r"c2|command and control", r"destination ip", r"beacon", r"connect\w* (?:out|to)",
         r"exfiltrat\w+ to"),
        ("destination_ip", "destination_hostname", "query_name"),
        ("network_connection", "dns_query"), 0.75, "most_common",
    ),
    AnswerRule(
        "Domain queried", (r"(?:what|which) domain", r"dns (?:query|request)", r"resolved"),
        ("query_name",), ("dns_query",), 0.75, "most_common",
    ),
    AnswerRule(
        "Bytes transferred",
        (r"how (?:much|many) (?:data|bytes)", r"bytes (?:sent|transferred|out)",
         r"data (?:exfiltrated|transferred)"),
        ("bytes_sent", "bytes", "size"), (), 0.6, form="int",
    ),
    AnswerRule(
        "System hostname",
        (r"host ?name", r"name of the (?:host|machine|computer|system)", r"computer name"),
        ("value",), ("computer_name",), 0.85, "given", value_names=("ComputerName",),
    ),
    AnswerRule(
        "System hostname",
        (r"host ?name", r"name of the (?:host|machine|computer|system|server)",
         r"computer name", r"server name"),
        ("@host",), (), 0.6, "most_common",
        exclude=("localhost", "localhost.localdomain", "-", "unknown"),
    ),
    AnswerRule(
        "System timezone", (r"time ?zone", r"utc offset"),
        ("utc_offset", "value"), ("system_timezone",), 0.85, "given",
        value_names=("TimeZoneKeyName", "ActiveTimeBias", "Bias"),
    ),
    AnswerRule(
        "USB device", (r"usb", r"removable (?:media|device)", r"external drive"),
        ("device", "name", "value"), ("usb_device",), 0.8,
    ),
    AnswerRule(
        "Privilege escalation command",
        (r"privile\w+ escalat", r"\bsudo\b", r"become root", r"elevat\w+"),
        ("cmd", "cmdline"), ("sudo_command",), 0.7,
    ),
    AnswerRule(
        "Anti-forensics / log clearing time",
        (r"log\w* (?:were |was )?clear", r"anti.?forensic",
         r"cover\w* (?:their|his|her) track"),
        ("@ts",), ("audit_log_cleared",), 0.85, form="utc",
    ),
    AnswerRule(
        "Detection rule triggered",
        (r"which (?:rule|signature|detection)", r"yara", r"sigma"),
        ("rule",), ("yara_match", "sigma_match"), 0.7, "most_common",
    ),
)
# What an overview asks.
OVERVIEW_QUESTIONS = (
    "what is the hostname",
    "what is the system timezone",
    "what is the attacker ip",
    "which account was compromised",
    "when was the first successful logon",
    "what account was created",
    "what persistence was installed",
    "when were the logs cleared",
)


def match_rules(
    questions: DataFrame, rules: Sequence[AnswerRule] = ANSWER_RULES, column: str = "question"
) -> DataFrame:
    """Question rows with ``rule_no`` and ``rule_place``, best rule first.

    Ranked by how many patterns fire, then confidence, then listing order. The
    rules are part of the expression; nothing is joined.
    """
    text = F.col(column)
    scored = []
    for number, rule in enumerate(rules):
        hits = [text.rlike("(?i)" + p).cast("int") for p in rule.patterns]
        total = sum(hits[1:], hits[0])
        scored.append(
            F.when(
                total > 0,
                F.struct(
                    (-total).alias("hits"),
                    F.lit(-rule.confidence).alias("sure"),
                    F.lit(number).alias("rule_no"),
                ),
            )
        )
    ranked = F.array_sort(F.array_compact(F.array(*scored)))
    return (
        questions.select("*", F.posexplode(ranked).alias("rule_place", "__r"))
        .withColumn("rule_no", F.col("__r.rule_no"))
        .drop("__r")
    )


def rule_rows(events: DataFrame, rule: AnswerRule) -> DataFrame:
    """Candidate rows of one rule, best first (by value name, then time)."""
    kept = events.filter(_applies(rule))
    order = ["ts_epoch", "id"]
    return kept.orderBy(_name_rank(rule), *order) if rule.value_names else kept.orderBy(*order)


def _name_rank(rule: AnswerRule) -> Column:
    names = strings([n.lower() for n in rule.value_names])
    return F.array_position(names, F.lower(or_blank(F.col("data")["name"])))


def _applies(rule: AnswerRule) -> Column:
    test = F.lit(True)
    if rule.event_types:
        test = test & F.col("event_type").isin(*rule.event_types)
    if rule.severity:
        test = test & (F.col("severity") == rule.severity)
    if rule.value_names:
        test = test & (_name_rank(rule) > 0)
    return test


def _value(rule: AnswerRule) -> Column:
    columns = {"@ts": "ts", "@user": "user", "@host": "host", "@message": "message"}
    places = [
        F.nullif(F.col(columns[f]), F.lit("")) if f in columns else entry(F.col("data"), f)
        for f in rule.field
    ]
    shown = FORMATTERS[rule.form](F.coalesce(*places))
    if rule.exclude:
        shown = F.when(~F.lower(F.trim(shown)).isin(*rule.exclude), shown)
    return F.nullif(shown, F.lit(""))


def rule_tallies(
    events: DataFrame,
    rule_numbers: Sequence[int] | None = None,
    rules: Sequence[AnswerRule] = ANSWER_RULES,
) -> DataFrame:
    """(rule_no, answer, n, first row) of every rule, in one pass over the events.

    Each row offers its value to the rules it fits; counting is partial on the
    map side, so a value that fills the table costs one row per task.
    """
    numbers = range(len(rules)) if rule_numbers is None else rule_numbers
    offers = []
    for number in numbers:
        rule = rules[number]
        offers.append(
            F.when(
                _applies(rule),
                F.struct(
                    F.lit(number).alias("rule_no"),
                    _value(rule).alias("answer"),
                    (_name_rank(rule) if rule.value_names else F.lit(0)).cast("long").alias("rank"),
                ),
            )
        )
    offered = F.filter(
        F.array_compact(F.array(*offers)), lambda o: o["answer"].isNotNull()
    )
    rows = events.select(
        "ts_epoch", "id", "ts", "event_type", "source_artifact", F.explode(offered).alias("__o")
    )
    place = F.struct("__o.rank", "ts_epoch", "id", "ts", "event_type", "source_artifact")
    return rows.groupBy(
        F.col("__o.rule_no").alias("rule_no"), F.col("__o.answer").alias("answer")
    ).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))


def rank_answers(
    tallies: DataFrame, limit: int, rules: Sequence[AnswerRule] = ANSWER_RULES
) -> DataFrame:
    """The best ``limit`` answers per rule with label, confidence and place.

    One distinct answer keeps the rule's confidence; each further one takes 12
    percent off, down to 45 percent.
    """
    spread = tallies.groupBy("rule_no").agg(F.count(F.lit(1)).alias("distinct_answers"))

    def per_rule(value: Callable[[AnswerRule], object]) -> Column:
        table = F.create_map(
            *[F.lit(x) for i, rule in enumerate(rules) for x in (i, value(rule))]
        )
        return F.try_element_at(table, F.col("rule_no"))

    prefer = per_rule(lambda r: r.prefer)
    ordinal = (
        F.when(prefer == "most_common", F.struct(
            (-F.col("n")).alias("a"), F.lit(0).cast("long").alias("b"), F.col("answer").alias("c")
        ))
        .when(prefer == "last", F.struct(
            (-F.col("first.ts_epoch")).alias("a"), (-F.col("first.id")).alias("b"),
            F.lit("").alias("c"),
        ))
        .when(prefer == "given", F.struct(
            F.col("first.rank").alias("a"), F.col("first.ts_epoch").alias("b"),
            F.lpad(F.col("first.id").cast("string"), 20, "0").alias("c"),
        ))
        .otherwise(F.struct(
            F.col("first.ts_epoch").alias("a"), F.col("first.id").alias("b"), F.lit("").alias("c")
        ))
    )
    best = Window.partitionBy("rule_no").orderBy("__order")
    top = (
        tallies.withColumn("__order", ordinal)
        .withColumn("answer_place", F.row_number().over(best))
        .filter(F.col("answer_place") <= limit)
        .drop("__order")
    )
    penalty = F.when(F.col("distinct_answers") == 1, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.45), 1.0 - (F.col("distinct_answers") - 1) * F.lit(0.12))
    )
    confidence = F.round(
        F.least(F.lit(0.97), per_rule(lambda r: float(r.confidence)) * penalty), 2
    )
    seen = F.when(
        F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" occurrences)"))
    ).otherwise("")
    return top.join(F.broadcast(spread), "rule_no").select(
        "rule_no", "answer_place", "answer",
        per_rule(lambda r: r.label).alias("label"),
        confidence.alias("confidence"),
        F.col("first.source_artifact").alias("source"),
        F.concat("first.event_type", F.lit(" @ "), "first.ts", seen).alias("why"),
        F.col("first.id").alias("event_id"),
        "n",
    )


def answer_all(
    events: DataFrame,
    questions: DataFrame,
    limit: int = 3,
    column: str = "question",
    rules: Sequence[AnswerRule] = ANSWER_RULES,
) -> DataFrame:
    """Ranked candidates for a table of questions.

    Answers are tallied once per rule, however many questions ask for it. Per
    question the same (label, answer) is kept once, with its best confidence,
    and at most twice ``limit`` candidates are listed.
    """
    asked = match_rules(questions.select(column).distinct(), rules, column)
    ranked = rank_answers(rule_tallies(events, rules=rules), limit, rules)
    # ``ranked`` has at most rules x limit rows, whatever the size of the events.
    pool = asked.join(F.broadcast(ranked), "rule_no")
    place = [F.col("confidence").desc(), "rule_place", "answer_place"]
    once = Window.partitionBy(column, "label", "answer").orderBy(*place)
    unique = pool.withColumn("__n", F.row_number().over(once)).filter(F.col("__n") == 1)
    best = Window.partitionBy(column).orderBy(*place)
    return (
        unique.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= 2 * limit)
        .select(column, "place", "label", "answer", "confidence", "source", "why", "event_id")
    )


def answer(events: DataFrame, question: str, limit: int = 5) -> DataFrame:
    """Ranked candidates for one question."""
    asked = events.sparkSession.createDataFrame([(question,)], "question string")
    return answer_all(events, asked, limit)


def overview(events: DataFrame) -> DataFrame:
    """The facts worth knowing before reading any question, each once."""
    asked = events.sparkSession.createDataFrame(
        [(q,) for q in OVERVIEW_QUESTIONS], "question string"
    )
    found = answer_all(events, asked, limit=2)
    once = Window.partitionBy("label", "answer").orderBy(F.col("confidence").desc(), "question")
    return (
        found.withColumn("__n", F.row_number().over(once))
        .filter(F.col("__n") == 1)
        .drop("__n")
        .orderBy(F.col("confidence").desc(), "label", "answer")
    )


def single_value_answers(
    df: DataFrame,
    value: str,
    at: str,
    order: str,
    confidence: float,
    prefer: str = "first",
    limit: int = 5,
) -> DataFrame:
    """The same ranking for one value column of any table."""
    tallies = (
        df.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
        .groupBy(F.col(value).cast("string").alias("answer"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(at, order)).alias("first"))
    )
    distinct = tallies.agg(F.count(F.lit(1)).alias("d")).scalar()
    by = {
        "most_common": [F.col("n").desc(), F.col("answer")],
        "last": [F.col("first").desc()],
        "first": [F.col("first").asc()],
    }[prefer]
    penalty = F.when(distinct == 1, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.45), 1.0 - (distinct - 1) * F.lit(0.12))
    )
    return (
        tallies.orderBy(*by)
        .limit(limit)
        .select(
            "answer", "n", F.col(f"first.{at}").alias("first_at"),
            F.col(f"first.{order}").alias("first_id"),
            F.round(F.least(F.lit(0.97), F.lit(confidence) * penalty), 2).alias("confidence"),
        )
    )

