"""Every registered query: operators of this package on the driver's tables.

Each takes (spark, folder of the tables) and runs over whole tables. Results are
flat (strings, integers, doubles) so that another engine can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.details import parse_details
from spoorline.functions.paths import is_collector_noise, is_evidence_config, source_label
from spoorline.functions.text import or_blank
from spoorline.operators import aggregates as agg
from spoorline.operators import answers as ans
from spoorline.operators import context as ctx
from spoorline.operators import correlate as cor
from spoorline.operators import filters as flt
from spoorline.operators import indicators as ioc
from spoorline.operators import rarity as rare
from spoorline.operators import rulebook as book
from spoorline.operators import rules as rul
from spoorline.operators import running as run
from spoorline.operators import signatures as sig
from spoorline.operators.normalize import number_artifacts, union_events, with_valid_techniques
from spoorline.operators.textkind import classify_text
from spoorline.plans import derived as d
from spoorline.plans import samples
from spoorline.session import prepare, shared_folder, written
from spoorline.sinks import exports
from spoorline.sources import bodyfile, config, files, history, lines, mongod, registry, syslog, winevents
from spoorline.sources import text as plain
from spoorline.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def runner(spark: SparkSession, sf: str) -> DataFrame:
        return build(prepare(spark), sf)

    runner.__name__ = build.__name__
    runner.__doc__ = build.__doc__
    QUERIES[build.__name__] = runner
    return runner


def _join(name: str, sep: str = " ") -> F.Column:
    return F.concat_ws(sep, name).alias(name)


def _int(name: str) -> F.Column:
    return F.col(name).cast("long").alias(name)


# --- filters, search, order -----------------------------------------------------


@query
def timeline_floor(spark, sf):
    """Events of a time window at or above a level."""
    wanted = flt.EventFilter(
        start=datetime(2024, 1, 5, tzinfo=timezone.utc),
        end=datetime(2024, 1, 25, 12, tzinfo=timezone.utc),
        min_severity="low",
    )
    rows = flt.timeline(d.app_events(spark, sf), wanted)
    return rows.select("id", "ts", "ts_epoch", "severity", _int("sev_rank"), "event_type", "message")


@query
def timeline_latest(spark, sf):
    """The 500 latest events at or above med: the default timeline report."""
    wanted = flt.EventFilter(min_severity="med", limit=500, order="desc")
    return flt.timeline(d.app_events(spark, sf), wanted).select("id", "ts_epoch", "severity")


@query
def where_facets(spark, sf):
    """Exact facets, a source family and a tag together."""
    wanted = flt.EventFilter(source_artifact="app", tag="odd", parser="evtx", severity="high")
    rows = d.app_events(spark, sf).filter(flt.events_where(wanted) & flt.where_source("app/error"))
    return rows.select("id", "host", "user", "channel", _join("tags"), _join("attck"))


@query
def search_substring(spark, sf):
    docs = d.load(spark, sf, "documents")
    return flt.search_like(docs, "example.", ["text", "source"]).select("doc_id")


@query
def search_regex(spark, sf):
    docs = d.load(spark, sf, "documents")
    found = flt.search_regex(docs, r"[a-z0-9.]+@[a-z0-9.]+\.(com|org|net)", ["text", "lang"])
    return found.select("doc_id", "lang")


@query
def search_words(spark, sf):
    """Both words as whole tokens, in any order."""
    docs = d.load(spark, sf, "documents")
    return flt.search_tokens(docs, "the and", ["text"]).select("doc_id")


@query
def search_accents(spark, sf):
    """The same words where every vowel carries marks, and other marks in what is asked."""
    docs = d.load(spark, sf, "documents")
    marked = docs.withColumn("text", F.translate("text", "aeouAEO", "ắễởụẮỄỞ"))
    return flt.search_tokens(marked, "THẾ ánd", ["text"]).select("doc_id")


@query
def search_phrase(spark, sf):
    docs = d.load(spark, sf, "documents")
    return flt.search_tokens(docs, '"of the" re*', ["text"]).select("doc_id")


# --- counts -----------------------------------------------------------------------


@query
def count_events(spark, sf):
    return agg.count_events(d.app_events(spark, sf), flt.EventFilter(min_severity="med"))


@query
def facet_users(spark, sf):
    return agg.facets(d.app_events(spark, sf), "user")


@query
def facet_channels(spark, sf):
    return agg.facets(d.app_events(spark, sf), "channel")


@query
def level_counts(spark, sf):
    return agg.level_counts(d.app_events(spark, sf))


@query
def attck_summary(spark, sf):
    return agg.attck_summary(d.app_events(spark, sf))


@query
def attck_named(spark, sf):
    """Technique counts joined to a techniques dimension (here: the parts table)."""
    names = d.load(spark, sf, "part").select(
        F.format_string("t10%02d", F.col("p_partkey") % 100).alias("technique_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("tactics"),
    ).groupBy("technique_id").agg(F.min("name").alias("name"), F.min("tactics").alias("tactics"))
    return agg.with_technique_names(agg.attck_summary(d.app_events(spark, sf)), names)


@query
def valid_attck(spark, sf):
    """Techniques of the events that a table of techniques knows."""
    known = d.load(spark, sf, "part").select(
        F.format_string("t10%02d", F.col("p_partkey") % 100).alias("technique_id")
    ).distinct()
    return with_valid_techniques(d.app_events(spark, sf), known).select("id", _join("attck"))


@query
def appended_hits(spark, sf):
    """Events and the hits on them in one table, by parser and level."""
    events = d.app_events(spark, sf)
    hits = rul.hit_events(rul.evaluate_rules(events, samples.EVENT_RULES))
    whole = union_events(events, hits)
    return whole.groupBy("parser", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query
def defanged_links(spark, sf):
    """Addresses that were written so that nobody follows them, as what they stand for."""
    k, user = F.col("k").cast("string"), (F.col("user_id") % 10).cast("string")
    lines_ = d.facts(spark, sf).select(
        F.col("event_id").alias("doc_id"),
        F.concat(F.lit("see hxxps://h"), k, F.lit("[.]example[.]net/p"), user, F.lit(" or 198[.]51[.]100[.]"), user).alias("text"),
    )
    rows = ioc.extract_indicators(lines_, "text", ["doc_id"], allowlist=[])
    return rows.select("doc_id", "type", "value", _join("tags"))


@query
def coverage(spark, sf):
    return agg.coverage(d.app_events(spark, sf), limit=6).withColumn(
        "templated_pct", F.round("templated_pct", 6)
    )


@query
def top_unrecognized(spark, sf):
    return agg.top_unrecognized(d.app_events(spark, sf), limit=8)


# --- rarity and bursts ----------------------------------------------------------------


@query
def rare_values(spark, sf):
    rows = rare.process_names(d.process_events(spark, sf)).filter(
        F.col("event_type") == "process_created"
    )
    return rare.rare_values(rows, "image")


@query
def rare_pairs(spark, sf):
    rows = rare.process_names(d.process_events(spark, sf)).filter(
        F.col("event_type") == "process_created"
    )
    return rare.rare_pairs(rows, "parent", "image")


@query
def spawn_bursts(spark, sf):
    rows = rare.process_names(d.process_events(spark, sf)).filter(
        F.col("event_type") == "process_created"
    )
    return rare.spawn_bursts(rows, "parent")


@query
def value_bursts(spark, sf):
    """The same sliding count per user, one hour, whatever the number of days."""
    rows = d.app_events(spark, sf)
    return rare.spawn_bursts(
        rows, "user", min_children=3, window_seconds=3600, max_days=None
    )


@query
def rarity_promote(spark, sf):
    rows = rare.rarity_promote(d.process_events(spark, sf))
    return rows.select(
        "id", "severity", _int("sev_rank"), _join("tags"), or_blank(F.col("data")["why"]).alias("why")
    )


@query
def unknown_binaries(spark, sf):
    """Process events of the second half against the first half as baseline."""
    rows = d.process_events(spark, sf).filter(F.col("event_type") == "process_created")
    split = F.lit(datetime(2024, 1, 16, tzinfo=timezone.utc))
    later, before = rows.filter(F.col("event_time") >= split), rows.filter(F.col("event_time") < split)
    return rare.score_against(later, before).filter("unknown_binary").select("id", "image")


# --- correlation ------------------------------------------------------------------------


@query
def success_after_failure(spark, sf):
    """error = failure, purchase = success, per host and user."""
    rows = cor.success_after_failure(
        d.facts(spark, sf).withColumn("scope", F.col("user_id") % 7),
        scope=["scope"], source="k", account="user_id", order="event_id",
        failed=F.col("event_type") == "error", accepted=F.col("event_type") == "purchase",
        exempt=F.col("value") > 100, chunk=F.floor(F.col("event_id") / 1000).cast("long"),
    )
    return rows.filter(F.col("event_type").isin("error", "purchase")).select(
        "event_id", _int("attempt"), _int("prior_failures"), F.col("cracked").cast("int").alias("cracked")
    )


@query
def flood(spark, sf):
    """Users with at least five events on one day within six hours in all."""
    rows = d.facts(spark, sf).withColumn("day", F.to_date("at").cast("string"))
    return cor.connection_flood(
        rows, keys=["user_id", "day"], at="at", minimum=3, window_seconds=21600
    ).select(
        "user_id", "day", "connections", F.unix_micros("first_time").alias("first_us"),
        F.unix_micros("last_time").alias("last_us"), "window_seconds",
    )


@query
def distinct_time_flags(spark, sf):
    """Per user: first view, purchase, error and signup as m, a, c and b, to the day."""
    rows = d.facts(spark, sf)
    first = lambda kind: F.min(
        F.when(F.col("event_type") == kind, F.date_trunc("day", "at"))
    )
    per_user = rows.groupBy("user_id").agg(
        first("view").alias("m"), first("purchase").alias("a"), first("error").alias("c"),
        first("signup").alias("b"),
    )
    flags = cor.distinct_time_flags(per_user, {"m": "m", "a": "a", "c": "c", "b": "b"})
    return flags.select("user_id", F.col("at").cast("date").cast("string").alias("day"), "flags")


@query
def notable(spark, sf):
    return cor.notable_events(d.app_events(spark, sf), per_type=25, limit=60).select(
        "id", "severity", "event_type", "ts_epoch"
    )


@query
def notable_total(spark, sf):
    return cor.notable_total(d.app_events(spark, sf))


@query
def stream_logins(spark, sf):
    """Logins after failures over files that arrive out of order; what comes too late is left out."""
    folder, like = d.login_arrivals(spark, sf)
    stream = stateful.logins_as_they_come(stateful.arriving(spark, folder, like), "11 days")
    out = shared_folder(spark, "counted")
    stateful.run_to_end(stream, out, shared_folder(spark, "state"))
    return spark.read.parquet(out).filter("source <> 'flush'").select(
        "source", "account", "line_no", "attempt", "prior_failures", F.col("cracked").cast("int").alias("cracked")
    )


@query
def stream_sessions(spark, sf):
    """Bursts of a source over the same arriving files, as sessions without a gap of six hours."""
    folder, like = d.login_arrivals(spark, sf)
    stream = stateful.flood_sessions(
        stateful.arriving(spark, folder, like), keys=["source"], at="event_time", gap="6 hours", minimum=2, delay="11 days"
    )
    out = shared_folder(spark, "sessions")
    stateful.run_to_end(stream, out, shared_folder(spark, "state"))
    return spark.read.parquet(out).select(
        "source", "connections", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us")
    )


@query
def forward_fill(spark, sf):
    """Last and first user turn known at each turn of a conversation."""
    turns = d.load(spark, sf, "conversations")
    said = F.when((F.col("role") == "user") & (F.length("text") > 100), F.length("text"))
    filled = run.running(
        turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 2).cast("long"),
        last_said=run.LastKnown(said), first_said=run.FirstKnown(said),
        chars_before=run.RunningSum(F.length("text")), shortest=run.RunningMin(F.length("text")),
        previous_role=run.Previous(F.col("role")), total_chars=run.GroupTotal(F.length("text")),
    )
    return filled.select(
        "conv_id", "turn", _int("last_said"), _int("first_said"), _int("chars_before"),
        _int("shortest"), "previous_role", _int("total_chars"),
    )


# --- detection ------------------------------------------------------------------------------


@query
def rule_hits(spark, sf):
    """Field, wildcard, list, negation and quantifier rules over the events."""
    hits = rul.evaluate_rules(d.app_events(spark, sf), samples.EVENT_RULES)
    return hits.select("id", "rule", "level", "hit_severity", _join("hit_attck"))


@query
def rule_hits_prefiltered(spark, sf):
    hits = rul.evaluate_rules(d.app_events(spark, sf), samples.EVENT_RULES, use_prefilter=True)
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def rule_cap(spark, sf):
    hits = rul.evaluate_rules(d.app_events(spark, sf), samples.EVENT_RULES)
    return rul.cap_hits(hits, 20).select("rule", _int("hit_no"), "id")


@query
def rule_counts(spark, sf):
    hits = rul.evaluate_rules(d.app_events(spark, sf), samples.EVENT_RULES)
    return rul.hit_counts(hits, 200).withColumn("capped", F.col("capped").cast("int"))


@query
def rule_diagnostics(spark, sf):
    """Every rule: why it is not evaluated, or how many events it matched."""
    events = d.app_events(spark, sf)
    return rul.rule_diagnostics(events, [*samples.EVENT_RULES, *samples.UNUSABLE_RULES], limit=200).select(
        "rule", "cause", "hits", F.col("capped").cast("int").alias("capped")
    )


@query
def rule_corpus(spark, sf):
    """Six hundred unscoped rules, every one evaluated on every event in one scan."""
    hits = rul.evaluate_rules(d.app_events(spark, sf), samples.rule_corpus(600))
    return hits.select("id", "rule")


@query
def rule_corpus_mixed(spark, sf):
    """2,935 rules of nine kinds as data: one pass, and a plan that does not grow with them."""
    hits = book.evaluate_book(d.command_events(spark, sf), samples.mixed_corpus())
    return hits.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("id").alias("ids")
    )


@query
def rule_modifiers(spark, sf):
    """The same kinds, a hundred and eight rules, each as an expression: hits one by one."""
    hits = rul.evaluate_rules(d.command_events(spark, sf), samples.mixed_corpus(108))
    return hits.select("id", "rule", "level")


@query
def rule_text_hits(spark, sf):
    """Keyword rules over whole documents."""
    docs = d.load(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("message"),
        F.concat(F.lit("text/"), "lang").alias("source_artifact"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("data"),
    )
    return rul.evaluate_rules(docs, samples.TEXT_RULES).select("id", "rule")


@query
def findings(spark, sf):
    events = d.app_events(spark, sf)
    hits = rul.hit_events(rul.evaluate_rules(events, samples.EVENT_RULES))
    return rul.findings(hits).groupBy("engine", "rule", "severity", _join("attck")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("detail").alias("matched")
    )


@query
def hit_sources(spark, sf):
    """The events that hits point back at."""
    events = d.app_events(spark, sf)
    hits = rul.hit_events(rul.evaluate_rules(events, samples.EVENT_RULES))
    return rul.matched_events(hits, events).select("id", "event_type")


def bucketed_case(spark, sf, buckets: int = 8) -> tuple[DataFrame, DataFrame]:
    """Hit links and events as tables in buckets of the event's id."""
    events = d.app_events(spark, sf)
    hits = rul.hit_events(rul.evaluate_rules(events, samples.EVENT_RULES))
    run = uuid.uuid4().hex
    links = exports.write_bucketed(exports.hit_links(hits), f"links_{run}", shared_folder(spark, "links"), "matched_id", buckets)
    stored = exports.write_bucketed(events, f"events_{run}", shared_folder(spark, "events"), "id", buckets)
    return links, stored


@query
def linked_events(spark, sf):
    """Events with their hits, from tables in buckets: no exchange in the join or the count."""
    rows = exports.linked_events(*bucketed_case(spark, sf))
    return rows.select("id", "event_type", "hits", _int("worst"))


@query
def signature_hits(spark, sf):
    pages = d.load(spark, sf, "pages")
    return sig.scan_texts(pages, "html", ["page_id"], samples.PAGE_SIGNATURES).select(
        "page_id", "rule", "severity", _join("strings")
    )


@query
def signature_files(spark, sf):
    """The same signatures over file bytes."""
    files = number_artifacts(lines.inventory_of(d.page_files(spark, sf)))
    events = sig.signature_scan(files, samples.PAGE_SIGNATURES)
    return events.select(
        "artifact_path", F.col("data")["rule"].alias("rule"), "severity", "message"
    )


# --- indicators --------------------------------------------------------------------------------


def _document_links(spark, sf):
    docs = d.load(spark, sf, "documents")
    return ioc.extract_indicators(docs, "text", ["doc_id"])


@query
def indicators(spark, sf):
    rows = _document_links(spark, sf).filter(F.col("type") != "ipv6")
    return rows.select("doc_id", "type", "value", _join("tags"))


@query
def indicators_ipv6(spark, sf):
    """IPv6 addresses of the documents and of log lines that name some."""
    lines_ = ioc.extract_indicators(d.address_lines(spark, sf), "text", ["doc_id"])
    rows = _document_links(spark, sf).unionByName(lines_).filter(F.col("type") == "ipv6")
    return rows.select("doc_id", "value", _join("tags"))


@query
def indicator_networks(spark, sf):
    """Addresses of log lines with the narrowest network of the suppliers that holds them."""
    links = ioc.extract_indicators(d.address_lines(spark, sf), "text", ["doc_id"])
    return ioc.tag_networks(links, d.networks(spark, sf), ["doc_id", "value"]).select(
        "doc_id", "type", "value", or_blank(F.col("network")).alias("network")
    )


@query
def indicators_pages(spark, sf):
    """Indicators of whole pages: address and markup."""
    pages = d.load(spark, sf, "pages")
    text = F.concat_ws("\n", "url", "html")
    rows = ioc.extract_indicators(pages, text, ["page_id"])
    return rows.groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def indicator_table(spark, sf):
    """Distinct indicators with their sightings, tags of the first one."""
    links = _document_links(spark, sf).filter(F.col("type") != "ipv6")
    return ioc.get_iocs(links, order="doc_id").select("type", "value", "n", _join("tags"))


@query
def indicator_counts(spark, sf):
    return ioc.ioc_counts(_document_links(spark, sf).filter(F.col("type") != "ipv6"))


@query
def indicator_allowlist(spark, sf):
    """Allowlist tags from a table: the registered domains of the pages."""
    links = ioc.extract_indicators(d.load(spark, sf, "pages"), "url", ["page_id"], allowlist=[])
    listed = d.load(spark, sf, "pages").filter(F.col("url").contains("example.com")).select(
        F.concat(F.lit("."), F.regexp_extract("url", r"example\.com", 0)).alias("entry")
    )
    return ioc.tag_from_table(links, listed, ["page_id", "value"]).select(
        "page_id", "type", "value", _join("tags")
    )


@query
def indicator_sweep(spark, sf):
    """Links of the authentication events, one per event and indicator."""
    events = syslog.syslog_events(d.syslog_lines(spark, sf))
    links = ioc.sweep(events)
    return links.filter(F.col("type") == "ipv4").groupBy("value").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"),
        F.concat_ws(" ", F.min("tags")).alias("tags"),
    )


@query
def events_mentioning(spark, sf):
    events = syslog.syslog_events(d.syslog_lines(spark, sf))
    found = ioc.events_mentioning(events, ioc.sweep(events), "ipv4", "10.0.1.5")
    return found.select("id", "event_type")


# --- text ----------------------------------------------------------------------------------------


@query
def classify_documents(spark, sf):
    docs = d.load(spark, sf, "documents")
    name = F.concat(F.col("source"), F.lit(".txt"))
    return docs.select("doc_id", classify_text(name, F.col("text")).alias("c")).select(
        "doc_id", "c.kind", "c.label", "c.severity"
    )


@query
def document_artifacts(spark, sf):
    """Documents as untimed files: rows of about 16 KB that hold all their lines."""
    events = plain.generic_text_events(d.document_lines(spark, sf))
    return events.filter(F.col("event_type") == "text_artifact").select(
        F.col("data")["block"].cast("long").alias("block"),
        F.regexp_extract("artifact_path", r"(\d+)\.txt", 1).cast("long").alias("doc_id"),
        "severity", "title", F.length("raw").cast("long").alias("raw_chars"),
        F.col("data")["lines"].cast("long").alias("lines"), F.sha2("raw", 256).alias("raw_sha"),
    )


@query
def web_log_lines(spark, sf):
    events = plain.generic_text_events(d.web_lines(spark, sf), zone="+02:00")
    return events.filter(F.col("event_type") == "log_line").select(
        "id", "ts", "source_artifact", "event_type", "title", "details",
        or_blank(F.col("data")["why"]).alias("why"), _join("tags"),
    )


@query
def untimed_lines(spark, sf):
    """Lines without a time in files that have some: none is lost, and search finds them."""
    events = plain.generic_text_events(d.web_lines(spark, sf), zone="+02:00")
    rest = flt.search_regex(events.filter(F.col("event_type") == "text_artifact"), "-- note [0-9]+ --", ["raw"])
    lines_ = rest.select("artifact_path", F.explode(F.split("raw", "\n")).alias("line"))
    return lines_.groupBy("artifact_path", "line").agg(F.count(F.lit(1)).alias("n"))


@query
def questions(spark, sf):
    """Question lines of whole documents, in order, each once."""
    docs = d.load(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.regexp_replace("text", r"\. ", "?\n").alias("text"),
    )
    found = plain.questions_table(docs)
    return found.select(F.col("path").alias("doc_id"), _int("position"), "question")


# --- normalizers --------------------------------------------------------------------------------


@query
def syslog_events(spark, sf):
    events = syslog.syslog_events(d.syslog_lines(spark, sf))
    x = F.col("data")
    return events.select(
        "id", "ts", "ts_desc", "host", "user", "event_type", "severity", "message",
        _join("tags"), _join("attck"), or_blank(x["source_ip"]).alias("source_ip"),
        or_blank(x["attempt"]).alias("attempt"), or_blank(x["prior_failures"]).alias("prior_failures"),
        or_blank(x["cmd"]).alias("cmd"),
    )


@query
def brute_force_logins(spark, sf):
    """Logins that succeeded after failures, in time order."""
    events = syslog.syslog_events(d.syslog_lines(spark, sf))
    rows = events.filter(flt.where_tag("brute_force_success"))
    return flt.in_order(rows).select("id", "ts", "user", "host", "message")


@query
def mongod_events(spark, sf):
    events = mongod.mongod_events(d.mongod_lines(spark, sf))
    return events.filter(F.col("event_type") != "db_connection_flood").select(
        "id", "ts_epoch", "host", "event_type", "severity", "title", "details", "channel",
        or_blank(F.col("data")["source_ip"]).alias("source_ip"),
    )


@query
def mongod_nested(spark, sf):
    """A numeric attribute two levels down, with its own type, next to one above it."""
    records = mongod.read_records(d.mongod_lines(spark, sf))
    deep = mongod.attribute("uuid.a", "long")
    return records.where(deep.isNotNull()).groupBy("path", deep.alias("a")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(mongod.attribute("connectionId", "long")).alias("ids"),
        F.count(mongod.attribute("remote", "long")).alias("not_numbers"),
    )


@query
def mongod_floods(spark, sf):
    records = mongod.read_mongod(d.mongod_lines(spark, sf)).filter(F.col("event_time").isNotNull())
    return mongod.mongod_floods(records, minimum=40).select(
        "path", "source_ip", "connections", "window_seconds", "rate_per_second",
        F.unix_micros("first_time").alias("first_us"),
    )


@query
def bodyfile_events(spark, sf):
    events = bodyfile.bodyfile_events(d.body_lines(spark, sf))
    return events.filter(F.col("event_type") == "file_timestamp").select(
        "ts_epoch", "ts_desc", "title", "severity", _join("tags"), "details",
        or_blank(F.col("data")["why"]).alias("why"),
    )


@query
def bodyfile_summary(spark, sf):
    rows = bodyfile.bodyfile_summary(bodyfile.scored_entries(d.body_lines(spark, sf)))
    return rows.select(
        "path", "entries", "events", "notable",
        F.unix_seconds("earliest").alias("earliest"), F.unix_seconds("latest").alias("latest"),
    )


@query
def history_events(spark, sf):
    events = history.history_events(d.history_lines(spark, sf))
    return events.select(
        "id", "ts", "user", "severity", "title", "ts_desc", "details", _join("attck"), _join("tags"),
        or_blank(F.col("data")["why"]).alias("why"), "source_artifact",
    )


def _flat_findings(rows: DataFrame) -> DataFrame:
    f = "finding"
    return rows.select(
        "path", f"{f}.event_type", f"{f}.severity", f"{f}.title", f"{f}.details", f"{f}.why",
        F.concat_ws(" ", f"{f}.attck").alias("attck"),
    )


@query
def config_accounts(spark, sf):
    return _flat_findings(config.config_findings_by_line(d.config_lines(spark, sf, "accounts")))


@query
def config_sshd(spark, sf):
    return _flat_findings(config.sshd_findings(d.config_lines(spark, sf, "sshd")))


@query
def config_preload(spark, sf):
    return _flat_findings(config.preload_findings(d.config_lines(spark, sf, "preload")))


@query
def config_services(spark, sf):
    return _flat_findings(config.service_findings(d.config_lines(spark, sf, "service")))


@query
def config_events(spark, sf):
    """All findings as events, by type and level."""
    lines_ = d.config_lines(spark, sf, "preload", "service")
    events = config.config_events(lines_)
    return events.groupBy("event_type", "severity", _join("tags")).agg(F.count(F.lit(1)).alias("n"))


@query
def windows_events(spark, sf):
    events = winevents.winevent_events(winevents.read_winevents(d.windows_records(spark, sf)))
    x = F.col("data")
    return events.select(
        "id", "ts_epoch", "event_type", "severity", "host", "user", "channel", "record_id",
        _join("tags"), _join("attck"), or_blank(x["why"]).alias("why"), "details",
        or_blank(x["ip_address"]).alias("ip_address"), or_blank(x["md5"]).alias("md5"),
        "title", "source_artifact",
    )


@query
def windows_templates(spark, sf):
    """The same records with a template table: titles, labels and what is left over."""
    templates = spark.createDataFrame(
        samples.TEMPLATES,
        "provider string, event_id string, title string, level string, "
        f"fields {winevents.TEMPLATE_FIELDS}, attck array<string>",
    )
    events = winevents.winevent_events(d.windows_records(spark, sf), templates)
    return events.filter(F.col("event_type") == "logon_failed").select(
        "id", "title", "details", "extra_fields", _join("tags")
    )


@query
def detail_labels(spark, sf):
    """Labels read back from the details column."""
    events = winevents.winevent_events(d.windows_records(spark, sf))
    return events.select(F.explode(parse_details(F.col("details")))).groupBy(
        F.col("key").alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def registry_events(spark, sf):
    events = registry.registry_events(d.registry_values(spark, sf))
    x = F.col("data")
    return events.filter(F.col("event_type") != "registry_hive").select(
        "id", "ts", "event_type", "severity", "message", _join("tags"), _join("attck"),
        "source_artifact", or_blank(x["why"]).alias("why"),
        or_blank(x["utc_offset"]).alias("utc_offset"), or_blank(x["sha1"]).alias("sha1"),
    )


@query
def registry_hives(spark, sf):
    events = registry.registry_events(d.registry_values(spark, sf))
    return events.filter(F.col("event_type") == "registry_hive").select(
        "artifact_path", "ts", "message"
    )


@query
def diagnostics(spark, sf):
    """What each reader could not use, per file."""
    return agg.diagnostics(
        mongod.malformed(d.mongod_lines(spark, sf)),
        mongod.unauthenticated(d.mongod_lines(spark, sf)),
        bodyfile.malformed(d.body_lines(spark, sf)),
        history.untimed(d.history_lines(spark, sf)),
        syslog.year_assumed(d.syslog_lines(spark, sf)),
    )


# --- files --------------------------------------------------------------------------------------


def _artifacts(spark, sf) -> DataFrame:
    return number_artifacts(lines.route(lines.inventory_of(d.page_files(spark, sf)))).drop(
        "content", "header"
    )


@query
def inventory(spark, sf):
    rows = lines.inventory_of(d.page_files(spark, sf))
    return rows.select("path", "sha256", "kind", "size")


@query
def route(spark, sf):
    return _artifacts(spark, sf).select(
        "path", or_blank(F.col("parser")).alias("parser"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


@query
def artifact_numbers(spark, sf):
    """File numbers are dense and unique."""
    return _artifacts(spark, sf).agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("artifact_id").alias("ids"),
        F.min("artifact_id").alias("first_id"), F.max("artifact_id").alias("last_id"),
    )


@query
def path_noise(spark, sf):
    files = d.page_files(spark, sf).select("path")
    return files.select(
        "path", is_collector_noise(F.col("path")).cast("int").alias("noise"),
        is_evidence_config(F.col("path")).cast("int").alias("evidence"),
        source_label(F.col("path")).alias("label"),
    )


def _status(spark, sf) -> DataFrame:
    files = _artifacts(spark, sf)
    events = files.filter(F.col("parser").isNotNull()).select(
        "artifact_id", F.explode(F.sequence(F.lit(1), F.col("size") % 3 + 1)).alias("n")
    )
    return agg.artifact_status(files, events)


@query
def artifact_status(spark, sf):
    return _status(spark, sf).select("path", "status", "event_count")


@query
def not_parsed_by_type(spark, sf):
    return agg.not_parsed_by_type(_status(spark, sf)).select("extension", "files", "largest")


@query
def sweepings(spark, sf):
    return agg.sweepings(_status(spark, sf))


@query
def largest_unparsed(spark, sf):
    return agg.largest_unparsed(_status(spark, sf), over=1000).select("name", "size", "status")


@query
def top_artifacts(spark, sf):
    return agg.top_artifacts(_status(spark, sf), limit=20).select("path", "event_count")


@query
def event_files(spark, sf):
    """Events joined to the file they came from."""
    files = _artifacts(spark, sf)
    events = files.select(F.col("artifact_id"), F.lit("e").alias("event_type"))
    return agg.events_with_artifacts(events, files).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )


@query
def case_summary(spark, sf):
    events = d.app_events(spark, sf)
    hits = rul.hit_events(rul.evaluate_rules(events, samples.EVENT_RULES))
    iocs = ioc.get_iocs(
        _document_links(spark, sf).filter(F.col("type") != "ipv6"), order="doc_id"
    )
    return agg.case_summary(_status(spark, sf), events, rul.findings(hits), iocs)


@query
def dotfile_history(spark, sf):
    """Shell histories as real files with hidden names, found and read by ranges."""
    folder, _ = d.stored_history(spark, sf)
    read = lines.read_lines(spark, folder)
    events = history.history_events(read.withColumn("path", files.case_path(F.col("path"), folder)))
    return events.select(
        "artifact_path", "user", "severity", "title", "details", _join("attck"), _join("tags"),
        F.when(F.col("ts_desc") == "Command run", F.col("ts")).otherwise("").alias("ts"),
    )


@query
def stored_inventory(spark, sf):
    """Files listed, digested and routed without a row that holds one."""
    folder, _ = d.stored_files(spark, sf)
    rows = lines.route(lines.inventory(spark, folder))
    return rows.select(
        files.case_path(F.col("path"), folder).alias("path"), "sha256", "kind", "size",
        or_blank(F.col("parser")).alias("parser"),
    )


@query
def signature_chunks(spark, sf):
    """Signatures over the same files in chunks of 4 KB, strings over an edge included."""
    folder, _ = d.stored_files(spark, sf)
    hits = sig.scan_files(
        files.list_files(spark, folder).where("error IS NULL").select("path", "size"),
        samples.PAGE_SIGNATURES, 4096,
    )
    return hits.select(
        files.case_path(F.col("path"), folder).alias("path"), "rule", "severity", _join("strings")
    )


@query
def artifact_errors(spark, sf):
    """Files that cannot be unpacked: their status says so, and the rest is read."""
    folder, _ = d.stored_notes(spark, sf)
    found = number_artifacts(written(lines.route(lines.inventory(spark, folder)).drop("header"), "inventory"))
    texts = found.where("error IS NULL AND parser IS NOT NULL").select("path", "size", "artifact_id")
    read = files.read_table(files.ranges(texts))
    status = agg.artifact_status(found.drop("error"), read.where("value IS NOT NULL"), lines.unreadable(read))
    return status.select(
        files.case_path(F.col("path"), folder).alias("path"), "status", "event_count",
        or_blank(F.substring_index("error", ":", 1)).alias("error"),
    )


# --- context and answers ---------------------------------------------------------------------


@query
def activity_window(spark, sf):
    rows = ctx.activity_window(d.app_events(spark, sf))
    return rows.select(
        F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), _int("year"),
        "year_source",
    )


@query
def case_year(spark, sf):
    """The year for classic log lines: logged times decide, file times of later years do not."""
    late = F.lit("2031-05-06 07:08:09").cast("timestamp")
    events = union_events(
        config.config_events(d.config_lines(spark, sf, "accounts", "sshd").withColumn("mtime", late)),
        plain.generic_text_events(d.web_lines(spark, sf).withColumn("mtime", late), zone="+02:00"),
        history.history_events(d.history_lines(spark, sf).filter("value not like '#%' and value not like ': %'")
                               .withColumn("mtime", late)),
        syslog.syslog_events(d.syslog_lines(spark, sf).withColumn("mtime", late)),
    )
    rows = ctx.activity_window(events)
    return rows.select(
        F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), _int("year"), "year_source",
    )


@query
def case_context(spark, sf):
    rows = ctx.derive_context(registry.registry_events(d.registry_values(spark, sf)))
    return rows.select(
        "zone", "zone_source", "host", "host_source", _int("year"), "year_source",
        F.size("notes").alias("notes"),
    )


@query
def most_common_host(spark, sf):
    return ctx.most_common_host(d.app_events(spark, sf))


@query
def answers(spark, sf):
    """Candidate answers for one fact, most common first."""
    rows = d.facts(spark, sf)
    return ans.single_value_answers(
        rows.withColumn("us", F.unix_micros("at")), "k", "us", "event_id", 0.8, "most_common"
    )


@query
def answers_first(spark, sf):
    rows = d.facts(spark, sf).withColumn("us", F.unix_micros("at"))
    return ans.single_value_answers(rows, "event_type", "us", "event_id", 0.6, "first")


@query
def case_answers(spark, sf):
    """The investigation's questions against the authentication events."""
    events = syslog.syslog_events(d.syslog_lines(spark, sf))
    asked = spark.createDataFrame([(q,) for q in samples.QUESTIONS], "question string")
    return ans.answer_all(events, asked, limit=3).withColumn("place", F.col("place").cast("long"))


@query
def case_overview(spark, sf):
    events = syslog.syslog_events(d.syslog_lines(spark, sf))
    return ans.overview(events).select("label", "answer", "confidence")


# --- exports ------------------------------------------------------------------------------------


@query
def timeline_rows(spark, sf):
    return exports.timeline_rows(d.app_events(spark, sf))


@query
def written_events(spark, sf):
    """A case written, its later days replaced, read back: counts by day, and how the files lie."""
    events = d.app_events(spark, sf)
    folder = shared_folder(spark, "case")
    exports.write_events(events, folder)
    later = F.col("event_date") >= F.lit("2024-01-16").cast("date")
    exports.write_days(events.where(later).withColumn("title", F.upper("title")), folder)
    stored = spark.read.parquet(folder).withColumn("file", F.input_file_name())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored.groupBy(F.col("event_date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"),
        F.count_if(F.col("title") == F.upper("title")).alias("replaced"),
        F.min("ts_epoch").alias("first_us"), F.max("ts_epoch").alias("last_us"),
        (F.count_distinct("file") <= tasks).cast("int").alias("few_files"),
    )


@query
def exported_json(spark, sf):
    """The JSON Lines export, read back."""
    folder = shared_folder(spark, "jsonl")
    exports.export(d.app_events(spark, sf), folder, "jsonl")
    back = spark.read.json(folder)
    return back.select(F.col("id").cast("long").alias("id"), "ts", "event_type", "severity", "message")


@query
def triage_rows(spark, sf):
    return exports.triage_rows(d.app_events(spark, sf)).select("Id", "Level", "Title", "Details")


@query
def timesketch_rows(spark, sf):
    return exports.timesketch_rows(d.app_events(spark, sf))


@query
def l2t_rows(spark, sf):
    return exports.l2t_rows(d.app_events(spark, sf)).drop("extra")


# --- ids ------------------------------------------------------------------------------------------


@query
def event_ids(spark, sf):
    """The events of all normalizers in one table: every id once, though line numbers repeat."""
    events = union_events(
        syslog.syslog_events(d.syslog_lines(spark, sf)),
        mongod.mongod_events(d.mongod_lines(spark, sf)),
        history.history_events(d.history_lines(spark, sf)),
        winevents.winevent_events(d.windows_records(spark, sf)),
        registry.registry_events(d.registry_values(spark, sf)),
        plain.generic_text_events(d.web_lines(spark, sf), zone="+02:00"),
    ).filter(~F.col("event_type").isin("db_connection_flood", "registry_hive"))
    return events.agg(
        F.lit("all").alias("part"), F.count(F.lit(1)).alias("events"), F.count_distinct("id").alias("ids")
    )


@query
def rarity_of_records(spark, sf):
    """Rarity straight on the normalizer of records: no row is lost or doubled."""
    events = rare.rarity_promote(
        winevents.winevent_events(winevents.read_winevents(d.windows_records(spark, sf)))
    )
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("id").alias("ids")
    )
