"""One case from files to findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.operators.aggregates import artifact_status, diagnostics
from spoorline.operators.context import derive_context
from spoorline.operators.indicators import sweep
from spoorline.operators.normalize import number_artifacts, union_events
from spoorline.operators.rarity import rarity_promote
from spoorline.operators.rulebook import evaluate_book
from spoorline.operators.rules import findings, hit_events, skipped_rules
from spoorline.operators.signatures import signature_files
from spoorline.session import written
from spoorline.sinks.exports import write_events
from spoorline.sources import bodyfile, history, mongod, syslog
from spoorline.sources.bodyfile import bodyfile_events
from spoorline.sources.config import config_events
from spoorline.sources.files import lines_in, numbered, ranges
from spoorline.sources.history import history_events
from spoorline.sources.lines import inventory, route, unreadable
from spoorline.sources.mongod import mongod_events
from spoorline.sources.syslog import syslog_events
from spoorline.sources.text import generic_text_events


@dataclass
class Case:
    artifacts: DataFrame
    events: DataFrame
    context: DataFrame
    findings: DataFrame
    links: DataFrame
    status: DataFrame
    diagnostics: DataFrame
    skipped: DataFrame


# Normalizers of text formats that date themselves, by parser name.
SELF_DATING = {
    "mongodb": mongod_events,
    "bodyfile": bodyfile_events,
    "shell_history": history_events,
    "linux_config": config_events,
    "generic_text": generic_text_events,
}


def analyze(
    spark: SparkSession,
    paths: str | Sequence[str],
    out: str,
    *,
    zone: str | None = None,
    host: str | None = None,
    year: int | None = None,
    rules: Sequence[Mapping] = (),
    signatures: Sequence[Mapping] = (),
    decoded: Sequence[DataFrame] = (),
) -> Case:
    """Read, normalize in two passes, profile, detect and extract; events land at ``out``.

    Files of all names are listed and routed by their first bytes; those of a text format
    are then read once, by ranges, into a table with a folder per parser. What cannot be
    read shows in ``status`` and ``diagnostics`` with its error.

    ``decoded``: event tables made from decoded Windows records or registry
    rows. The context row is the one thing collected: classic logs are read
    only once zone and year are known from everything else.
    """
    artifacts = written(number_artifacts(written(route(inventory(spark, paths)), "inventory")), "artifacts")
    texts = artifacts.where(F.col("error").isNull() & F.col("parser").isin(*SELF_DATING, "linux_syslog"))
    lines = written(
        lines_in(ranges(texts.select("path", "size", "mtime", "artifact_id", "parser"))), "lines", by="parser"
    )

    def of(parser: str) -> DataFrame:
        """The lines of the files that go to a parser: one folder of the table."""
        mine = numbered(lines.filter(F.col("parser") == parser)).where("value IS NOT NULL")
        return mine.select("path", "line_no", "value", "mtime", "artifact_id")

    first = union_events(
        *[build(of(parser), host=host or "") for parser, build in SELF_DATING.items()], *decoded
    )
    write_events(first, f"{out}/first_pass")
    first = spark.read.parquet(f"{out}/first_pass")
    known = derive_context(first, zone=zone, host=host, year=year).first()
    second = syslog_events(
        of("linux_syslog"), host=known["host"], zone=known["zone"], year=known["year"]
    )
    promoted = rarity_promote(union_events(first, second))
    write_events(promoted, f"{out}/events")
    events = spark.read.parquet(f"{out}/events")

    hits = []
    if rules:
        hits.append(hit_events(evaluate_book(events, rules)))
    if signatures:
        hits.append(signature_files(artifacts.where("error IS NULL"), signatures))
    if hits:
        write_events(union_events(*hits), f"{out}/hits")
        found = spark.read.parquet(f"{out}/hits")
    else:
        found = events.filter(F.lit(False))
    whole = union_events(events, found)
    problems = artifacts.where("error IS NOT NULL").select("path", "error").unionByName(unreadable(lines))
    return Case(
        artifacts=artifacts,
        events=whole,
        context=derive_context(first, zone=zone, host=host, year=year),
        findings=findings(found),
        links=sweep(whole),
        status=artifact_status(artifacts.drop("error"), events, problems),
        diagnostics=diagnostics(
            mongod.malformed(of("mongodb")),
            mongod.unauthenticated(of("mongodb")),
            bodyfile.malformed(of("bodyfile")),
            history.untimed(of("shell_history")),
            syslog.year_assumed(of("linux_syslog")),
            problems.select("path", F.col("error").alias("cause"), F.lit(0).cast("long").alias("lines")),
        ),
        skipped=skipped_rules(events, rules),
    )
