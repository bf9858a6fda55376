"""Filters, text search and the ordered timeline."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import lru_cache, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.text import any_of, or_blank, rx
from spoorline.schema import LEVEL_RANK

SEARCHED = ("message", "extra_fields", "raw")


@dataclass(frozen=True)
class EventFilter:
    """What a timeline query may ask for; an empty field asks for nothing."""

    start: datetime | None = None
    end: datetime | None = None
    host: str | None = None
    user: str | None = None
    event_type: str | None = None
    source_artifact: str | None = None
    parser: str | None = None
    severity: str | None = None
    min_severity: str | None = None
    tag: str | None = None
    limit: int = 0
    order: str = "asc"


def where_time(
    start: datetime | None,
    end: datetime | None,
    column: str = "event_time",
    day: str | None = None,
) -> Column:
    """Both ends inclusive. Tested on the timestamp, so it reaches the scan.

    ``day``: the date column a written table is partitioned by; its bounds leave out
    the partitions of other days.
    """
    tests = []
    if start is not None:
        tests.append(F.col(column) >= F.lit(start))
        if day:
            tests.append(F.col(day) >= F.to_date(F.lit(start)))
    if end is not None:
        tests.append(F.col(column) <= F.lit(end))
        if day:
            tests.append(F.col(day) <= F.to_date(F.lit(end)))
    return reduce(and_, tests, F.lit(True))


def where_facet(**facets: str | None) -> Column:
    return reduce(
        and_, [F.col(name) == value for name, value in facets.items() if value], F.lit(True)
    )


def where_source(source: str, column: str = "source_artifact") -> Column:
    """The source itself or anything below it."""
    return (F.col(column) == source) | F.col(column).startswith(f"{source}/")


def where_min_severity(level: str, column: str = "sev_rank") -> Column:
    return F.col(column) >= LEVEL_RANK.get(level, 0)


def where_tag(tag: str, column: str = "tags") -> Column:
    return F.array_contains(F.col(column), tag)


def events_where(wanted: EventFilter, day: str | None = None) -> Column:
    """One predicate for all of a filter. Values are bound literals, never SQL text."""
    tests = [
        where_facet(
            host=wanted.host,
            user=wanted.user,
            event_type=wanted.event_type,
            parser=wanted.parser,
            severity=wanted.severity,
        )
    ]
    if wanted.start is not None or wanted.end is not None:
        tests.append(where_time(wanted.start, wanted.end, day=day))
    if wanted.source_artifact:
        tests.append(where_source(wanted.source_artifact))
    if wanted.min_severity:
        tests.append(where_min_severity(wanted.min_severity))
    if wanted.tag:
        tests.append(where_tag(wanted.tag))
    return reduce(and_, tests)


def _day(events: DataFrame) -> str | None:
    return "event_date" if "event_date" in events.columns else None


def in_order(
    events: DataFrame,
    order: str = "asc",
    limit: int = 0,
    by: Sequence[str] = ("ts_epoch", "id"),
) -> DataFrame:
    """Canonical order; with a limit each task keeps only its best rows."""
    keys = [F.col(c).desc() if order.lower() == "desc" else F.col(c).asc() for c in by]
    ordered = events.orderBy(*keys)
    return ordered.limit(limit) if limit else ordered


def timeline(events: DataFrame, wanted: EventFilter = EventFilter()) -> DataFrame:
    return in_order(events.filter(events_where(wanted, _day(events))), wanted.order, wanted.limit)


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """All lower-case letters of the basic plane that are a letter and marks, and those letters.

    From the decompositions of the Unicode character data; three stroked letters, which have
    none there, count as their base as well.
    """
    pairs = {"đ": "d", "ł": "l", "ø": "o"}
    for code in (*range(0xC0, 0xD800), *range(0xF900, 0x10000)):
        letter = chr(code)
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and letter == letter.lower() and base.isalpha() and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs[letter] = base
    return "".join(pairs), "".join(pairs.values())


def folded(text: Column) -> Column:
    """Lower case without accents, every run of other characters one blank."""
    bare = F.regexp_replace(F.translate(F.lower(or_blank(text)), *accents()), r"[\u0300-\u036f]+", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


_QUERY_PARTS = re.compile(r'"([^"]*)"|(\S+)')


def search_tokens(events: DataFrame, text: str, columns: Sequence[str] = SEARCHED) -> DataFrame:
    """Rows holding every term: words, ``"phrases"`` and ``prefix*``.

    A query without a usable term falls back to :func:`search_like`.
    """
    parts: list[str] = []
    for phrase, word in _QUERY_PARTS.findall(text):
        parts.append(phrase or word)
    terms = [
        (" ".join(re.findall(r"[^\W_]+", part.lower())), part.endswith("*")) for part in parts
    ]
    terms = [(term, prefix) for term, prefix in terms if term]
    if not terms or text.count('"') % 2:
        return search_like(events, text, columns)

    def hit(column: str, term: str, prefix: bool) -> Column:
        padded = F.concat(F.lit(" "), folded(F.col(column)), F.lit(" "))
        needle = folded(F.lit(term))
        tail = F.lit("") if prefix else F.lit(" ")
        return padded.contains(F.concat(F.lit(" "), needle, tail))

    wanted = [any_of([hit(c, term, prefix) for c in columns]) for term, prefix in terms]
    return events.filter(reduce(and_, wanted))


def search_like(events: DataFrame, text: str, columns: Sequence[str] = SEARCHED) -> DataFrame:
    """Case-insensitive substring; ``%`` and ``_`` are ordinary characters."""
    needle = F.lower(F.lit(text))
    return events.filter(any_of([F.lower(F.col(c)).contains(needle) for c in columns]))


def search_regex(
    events: DataFrame, pattern: str, columns: Sequence[str] = ("message", "data", "raw")
) -> DataFrame:
    """Pattern over the joined text of a row, case ignored; a bad one is an error."""
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"bad regex {pattern!r}: {error}") from error
    kinds = dict(events.dtypes)
    parts = [
        F.to_json(F.col(c)) if kinds[c].startswith("map") else F.col(c).cast("string")
        for c in columns
    ]
    return events.filter(F.concat_ws("\n", *parts).rlike(rx(pattern)))


def search(
    events: DataFrame, text: str, wanted: EventFilter = EventFilter(), regex: bool = False
) -> DataFrame:
    """Text search within a filter, in time order; all rows unless a limit is given."""
    kept = events.filter(events_where(wanted, _day(events)))
    found = search_regex(kept, text) if regex else search_tokens(kept, text)
    return in_order(found, wanted.order if regex else "asc", wanted.limit)
