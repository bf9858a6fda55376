"""Text, array and map helpers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = " ¦ "


def rx(pattern: str, ignore_case: bool = True) -> str:
    """A Java pattern that reads like the usual scripting-language dialect.

    ``u`` folds case beyond ASCII, ``d`` lets ``.`` match a carriage return.
    """
    return ("(?iud)" if ignore_case else "(?d)") + pattern


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(rx(pattern, ignore_case))


def group(text: Column, pattern: str, index: int = 1, ignore_case: bool = False) -> Column:
    """A capture group, or null when the pattern does not match or is empty."""
    got = F.regexp_extract(text, rx(pattern, ignore_case), index)
    return F.nullif(got, F.lit(""))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    """Whitespace runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def if_any(value: Column) -> Column:
    """A generator that keeps rows where ``value`` is set, worked out once.

    A filter on a computed column makes Spark compute it twice, in the filter
    and in the projection; a generated column is computed once and stays whole.
    """
    return F.explode(F.array_compact(F.array(value)))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _either(words: Sequence[str]) -> str:
    return "|".join(re.escape(word) for word in words)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """One pass over the text for all needles; the text is evaluated once."""
    return text.rlike(_either(needles))


def starts_any(text: Column, prefixes: Sequence[str]) -> Column:
    return text.rlike(f"^(?:{_either(prefixes)})")


def ends_any(text: Column, suffixes: Sequence[str]) -> Column:
    return text.rlike(rf"(?:{_either(suffixes)})\z")


_UNIT = "\u001f"


def strings(values: Sequence[str]) -> Column:
    """A constant array of strings, typed even when empty."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(_UNIT.join(values)), _UNIT)


def literal_map(pairs: Mapping[str, str]) -> Column:
    """A constant map; written as one literal so that plans stay small."""
    return F.from_json(F.lit(json.dumps(dict(pairs))), "map<string,string>")


def lookup(pairs: Mapping[str, str], key: Column) -> Column:
    """Value of ``key`` in a small fixed table, null when absent."""
    return F.try_element_at(literal_map(pairs), key)


def entry(data: Column, *keys: str) -> Column:
    """First non-blank value among ``keys`` of a payload map."""
    return F.coalesce(*[blank_to_null(data[key]) for key in keys])


def put(data: Column, additions: Column) -> Column:
    """``additions`` laid over ``data``; null values are left out.

    A later value of a key wins by the session's map setting, see ``session``.
    """
    return F.map_concat(data, F.map_filter(additions, lambda k, v: v.isNotNull()))


def payload(**fields: Column) -> Column:
    """A string map of the given fields without the null ones."""
    pairs: list[Column] = []
    for name, value in fields.items():
        pairs += [F.lit(name), value.cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def snake(name: Column) -> Column:
    """``TargetUserName`` -> ``target_user_name``."""
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", "_"))


def norm_path(path: Column) -> Column:
    """Unquoted, backslashed, lower-case path."""
    bare = F.regexp_replace(strip_ws(or_blank(path)), '^"+|"+$', "")
    return F.lower(F.translate(bare, "/", "\\"))


def basename(path: Column) -> Column:
    return F.substring_index(norm_path(path), "\\", -1)


def posix(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def file_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def pretty(event_type: Column) -> Column:
    """``service_installed`` -> ``Service installed``; blank -> ``Event``."""
    def shown(words: Column) -> Column:
        first = F.upper(F.substring(words, 1, 1))
        return F.when(words == "", F.lit("Event")).otherwise(
            F.concat(first, words.substr(F.lit(2), F.length(words)))
        )

    return let(F.trim(F.translate(or_blank(event_type), "_", " ")), shown)


def cut(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def capped(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when cut."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))
    )


def summarize_reasons(reasons: Column) -> Column:
    """First four distinct reasons in one field, null when there are none."""
    some = F.array_distinct(F.filter(reasons, lambda r: r.isNotNull() & (r != "")))
    return blank_to_null(F.array_join(F.slice(some, 1, 4), "; "))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)
