"""String signatures over whole file contents.

A signature is a mapping: ``name``, ``severity``, ``attck``, ``strings`` (id to
a text or ``{"text"|"regex": …, "nocase": bool, "fullword": bool}``) and a
``condition`` over string ids with and / or / not, ``any of``, ``all of`` and
``N of`` (``them``, a list in brackets, or a name with ``*``).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.text import cut, file_name, payload, strings
from spoorline.operators.normalize import normalize, wide_id
from spoorline.operators.rules import UnusableRule, _names_like, condition_tree, fold_condition
from spoorline.schema import SCAN_TIME
from spoorline.sources.files import chunks_in, ranges

PARSER = "yara"
# Level of a signature and the level of its hits.
HIT_LEVEL = {"critical": "high", "high": "high", "medium": "med", "low": "info"}


# Bytes of a chunk; a string without a longest match needs the file in one piece of at most
# WHOLE_BYTES, the most one value can hold.
CHUNK_BYTES, WHOLE_BYTES = 8 << 20, (1 << 31) - (1 << 20)


def string_test(
    spec: str | Mapping,
    text: Column,
    lowered: Column,
    begins: Column | None = None,
    ends: Column | None = None,
) -> Column:
    """Is the string anywhere in the content?

    ``begins``, ``ends``: whether the content starts and ends where its file does. A whole
    word has to show what stands beside it, unless the file's own edge is there.
    """
    spec = {"text": spec} if isinstance(spec, str) else spec
    nocase, whole = bool(spec.get("nocase")), bool(spec.get("fullword"))
    flag = "(?i)" if nocase else ""
    if whole:
        body = spec["regex"] if "regex" in spec else re.escape(spec["text"])
        found = None
        for at_start, left in ((True, "(?<![A-Za-z0-9])"), (False, "(?<=[^A-Za-z0-9])")):
            for at_end, right in ((True, "(?![A-Za-z0-9])"), (False, "(?=[^A-Za-z0-9])")):
                test = text.rlike(f"{flag}{left}(?:{body}){right}")
                if begins is None or ends is None:
                    return test
                here = (begins == at_start) & (ends == at_end)
                found = F.when(here, test) if found is None else found.when(here, test)
        return found
    if "regex" in spec:
        return text.rlike(flag + spec["regex"])
    needle = spec["text"]
    return lowered.contains(needle.lower()) if nocase else text.contains(needle)


def longest_match(spec: str | Mapping) -> int | None:
    """Bytes of the longest match; None for a pattern without one, or that looks around itself."""
    spec = {"text": spec} if isinstance(spec, str) else spec
    if "regex" not in spec:
        return len(spec["text"].encode("latin-1", "replace"))
    if re.search(r"[*+^$]|\{\d*,\}|\\[AbBGzZ1-9kpPQRX]|\(\?", spec["regex"]):
        return None
    repeats = [int(n) for n in re.findall(r"\{(?:\d+,)?(\d+)\}", spec["regex"])]
    longest = len(spec["regex"])
    for n in repeats:
        longest *= max(n, 1)
    return longest if longest <= CHUNK_BYTES else None


def compile_signature(signature: Mapping, text: Column, lowered: Column) -> Column:
    return signature_condition(
        signature,
        {
            name.lstrip("$"): string_test(spec, text, lowered)
            for name, spec in signature["strings"].items()
        },
    )


def signature_condition(signature: Mapping, tests: Mapping[str, Column]) -> Column:
    """The signature's condition over the outcome for each of its strings."""
    names = list(tests)
    extra: dict[str, Column] = {}

    def counted(match: re.Match) -> str:
        quantity, target = match[1].lower(), match[2]
        if target.startswith("("):
            chosen = [n for part in target.strip("()").split(",")
                      for n in _names_like(part.strip().lstrip("$"), names)]
        else:
            chosen = _names_like(target.lstrip("$"), names)
        if not chosen:
            raise UnusableRule(f"condition {signature['condition']!r}")
        wanted = {"any": 1, "all": len(chosen)}.get(quantity) or int(quantity)
        total = sum((tests[n].cast("int") for n in chosen[1:]), tests[chosen[0]].cast("int"))
        key = f"counted{len(extra)}"
        extra[key] = total >= wanted
        return f" {key} "

    text_form = re.sub(
        r"\b(any|all|\d+)\s+of\s+(\([^()]*\)|[$\w*]+)", counted, signature["condition"]
    ).replace("$", "")
    named = {**tests, **extra}
    order = list(named)
    return fold_condition(condition_tree(text_form, order), lambda i: named[order[i]])


def scan_texts(
    df: DataFrame, text: str, keys: Sequence[str], signatures: Sequence[Mapping]
) -> DataFrame:
    """``keys`` plus (rule, severity, attck, strings) for every signature that fits.

    ``strings`` lists the ids found. Each content is read whole, in one pass.
    """
    prepared = df.select(*keys, F.col(text).alias("__t")).withColumn("__l", F.lower("__t"))
    t, lowered = F.col("__t"), F.col("__l")
    hits = []
    for signature in signatures:
        found = F.array_compact(
            F.array(
                *[
                    F.when(string_test(spec, t, lowered), F.lit(name.lstrip("$")))
                    for name, spec in signature["strings"].items()
                ]
            )
        )
        level = HIT_LEVEL.get(str(signature.get("severity", "")).lower(), "high")
        hits.append(
            F.when(
                compile_signature(signature, t, lowered),
                F.struct(
                    F.lit(signature["name"]).alias("rule"),
                    F.lit(level).alias("severity"),
                    strings(signature.get("attck", ())).alias("attck"),
                    found.alias("strings"),
                ),
            )
        )
    return prepared.select(
        *keys, F.explode(F.array_compact(F.array(*hits))).alias("__h")
    ).select(*keys, "__h.*")


def scan_files(
    files: DataFrame, signatures: Sequence[Mapping], size: int = CHUNK_BYTES
) -> DataFrame:
    """Columns of ``files`` (path, size, …) plus (rule, severity, attck, strings) for each hit.

    Tasks read chunks that overlap by the longest string, so no row holds a file and a string
    over an edge is seen; what the chunks of a file found is put together by its path, and the
    condition is read over that. Only strings without a longest match, or that look around
    themselves, are looked for in whole files. ``files`` has one row per path.
    """
    listed = [
        (number, name.lstrip("$"), spec)
        for number, signature in enumerate(signatures)
        for name, spec in signature["strings"].items()
    ]
    spans = [longest_match(spec) for _, _, spec in listed]
    parts = []
    for chosen, step, overlap in (
        ([i for i, s in enumerate(spans) if s is not None], size, max([s for s in spans if s] or [0]) + 1),
        ([i for i, s in enumerate(spans) if s is None], WHOLE_BYTES, 0),
    ):
        if not chosen:
            continue
        spots = ranges(files.select("path", "size"), step)
        chunks = chunks_in(spots, overlap, step).where("content IS NOT NULL").select(
            "path",
            (F.col("start") == 0).alias("__begins"),
            (F.col("start") + step + overlap >= F.col("size")).alias("__ends"),
            F.decode("content", "ISO-8859-1").alias("__t"),
        ).withColumn("__l", F.lower("__t"))
        found = F.array_compact(F.array(*[
            F.when(string_test(listed[i][2], F.col("__t"), F.col("__l"), F.col("__begins"), F.col("__ends")), F.lit(i))
            for i in chosen
        ]))
        parts.append(chunks.select("path", F.explode(found).alias("string_no")))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    seen = whole.groupBy("path").agg(F.collect_set("string_no").alias("seen"))
    rows = files.join(seen, "path", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))
    hits = []
    for number, signature in enumerate(signatures):
        own = {name: i for i, (n, name, _) in enumerate(listed) if n == number}
        tests = {name: F.array_contains("seen", i) for name, i in own.items()}
        level = HIT_LEVEL.get(str(signature.get("severity", "")).lower(), "high")
        hits.append(F.when(signature_condition(signature, tests), F.struct(
            F.lit(signature["name"]).alias("rule"),
            F.lit(level).alias("severity"),
            strings(signature.get("attck", ())).alias("attck"),
            F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()])).alias("strings"),
        )))
    return rows.select(*files.columns, F.explode(F.array_compact(F.array(*hits))).alias("__h")).select(
        *files.columns, "__h.*"
    )


def signature_files(
    artifacts: DataFrame, signatures: Sequence[Mapping], size: int = CHUNK_BYTES
) -> DataFrame:
    """Signature hits over the files of (path, artifact_id, mtime, size) as events."""
    return hit_rows(scan_files(artifacts.select("path", "artifact_id", "mtime", "size"), signatures, size))


def signature_scan(artifacts: DataFrame, signatures: Sequence[Mapping]) -> DataFrame:
    """The same over contents that rows already hold (path, artifact_id, mtime, content)."""
    files = artifacts.withColumn("__text", F.decode("content", "ISO-8859-1"))
    if "artifact_id" not in files.columns:
        files = files.withColumn("artifact_id", F.lit(0).cast("long"))
    return hit_rows(scan_texts(files, "__text", ["path", "artifact_id", "mtime"], signatures))


def hit_rows(hits: DataFrame) -> DataFrame:
    """Hits (path, artifact_id, mtime, rule, severity, attck, strings) as events."""
    rows = hits.select(
        wide_id(F.col("path"), F.col("rule"), "signature").alias("id"),
        "artifact_id",
        F.col("mtime").alias("event_time"),
        F.lit("Artifact mtime (signature hit)").alias("ts_desc"),
        F.lit(SCAN_TIME).alias("time_kind"),
        F.lit("yara_match").alias("event_type"),
        cut(
            F.concat(F.lit("YARA "), "rule", F.lit(" matched "), file_name(F.col("path"))), 400
        ).alias("message"),
        payload(rule=F.col("rule"), strings=F.array_join("strings", " ")).alias("data"),
        "attck",
        strings(["detection"]).alias("tags"),
        "severity",
        F.lit(PARSER).alias("source_artifact"),
        F.col("path").alias("artifact_path"),
        F.lit(PARSER).alias("parser"),
    )
    return normalize(rows)
