"""Indicators of compromise: extraction, tags, links back to their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.network import (
    address_bits,
    allowlisted,
    domain_ok,
    host_of,
    ip_tags,
    network_bits,
    refang,
    suffixes,
    where_hinted,
)
from spoorline.functions.text import let, or_blank, strings

# Indicator types in order, and their shapes.
URL = r"(?i)\b(?:https?|ftps?)://[^\s\"'<>\\)\]}]+"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
SHAPES = (
    ("url", URL),
    ("email", EMAIL),
    ("sha256", r"\b[A-Fa-f0-9]{64}\b"),
    ("sha1", r"\b[A-Fa-f0-9]{40}\b"),
    ("md5", r"\b[A-Fa-f0-9]{32}\b"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("ipv6", r"(?<![:.\w])(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}(?![:.\w])"),
    ("domain", r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}\b"),
)
TYPES = tuple(kind for kind, _ in SHAPES)
#: Texts of which one is in every text with such an indicator, looked for before the shape.
HINTS = {"url": ("://",), "email": ("@",), "ipv4": (".",), "ipv6": (":",), "domain": (".",)}
#: Every digest holds a run of this length.
DIGEST = r"[A-Fa-f0-9]{32}"


def unclaimed(clear: Column) -> Column:
    """The text without its URLs and mail addresses: they claim their characters,
    so the host inside one is not a domain of its own."""
    bare = where_hinted(clear, HINTS["url"], F.regexp_replace(clear, URL, " "), clear)
    return where_hinted(clear, HINTS["email"], F.regexp_replace(bare, EMAIL, " "), bare)


def found_values(clear: Column, rest: Column) -> Column:
    """Distinct array of struct(type, value) in one refanged text, read whole.

    ``rest`` is :func:`unclaimed` of it. Both are columns of their own, so each
    is computed once per row and not once per indicator type.
    """

    def of_type(kind: str, shape: str, digests: Column) -> Column:
        where = rest if kind == "domain" else clear
        found = F.regexp_extract_all(where, F.lit(shape), 0)
        if kind in HINTS:
            found = where_hinted(where, HINTS[kind], found, strings([]))
        else:
            found = F.when(digests, found).otherwise(strings([]))
        hits = F.transform(found, lambda v: F.regexp_replace(v, r"[.,;:)\]}\"']+$", ""))
        if kind in ("email", "sha256", "sha1", "md5", "domain"):
            hits = F.transform(hits, lambda v: F.lower(v))
        hits = F.filter(hits, lambda v: v != "")
        if kind == "domain":
            hits = F.filter(hits, domain_ok)
        return F.transform(
            hits, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
        )

    return let(
        clear.rlike(DIGEST),
        lambda digests: F.array_distinct(F.concat(*[of_type(kind, shape, digests) for kind, shape in SHAPES])),
    )


def extract_indicators(
    df: DataFrame,
    text: Column | str,
    keys: Sequence[str],
    allowlist: Sequence[str] | None = None,
) -> DataFrame:
    """``keys`` plus (type, value, tags), one row per indicator and source row.

    Noise is tagged, never dropped: private / loopback / multicast / reserved
    addresses, allowlisted names, and values that were written defanged.
    """
    text = F.col(text) if isinstance(text, str) else text
    texts = df.select(*keys, text.alias("__text")).withColumn(
        "__clear", refang(or_blank(F.col("__text")))
    )
    texts = texts.withColumn("__rest", unclaimed(F.col("__clear")))
    found = found_values(F.col("__clear"), F.col("__rest"))
    rows = texts.select(*keys, "__text", F.explode(found).alias("__found")).select(
        *keys,
        F.col("__found.type").alias("type"),
        F.col("__found.value").alias("value"),
        ~F.lower("__text").contains(F.lower("__found.value")),
    )
    rows = rows.toDF(*keys, "type", "value", "__defanged")
    is_ip = F.col("type").isin("ipv4", "ipv6")
    named = F.col("type").isin("url", "email", "domain")
    rows = rows.withColumn("__ip", F.when(is_ip, ip_tags(F.col("value")))).filter(
        ~is_ip | F.col("__ip").isNotNull()
    )
    host = F.when(F.col("type") == "domain", F.col("value")).otherwise(host_of(F.col("value")))
    tags = F.concat(
        F.coalesce(F.col("__ip"), strings([])),
        F.array_compact(
            F.array(
                F.when(named & allowlisted(host, allowlist), F.lit("allowlisted")),
                F.when(F.col("__defanged"), F.lit("defanged")),
            )
        ),
    )
    return rows.select(*keys, "type", "value", tags.alias("tags"))


def tag_from_table(
    indicators: DataFrame, allowlist: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Allowlist tags from a table of any size (column ``entry``).

    Every suffix of a host is looked up; the distinct hosts are joined, not the
    sightings. Adds ``allowlisted`` to the tags of matching rows.
    """
    named = indicators.filter(F.col("type").isin("url", "email", "domain")).select("value").distinct()
    host = F.when(F.col("value").rlike("[/@]"), host_of(F.col("value"))).otherwise(
        F.lower("value")
    )
    keyed = named.select("value", F.explode(suffixes(host)).alias("entry"))
    hits = (
        keyed.join(allowlist.select(F.lower("entry").alias("entry")).distinct(), "entry")
        .select("value")
        .distinct()
        .withColumn("__listed", F.lit(True))
    )
    from spoorline.operators.skew import salted_join

    joined = salted_join(indicators, hits, ["value"], list(keys))
    tagged = F.when(
        F.col("__listed").isNotNull(), F.array_union("tags", strings(["allowlisted"]))
    ).otherwise(F.col("tags"))
    return joined.withColumn("tags", tagged).drop("__listed").select(*indicators.columns)


def tag_networks(indicators: DataFrame, networks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``network``: the label of the longest network that holds the address, else null.

    ``networks``: (network, label), of any size; of equal networks the least label counts.
    Each distinct address is looked up once for every prefix length that the table has (at
    most 33 and 129), so the join is on equal prefixes.
    """
    known = (
        networks.select(network_bits(F.col("network")).alias("prefix"), "label")
        .where("prefix IS NOT NULL")
        .groupBy("prefix")
        .agg(F.min("label").alias("label"))
    )
    found = known.select(F.left("prefix", F.lit(1)).alias("f"), F.length("prefix").alias("n")).distinct().collect()
    lengths = {f: sorted(r.n for r in found if r.f == f) for f in ("4", "6")}
    cuts = lambda f: F.array(*[F.left("bits", F.lit(n)) for n in lengths[f]]).cast("array<string>")
    addresses = indicators.where(F.col("type").isin("ipv4", "ipv6")).select("value").distinct()
    keyed = addresses.select("value", address_bits(F.col("value")).alias("bits")).select(
        "value", F.explode(F.when(F.col("bits").startswith("4"), cuts("4")).otherwise(cuts("6"))).alias("prefix")
    )
    best = keyed.join(known, "prefix").groupBy("value").agg(F.max_by("label", F.length("prefix")).alias("network"))
    from spoorline.operators.skew import salted_join

    return salted_join(indicators, best, ["value"], list(keys))


def event_text(events: DataFrame, include_raw: bool = True) -> Column:
    parts = [F.col("message"), F.concat_ws("\n", F.map_values("data"))]
    if include_raw:
        parts.append(F.col("raw"))
    return F.concat_ws("\n", *parts)


def sweep(events: DataFrame, allowlist: Sequence[str] | None = None) -> DataFrame:
    """The links: (type, value, event_id, artifact_id, event_time, tags), one per row and indicator."""
    keyed = events.withColumnRenamed("id", "__id")
    found = extract_indicators(
        keyed, event_text(events), ["__id", "artifact_id", "event_time"], allowlist
    )
    return found.select(
        "type", "value", F.col("__id").alias("event_id"), "artifact_id", "event_time", "tags"
    )


def get_iocs(links: DataFrame, order: str = "event_id") -> DataFrame:
    """Per indicator: sightings, tags of the first one, first time seen."""
    values = [F.count(F.lit(1)).alias("n"), F.min_by("tags", order).alias("tags")]
    if "event_time" in links.columns:
        values.append(F.min("event_time").alias("first_seen"))
    return (
        links.groupBy("type", "value")
        .agg(*values)
        .orderBy(F.col("n").desc(), "type", "value")
    )


def ioc_counts(links: DataFrame) -> DataFrame:
    """Distinct indicators per type."""
    return (
        links.select("type", "value").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    )


def events_mentioning(
    events: DataFrame, links: DataFrame, kind: str, value: str
) -> DataFrame:
    """Events an indicator was seen in: a join on the links, not a second scan of text."""
    ids = links.filter((F.col("type") == kind) & (F.col("value") == value)).select(
        F.col("event_id").alias("id")
    )
    return events.join(ids, "id", "left_semi")
