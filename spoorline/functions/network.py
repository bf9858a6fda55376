"""Addresses and domains: validity, tags, defanging."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence
from functools import lru_cache
from importlib.resources import files

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline.functions.text import any_of, let, starts_any, strings

# Address blocks behind each tag (IANA special-purpose registries).
V4_PRIVATE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
V4_PRIVATE_EXCEPT = ("192.0.0.9/32", "192.0.0.10/32")
V4_LOOPBACK = ("127.0.0.0/8",)
V4_MULTICAST = ("224.0.0.0/4",)
V4_RESERVED = ("240.0.0.0/4", "0.0.0.0/32")
V6_PRIVATE = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
V6_PRIVATE_EXCEPT = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
)
V6_LOOPBACK = ("::1/128",)
V6_MULTICAST = ("ff00::/8",)
V6_RESERVED = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3",
    "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
)

# Endings that make a dotted word a file name or a local name.
FILE_TLDS = (
    "exe", "dll", "sys", "bat", "cmd", "ps1", "vbs", "js", "jar", "py", "sh",
    "log", "txt", "csv", "json", "xml", "zip", "rar", "gz", "tar", "7z", "db",
    "dat", "tmp", "bak", "ini", "cfg", "conf", "yml", "yaml", "md", "png", "jpg",
    "jpeg", "gif", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "evtx",
    "pf", "hve", "lnk", "sqlite", "dmp", "raw", "img", "iso", "msi", "inf",
    "local", "internal", "lan", "home", "arpa", "invalid", "test", "localdomain",
)

# Defanged spellings and what they stand for.
REFANG = (
    (r"(?i)h[xX]{2}p(s?)://", "http$1://"),
    (r"(?i)\bf[xX]p://", "ftp://"),
    (r"\[\.\]|\(\.\)|\{\.\}|\s\.\s", "."),
    (r"(?i)\[dot\]|\(dot\)", "."),
    (r"\[:\]|\(:\)", ":"),
    (r"(?i)\[@\]|\(at\)|\[at\]", "@"),
    (r"\[//\]", "//"),
)

V4_SHAPE = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
)
V6_FULL_SHAPE = r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"


#: Per spelling, texts of which one is in every text that holds it: looked for first, as
#: that costs far less than the pattern. Letters stand in both cases.
REFANG_HINTS = (
    ("://",),
    ("://",),
    ("[.]", "(.)", "{.}", " .", "\t.", "\n.", "\u000b.", "\f.", "\r."),
    ("[d", "[D", "(d", "(D"),
    ("[:]", "(:)"),
    ("[@]", "(a", "(A", "[a", "[A"),
    ("[//]",),
)


def refang(text: Column) -> Column:
    for (pattern, replacement), hints in zip(REFANG, REFANG_HINTS):
        text = let(text, lambda t: where_hinted(t, hints, F.regexp_replace(t, pattern, replacement), t))
    return text


def where_hinted(text: Column, hints: Sequence[str], value: Column, other: Column) -> Column:
    """``value`` where the text holds one of the hints, else ``other``."""
    return F.when(any_of([text.contains(hint) for hint in hints]), value).otherwise(other)


def _bits_of(block: str) -> str:
    net = ipaddress.ip_network(block)
    width = net.max_prefixlen
    return format(int(net.network_address), f"0{width}b")[: net.prefixlen]


def _in_blocks(bits: Column, blocks: Sequence[str]) -> Column:
    return starts_any(bits, [_bits_of(block) for block in blocks])


def _joined_bits(parts: Column, base: int, width: int) -> Column:
    digits = F.transform(parts, lambda p: F.lpad(F.conv(p, base, 2), width, "0"))
    return F.array_join(digits, "")


def ip_tags(value: Column) -> Column:
    """private / loopback / multicast / reserved; null when not an address.

    Both families become a bit string, so a block test is a prefix test. IPv6
    is taken in its full eight-group form, the only one the extractor yields.
    """
    def tagged(bits: Column, private, spared, loopback, multicast, reserved) -> Column:
        is_private = _in_blocks(bits, private) & ~_in_blocks(bits, spared)
        return F.array_compact(
            F.array(
                F.when(is_private, F.lit("private")),
                F.when(_in_blocks(bits, loopback), F.lit("loopback")),
                F.when(_in_blocks(bits, multicast), F.lit("multicast")),
                F.when(_in_blocks(bits, reserved), F.lit("reserved")),
            )
        )

    def v4(bits: Column) -> Column:
        return tagged(
            bits, V4_PRIVATE, V4_PRIVATE_EXCEPT, V4_LOOPBACK, V4_MULTICAST, V4_RESERVED
        )

    def v6(bits: Column) -> Column:
        own = tagged(
            bits, V6_PRIVATE, V6_PRIVATE_EXCEPT, V6_LOOPBACK, V6_MULTICAST, V6_RESERVED
        )
        mapped = bits.startswith(_bits_of("::ffff:0:0/96"))
        return F.when(mapped, let(bits.substr(97, 32), v4)).otherwise(own)

    return F.when(
        value.rlike(V4_SHAPE), let(_joined_bits(F.split(value, r"\."), 10, 8), v4)
    ).when(value.rlike(V6_FULL_SHAPE), let(_joined_bits(F.split(value, ":"), 16, 16), v6))


def address_bits(value: Column) -> Column:
    """The family (4 or 6) and the address as bits; null for what is no address.

    IPv6 in any spelling; an IPv4 address mapped into IPv6 is the IPv4 address.
    """
    def v6(text: Column) -> Column:
        def groups(halves: Column) -> Column:
            some = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))
            left, right = some(F.get(halves, F.lit(0))), some(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
            short = F.size(halves) == 2
            gap = F.lit(8) - F.size(left) - F.size(right)
            whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
            sound = F.when(short, gap >= 1).otherwise(gap == 0) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
            return F.when(sound, F.concat(F.lit("6"), _joined_bits(whole, 16, 16)))
        return F.when(~text.rlike("::.*::"), let(F.split(text, "::"), groups))

    def family(text: Column) -> Column:
        bare = F.regexp_replace(text, "^::ffff:(?=[0-9]+[.])", "")
        return F.when(bare.rlike(V4_SHAPE), F.concat(F.lit("4"), _joined_bits(F.split(bare, r"\."), 10, 8))).when(
            text.rlike("^[0-9a-f:]+$") & text.contains(":"), v6(text)
        )

    return let(F.lower(F.trim(value)), family)


def network_bits(network: Column) -> Column:
    """The bits every address of a network (``address/length``, or one address) begins with."""
    bits = address_bits(F.substring_index(network, "/", 1))
    length = F.when(network.contains("/"), F.substring_index(network, "/", -1).try_cast("int")).otherwise(128)
    return F.left(bits, length + 1)


def normalize_ip(value: Column) -> Column:
    """Comparable spelling: blanks dropped, mapped and loopback forms as IPv4."""
    return let(
        F.trim(value),
        lambda text: F.when(text.isin("-", "::", ""), F.lit(""))
        .when(F.lower(text).startswith("::ffff:"), text.substr(F.lit(8), F.length(text)))
        .when(text == "::1", F.lit("127.0.0.1"))
        .otherwise(text),
    )


def domain_ok(value: Column) -> Column:
    """Rejects file names, version strings and over-long names."""
    name = F.regexp_replace(F.lower(value), r"\.+$", "")
    tld = F.substring_index(name, ".", -1)
    first = F.substring_index(name, ".", 1)
    return ~(
        tld.isin(*FILE_TLDS)
        | tld.rlike(r"^[0-9]+$")
        | (F.length(name) > 253)
        | name.startswith("-")
        | first.rlike(r"^[0-9]+$")
    )


def host_of(value: Column) -> Column:
    """Host part of a URL or an e-mail address."""
    rest = F.regexp_replace(value, r"^[\s\S]*?://", "")
    rest = F.substring_index(rest, "@", -1)
    host = F.regexp_extract(rest, r"^[^/:?#]*", 0)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


@lru_cache(maxsize=1)
def default_allowlist() -> tuple[str, ...]:
    """Well-known infrastructure; a leading dot stands for any subdomain."""
    text = files("spoorline.functions").joinpath("allowlist.txt").read_text(encoding="utf-8")
    lines = (line.strip().lower() for line in text.splitlines())
    return tuple(line for line in lines if line and not line.startswith("#"))


def allowlisted(host: Column, entries: Sequence[str] | None = None) -> Column:
    """Exact entry, or under (or equal to) an entry with a leading dot.

    For a list that does not fit in a plan use ``indicators.tag_from_table``.
    """
    entries = default_allowlist() if entries is None else tuple(e.lower() for e in entries)
    name = F.regexp_replace(F.lower(host), r"\.+$", "")
    exact = [e for e in entries if not e.startswith(".")]
    under = [e for e in entries if e.startswith(".")]
    hit = F.array_contains(strings(exact), name) if exact else F.lit(False)
    if under:
        tails = "|".join(e.replace(".", r"\.") for e in under)
        hit = hit | F.concat(F.lit("."), name).rlike(f"(?:{tails})$")
    return hit


def suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, .a.b.c, .b.c, .c]: keys to look up in an allowlist table."""
    parts = F.split(host, r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")),
    )
    return F.concat(F.array(host), tails)
