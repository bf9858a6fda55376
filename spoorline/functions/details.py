"""Record fields as one labelled line: ``Label: value ¦ Label: value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline.functions.network import normalize_ip
from spoorline.functions.text import (
    SEP,
    blank_to_null,
    capped,
    let,
    lookup,
    one_line,
    or_blank,
    strings,
)

DETAILS_LIMIT = EXTRA_LIMIT = 512
TEMPLATE_PAIRS, AUTO_PAIRS = 12, 10
TEMPLATE_VALUE, AUTO_VALUE = 200, 120

# Fields shown first when a record has no template.
FIELD_PRIORITY = (
    "SubjectUserName", "TargetUserName", "AccountName", "User", "UserName",
    "IpAddress", "ClientAddress", "SourceAddress", "Address", "WorkstationName",
    "Workstation", "CommandLine", "ProcessCommandLine", "Image", "NewProcessName",
    "ProcessName", "ImagePath", "ServiceFileName", "ServiceName", "TaskName",
    "TargetFilename", "TargetObject", "ObjectName", "ShareName",
    "RelativeTargetName", "QueryName", "QueryResults", "DestinationIp",
    "DestinationHostname", "DestinationPort", "SourcePort", "ScriptBlockText",
    "Payload", "HostApplication", "Status", "SubStatus", "LogonType",
    "AuthenticationPackageName", "LmPackageName", "PrivilegeList", "MemberName",
    "TargetSid", "Hashes", "ParentImage", "ParentCommandLine", "ThreatName",
)

# Container fields that never get a label.
FIELDS_NOT_SHOWN = (
    "event_id", "eventid", "channel", "provider", "computer", "_truncated",
    "keywords", "opcode", "version", "level", "task", "eventrecordid",
    "record_id", "processid", "threadid", "correlation", "execution",
    "guid", "eventsourcename",
)

# Meanings of coded fields.
LOGON_TYPES = {
    "0": "System", "2": "Interactive", "3": "Network", "4": "Batch",
    "5": "Service", "7": "Unlock", "8": "NetworkCleartext",
    "9": "NewCredentials", "10": "RemoteInteractive", "11": "CachedInteractive",
    "12": "CachedRemoteInteractive", "13": "CachedUnlock",
}
NTSTATUS = {
    "0xc000006a": "bad password", "0xc0000064": "user does not exist",
    "0xc0000234": "account locked out", "0xc0000072": "account disabled",
    "0xc0000070": "workstation restriction", "0xc000006f": "outside logon hours",
    "0xc0000193": "account expired", "0xc0000071": "password expired",
    "0xc0000224": "must change password", "0xc000015b": "logon type not granted",
    "0xc000006d": "bad username or password", "0xc000006e": "account restriction",
    "0xc0000133": "clock skew between DC and client", "0x0": "success",
}
KERBEROS = {
    "0x6": "client not found in Kerberos database", "0x7": "server not found",
    "0x9": "password has not been set", "0xc": "policy restriction (workstation/time)",
    "0x12": "account disabled, expired or locked out", "0x17": "password expired",
    "0x18": "bad password (pre-auth failed)", "0x1b": "server must use user2user",
    "0x1f": "integrity check failed", "0x20": "ticket expired",
    "0x25": "clock skew too great", "0x0": "success",
}
KERBEROS_EVENTS = ("4768", "4769", "4771", "4772", "4773", "4776")
TICKET_ENCRYPTION = {
    "0x1": "DES-CBC-CRC (weak)", "0x3": "DES-CBC-MD5 (weak)",
    "0x11": "AES128-CTS-HMAC-SHA1", "0x12": "AES256-CTS-HMAC-SHA1",
    "0x17": "RC4-HMAC (downgrade)", "0x18": "RC4-HMAC-EXP (downgrade)",
    "0xffffffff": "unknown",
}
SERVICE_START = {"0": "boot", "1": "system", "2": "auto", "3": "manual", "4": "disabled"}
#: The names of coded fields in lower case.
CODED_FIELDS = (
    "logontype", "status", "substatus", "resultcode", "failurereason", "ticketencryptiontype",
    "preauthtype", "starttype", "servicestarttype",
)


def decode_field(field: Column, value: Column, event_id: Column) -> Column:
    """The value with its meaning in brackets where the field is a known code."""
    raw = F.trim(value)

    def meaning(name: Column) -> Column:
        code = F.lower(raw)
        status = F.when(event_id.isin(*KERBEROS_EVENTS), lookup(KERBEROS, code)).otherwise(
            lookup(NTSTATUS, code)
        )
        roastable = F.when(raw == "0", F.lit("none — AS-REP roastable"))
        known = (
            F.when(name == "logontype", lookup(LOGON_TYPES, raw))
            .when(name.isin("status", "substatus", "resultcode", "failurereason"), status)
            .when(name == "ticketencryptiontype", lookup(TICKET_ENCRYPTION, code))
            .when(name == "preauthtype", roastable)
            .when(name.isin("starttype", "servicestarttype"), lookup(SERVICE_START, raw))
        )
        return F.coalesce(F.concat(F.lit(" ("), known, F.lit(")")), F.lit(""))

    # Few fields are coded: the others are told apart by one look at their name.
    coded = F.lower(field).isin(*CODED_FIELDS)
    return F.concat(raw, F.when(coded, let(F.lower(field), meaning)).otherwise(F.lit("")))


def natural_key(name: Column) -> Column:
    """Sorts ``param2`` before ``param10``: digit runs padded to one width."""
    def padded(n: Column) -> Column:
        wide = F.regexp_replace(n, r"([0-9]+)", "\u00010000000000000000$1")
        return F.when(n.rlike("[0-9]"), F.regexp_replace(wide, r"0[0-9]*([0-9]{16})(?![0-9])", "$1")).otherwise(n)

    return let(F.lower(name), padded)


def pair(label: Column, value: Column) -> Column:
    return F.struct(label.alias("label"), value.alias("value"))


def render_pairs(pairs: Column, limit: int = DETAILS_LIMIT) -> Column:
    """Labels and values joined within ``limit`` characters.

    A pair that does not fit is skipped and counted; a later, shorter one may
    still fit. Ends with ``+N more`` when anything was skipped.
    """
    start = F.struct(
        F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(0).alias("skipped")
    )

    def step(state: Column, item: Column) -> Column:
        def with_piece(piece: Column) -> Column:
            cost = F.length(piece) + len(SEP)
            joined = F.when(state["text"] == "", piece).otherwise(
                F.concat(state["text"], F.lit(SEP), piece)
            )
            return F.when(
                state["used"] + cost <= limit,
                F.struct(
                    joined.alias("text"),
                    (state["used"] + cost).alias("used"),
                    state["skipped"].alias("skipped"),
                ),
            ).otherwise(
                F.struct(
                    state["text"].alias("text"),
                    state["used"].alias("used"),
                    (state["skipped"] + 1).alias("skipped"),
                )
            )

        return let(F.concat(item["label"], F.lit(": "), item["value"]), with_piece)

    def finish(state: Column) -> Column:
        tail = F.concat(F.lit("+"), state["skipped"].cast("string"), F.lit(" more"))
        return F.when(state["skipped"] == 0, state["text"]).otherwise(
            F.concat_ws(SEP, blank_to_null(state["text"]), tail)
        )

    filled = F.filter(pairs, lambda p: or_blank(p["value"]) != "")
    return F.aggregate(filled, start, step, finish)


def auto_pairs(data: Column, skip: Column, event_id: Column) -> Column:
    """Every field under its own name: useful ones first, ten at most."""
    order = F.lit(",".join(FIELD_PRIORITY).lower())

    def keyed(e: Column) -> Column:
        place = F.find_in_set(e["name"], order)
        position = F.when(place == 0, 999).otherwise(place)
        return F.struct(
            position.alias("rank"),
            natural_key(e["label"]).alias("name"),
            e["label"].alias("label"),
            e["value"].alias("value"),
        )

    # What is asked of a field more than once is worked out once, and only of fields shown.
    entries = F.transform(
        F.map_entries(data),
        lambda e: F.struct(
            e["key"].alias("label"), F.lower(e["key"]).alias("name"), one_line(or_blank(e["value"])).alias("value")
        ),
    )
    shown = F.filter(
        entries,
        lambda e: ~e["name"].isin(*FIELDS_NOT_SHOWN) & (e["value"] != "") & ~F.array_contains(skip, e["name"]),
    )

    def listed(ranked: Column) -> Column:
        first = F.transform(
            F.slice(ranked, 1, AUTO_PAIRS),
            lambda r: pair(
                r["label"], capped(decode_field(r["label"], r["value"], event_id), AUTO_VALUE)
            ),
        )
        left = F.size(ranked) - AUTO_PAIRS
        rest = F.array(pair(F.lit("+"), F.concat(left.cast("string"), F.lit(" more fields"))))
        return F.concat(first, F.when(left > 0, rest).otherwise(F.slice(rest, 1, 0)))

    return let(F.array_sort(F.transform(shown, keyed)), listed)


def template_pairs(data: Column, template: Column, event_id: Column) -> Column:
    """Pairs a template asks for, each with the field that supplied it.

    ``template`` is ``array<struct<label, names: array<string>>>``; the first
    name with a value wins. A blanked address keeps its field as consumed.
    """
    fields = F.map_from_entries(
        F.transform(
            F.map_entries(data),
            lambda e: F.struct(F.lower(e["key"]), one_line(e["value"])),
        )
    )

    def resolved(row: Column) -> Column:
        present = F.filter(
            row["names"], lambda n: or_blank(F.try_element_at(fields, F.lower(n))) != ""
        )

        def shown(name: Column) -> Column:
            text = F.try_element_at(fields, F.lower(name))
            is_ip = F.lower(name).rlike("ip|address")
            clean = F.when(is_ip, normalize_ip(text)).otherwise(text)
            return F.struct(
                row["label"].alias("label"),
                let(
                    clean,
                    lambda c: F.when(
                        c != "", capped(decode_field(name, c, event_id), TEMPLATE_VALUE)
                    ),
                ).alias("value"),
                F.lower(name).alias("field"),
            )

        return let(F.get(present, F.lit(0)), shown)

    rows = F.transform(F.slice(template, 1, TEMPLATE_PAIRS), resolved)
    return F.filter(rows, lambda r: r["field"].isNotNull())


def build_details(
    data: Column, template: Column, provider: Column, channel: Column, event_id: Column
) -> Column:
    """struct(details, extra): template fields, else all fields, else where it came from."""
    nothing = F.array().cast("array<struct<label:string,value:string,field:string>>")
    origin = F.array(
        pair(F.lit("Provider"), one_line(or_blank(provider))),
        pair(F.lit("Channel"), one_line(or_blank(channel))),
        pair(F.lit("EventID"), one_line(or_blank(event_id))),
        pair(F.lit("NoFieldData"), F.lit("record carries no EventData")),
    )

    def built(picked: Column) -> Column:
        shown = F.filter(picked, lambda r: r["value"].isNotNull())
        templated = F.size(shown) > 0
        # With a template the rest goes to extra, without one it is the details.
        used = F.when(templated, F.transform(picked, lambda r: r["field"])).otherwise(strings([]))
        from_template = render_pairs(
            F.transform(shown, lambda r: pair(r["label"], r["value"])), DETAILS_LIMIT
        )
        return let(
            render_pairs(auto_pairs(data, used, event_id), EXTRA_LIMIT),
            lambda rest: F.struct(
                F.when(templated, from_template)
                .otherwise(F.coalesce(blank_to_null(rest), render_pairs(origin)))
                .alias("details"),
                F.when(templated, rest).otherwise("").alias("extra"),
            ),
        )

    return let(F.coalesce(template_pairs(data, template, event_id), nothing), built)


def parse_details(text: Column) -> Column:
    """The reverse of :func:`render_pairs`: a map of label to value."""
    pieces = F.transform(
        F.split(or_blank(text), SEP),
        lambda p: F.struct(
            F.trim(F.substring_index(p, ":", 1)).alias("key"),
            F.trim(F.when(p.contains(":"), p.substr(F.instr(p, ":") + 1, F.length(p))).otherwise(""))
            .alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(pieces, lambda e: e["key"] != ""))
