"""Sample rules, signatures, templates and questions for the registered queries."""

from __future__ import annotations

EVENT_RULES = [
    {
        "title": "Error with a high number",
        "id": "r1",
        "level": "critical",
        "tags": ["attack.t1499.001", "attack.impact"],
        "logsource": {"product": "windows"},
        "detection": {
            "selection": {"k|startswith": ["9", "8"]},
            "kind": {"event_type": "error"},
            "filter": {"provider": "p2"},
            "condition": "selection and kind and not filter",
        },
    },
    {
        "title": "Purchase or signup of some users",
        "id": "r2",
        "level": "medium",
        "tags": ["attack.t1078"],
        "logsource": {"product": "windows"},
        "detection": {
            "a": {"User": "u1*"},
            "b": {"User|endswith": "7"},
            "kind": {"event_type": ["purchase", "signup"]},
            "condition": "kind and 1 of a or kind and b",
        },
    },
    {
        "title": "Process events by id",
        "id": "r3",
        "level": "low",
        "logsource": {"product": "windows", "category": "process_creation"},
        "detection": {
            "sel_one": {"value|contains": "5"},
            "sel_two": {"value|re": "^[0-9]{2}\\."},
            "condition": "all of sel_*",
        },
    },
    {
        "title": "Channel three",
        "id": "r4",
        "level": "high",
        "tags": ["attack.t1105"],
        "logsource": {"product": "windows", "service": "chan3"},
        "detection": {
            "selection": [{"k": "33"}, {"k|contains|all": ["8", "3"]}],
            "condition": "selection",
        },
    },
    {
        "title": "Other cloud",
        "id": "r5",
        "logsource": {"product": "aws"},
        "detection": {"selection": {"k": "1"}, "condition": "selection"},
    },
    {
        "title": "Unknown modifier",
        "id": "r6",
        "detection": {"selection": {"k|near": "1"}, "condition": "selection"},
    },
]

TEXT_RULES = [
    {
        "title": "Two words",
        "id": "t1",
        "level": "medium",
        "logsource": {"product": "linux"},
        "detection": {"words": {"message|contains|all": ["the", "example"]}, "condition": "words"},
    },
    {
        "title": "Licence text",
        "id": "t2",
        "level": "low",
        "detection": {"words": ["license", "copyright"], "condition": "words"},
    },
    {
        "title": "Mail but not English",
        "id": "t3",
        "level": "high",
        "detection": {
            "mail": {"message|contains": "@example."},
            "en": {"lang": "en"},
            "condition": "mail and not en",
        },
    },
]

PAGE_SIGNATURES = [
    {
        "name": "script_and_comment",
        "severity": "medium",
        "strings": {"$s": "<script>", "$c": "<!--", "$f": {"text": "IFRAME", "nocase": True}},
        "condition": "$s and any of ($c, $f)",
    },
    {
        "name": "two_of",
        "severity": "critical",
        "attck": ["T1189"],
        "strings": {
            "$a": {"text": "TABLE", "nocase": True},
            "$b": {"regex": "href=\"/[a-z]+\"", "nocase": False},
            "$c": {"text": "lang=\"de\""},
            "$d": {"text": "nofollow", "nocase": True},
        },
        "condition": "2 of them and not $d",
    },
    {
        "name": "all_parts",
        "severity": "low",
        "strings": {"$p1": "<article>", "$p2": "<h1>", "$x": "zzzz-never"},
        "condition": "all of $p* and not $x",
    },
]

TEMPLATES = [
    (
        "microsoft-windows-security-auditing", "4625", "Logon failed", "medium",
        [("TgtUser", ["TargetUserName"]), ("SrcIP", ["IpAddress", "ClientAddress"]),
         ("Why", ["Status"]), ("Proc", ["ProcessName"])],
        ["T1110"],
    ),
]

# Rules that cannot be evaluated, each for another cause.
UNUSABLE_RULES = [
    {"title": "Counted", "id": "u1", "detection": {"s": {"k": "1"}, "condition": "s | count() > 5"}},
    {"title": "Bad pattern", "id": "u2", "detection": {"s": {"value|re": "(5"}, "condition": "s"}},
    {"title": "No condition", "id": "u3", "detection": {"s": {"k": "1"}}},
    {"title": "Never true", "id": "u4", "detection": {"s": {"k": "1000"}, "condition": "s"}},
]

QUESTIONS = [
    "What is the attacker IP?",
    "Which account was compromised?",
    "When was the first successful login by brute force?",
    "What account did they create?",
    "Which sudo command was executed?",
    "What is the hostname?",
]


def rule_corpus(size: int = 600) -> list[dict]:
    """A rule set the size of a small public corpus: number and last digit of the user."""
    return [
        {
            "title": f"Corpus rule {i}",
            "id": f"c{i}",
            "level": "low",
            "detection": {
                "number": {"k": str(i % 100)},
                "user": {"User|endswith": str(i // 100)},
                "condition": "number and user",
            },
        }
        for i in range(size)
    ]


def mixed_corpus(size: int = 2935) -> list[dict]:
    """As many rules as a large public corpus, of nine kinds: lists, patterns, scopes, modifiers."""
    def detection(i: int) -> dict:
        kind, n = i % 9, i // 9
        if kind == 0:
            return {"number": {"k": str(n % 100)}, "user": {"User|endswith": str(n // 100)}, "condition": "number and user"}
        if kind == 1:
            return {"a": {"Message|contains": f"k: {n % 100} "}, "b": {"provider": f"p{n % 3}"}, "u": {"User": f"u{n}"},
                    "condition": "a and not b or u"}
        if kind == 2:
            return {"s": {"value|re": f"^{n % 100}\\.[0-9]*{n % 10}$"}, "condition": "s"}
        if kind == 3:
            return {"s": [{"User": f"u{n}"}, {"CommandLine|contains|all": [f"-n{n % 100} ", f"/u {n % 30}"]}], "condition": "s"}
        if kind == 4:
            return {"a": {"User": f"u{n % 100}*"}, "b": {"k|startswith": [str(n % 10), "77"]}, "f": {"Absent": None, "k|endswith": "3"},
                    "condition": "all of them"}
        if kind == 5:
            return {"s": {"CommandLine|contains|windash": f"-n{n % 100} "}, "u": {"User|endswith": f"{n // 100}"}, "condition": "s and u"}
        if kind == 6:
            return {"s": {"CommandLine|base64offset|contains": f"id={n};end"}, "condition": "s"}
        if kind == 7:
            return {"s": {"CommandLine|contains|cased": f"-N{n % 100} "}, "t": {"CommandLine|contains|cased": f"-n{n % 100} "},
                    "u": {"User|endswith": "1"}, "condition": "1 of s* and u and not t"}
        return {"words": [f"Signup ¦ k: {n % 100} ", "no such text"], "condition": "words"}

    scopes = ({}, {}, {"service": "chan3"}, {}, {}, {}, {}, {"category": "process_creation"}, {})
    return [
        {"title": f"Mixed rule {i}", "id": f"m{i}", "level": "low", "logsource": scopes[i % 9], "detection": detection(i)}
        for i in range(size)
    ]
