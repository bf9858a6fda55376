"""Derived web-archive records: for each response a metadata and a plain-text conversion record.

Both name their response in WARC-Refers-To and keep its target, date and address; the
metadata record also keeps its digests, its HTTP headers, the title, the declared charset
and language and the out-links. Digests are SHA-1 in base 32. Record ids are UUIDs made
from what the record is derived from, so a repeated task writes the same ids.

`write_records` lets Spark's text writer make gzip files in which the records follow each
other, each with the two line breaks that end it. Records are rows until then.

Nulls: a null payload is empty, a null target, date or address leaves its header out.
Equal responses give equal records. Header values have their control characters escaped.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import bounded_batches
from spoorline.llm.mainregion import parse

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace
LINK = re.compile(r"<(a|area|link|img|script|iframe)\b[^>]*?\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
CHARSET = re.compile(r"<meta[^>]*charset\s*=\s*[\"']?([\w-]+)", re.I)
LANGUAGE = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
RECORD = (
    "type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, source_payload_digest string, "
    "source_block_digest string, record string"
)


def digest(octets: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(octets).digest()).decode()


def record_id(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(p or '' for p in parts))}>"


def safe(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: " " if m[0] == " " else quote(m[0]), value)


def plain_text(page: str) -> str:
    """All the text a reader of the page could see: its blocks, one a line."""
    blocks: dict[int, list[str]] = {}
    for tag, _, _, _, text, block in parse(page):
        if not tag:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def links(page: str, base: str) -> list[str]:
    """Out-links in page order: address, place."""
    out = []
    for m in LINK.finditer(page):
        address = html.unescape(next(x for x in m.groups()[2:] if x is not None)).strip()
        try:
            address = urljoin(base, address)
        except ValueError:
            pass
        out.append(f"{quote(address, safe=SAFE)} {m[1].upper()}/@{m[2].lower()}")
    return out


SAFE = "".join(chr(c) for c in range(33, 127))


def as_record(headers: list[tuple[str, str | None]], block: str) -> str:
    lines = [f"{name}: {safe(value)}" for name, value in headers if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", block])


def responses(pages: DataFrame, date: str, id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as the responses a crawl on `date` would have stored: one row each.

    Columns: source (the row's id), target_uri, date, http_headers, payload.
    """
    payload = F.coalesce(F.col(body), F.lit(""))
    size = F.octet_length(payload).cast("string")
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n")
    )
    return pages.select(
        F.col(id).alias("source"),
        F.col(url).alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
    )


def derived(source: str | None, target: str | None, date: str | None, http: str | None, payload: str | None) -> list[dict]:
    """The two records of one response."""
    http, payload = http or "", payload or ""
    body = payload.encode("utf-8", "surrogatepass")
    of_payload = digest(body)
    of_block = digest(http.encode() + body)
    response = record_id("response", source, target, date, of_block)
    common = {
        "refers_to": response,
        "target_uri": target,
        "date": date,
        "source_payload_digest": of_payload,
        "source_block_digest": of_block,
    }
    title = TITLE.search(payload)
    charset, language = CHARSET.search(payload), LANGUAGE.search(payload)
    fields = [("source-payload-digest", of_payload), ("source-block-digest", of_block), ("source-length", str(len(body)))]
    for line in http.strip().split("\r\n"):
        name, colon, value = line.partition(":")
        fields.append((f"http-header-{name.lower()}", value.strip()) if colon else ("http-status", line))
    if title:
        fields.append(("title", " ".join(html.unescape(title[1]).split())))
    if charset:
        fields.append(("charset", charset[1]))
    if language:
        fields.append(("language", language[1]))
    fields += [("outlink", x) for x in links(payload, target or "")]
    out = []
    for kind, mime, block in (
        ("metadata", "application/warc-fields", "".join(f"{a}: {safe(b)}\r\n" for a, b in fields)),
        ("conversion", "text/plain; charset=utf-8", plain_text(payload)),
    ):
        octets = block.encode("utf-8", "surrogatepass")
        own = {
            "type": kind,
            "record_id": record_id(kind, response),
            "content_type": mime,
            "content_length": len(octets),
            "block_digest": digest(octets),
            "payload_digest": digest(octets) if kind == "conversion" else None,
        }
        headers = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", own["record_id"]),
            ("WARC-Date", date),
            ("WARC-Target-URI", target),
            ("WARC-Refers-To", response),
            ("WARC-Refers-To-Target-URI", target),
            ("WARC-Refers-To-Date", date),
            ("WARC-Block-Digest", own["block_digest"]),
            ("WARC-Payload-Digest", own["payload_digest"]),
            ("Content-Type", mime),
            ("Content-Length", str(len(octets))),
        ]
        out.append(common | own | {"record": as_record(headers, block)})
    return out


def derive(rows: DataFrame) -> DataFrame:
    """Two rows per response: `source` and the columns of RECORD."""
    names = [part.strip().split()[0] for part in RECORD.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, max(1, len(batch)), 500):
                part = batch.iloc[at : at + 500]
                found = [
                    {"source": s} | row
                    for s, *own in part[["source", "target_uri", "date", "http_headers", "payload"]].itertuples(index=False)
                    for row in derived(s, *own)
                ]
                yield pd.DataFrame(found, columns=["source", *names])

    bounded_batches(rows.sparkSession)
    narrow = rows.select(F.col("source").cast("string").alias("source"), "target_uri", "date", "http_headers", "payload")
    return narrow.mapInPandas(run, f"source string, {RECORD}")


def write_records(records: DataFrame, path: str, record: Column | None = None) -> None:
    """Gzip files of records, one after another."""
    column = F.col("record") if record is None else record
    records.select(column.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
