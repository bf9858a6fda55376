"""Derived records: links between records, digests, files read back."""

import base64
import glob
import gzip
import hashlib
import re

from spoorline.llm import warc as m
from spoorline.llm.common import shared_folder

PAGES = [
    (1, "https://a.example/x/", "<html lang=de><title>T &amp; U</title><p>one <b>two</b><p>dr&eacute;i<a href='../y?q=1'>z</a></html>"),
    (2, None, None),
    (3, "http://b.example/\r\nX: y", ""),
    (4, "http://c.example/", "<nav>menu</nav><p>" + "long " * 50_000),
    (4, "http://c.example/", "<nav>menu</nav><p>" + "long " * 50_000),
]
DATE = "2024-05-06T07:08:09Z"


def sha1(octets):
    return "sha1:" + base64.b32encode(hashlib.sha1(octets).digest()).decode()


def frame(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_records_and_links(spark):
    rows = m.derive(m.responses(frame(spark), DATE)).collect()
    assert len(rows) == 2 * len(PAGES)
    first = {r["type"]: r for r in rows if r["source"] == "1"}
    body = PAGES[0][2].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    for row in first.values():
        assert row["source_payload_digest"] == sha1(body) and row["source_block_digest"] == sha1(http + body)
        head, _, block = row["record"].partition("\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert headers["WARC-Refers-To"] == row["refers_to"] and headers["WARC-Date"] == DATE
        assert headers["WARC-Target-URI"] == PAGES[0][1] and headers["WARC-Record-ID"] == row["record_id"]
        assert int(headers["Content-Length"]) == len(block.encode()) == row["content_length"]
        assert headers["WARC-Block-Digest"] == sha1(block.encode()) == row["block_digest"]
    assert first["metadata"]["refers_to"] == first["conversion"]["refers_to"]
    assert first["conversion"]["record"].endswith("\r\n\r\none two\ndréiz")
    meta = first["metadata"]["record"]
    assert "title: T & U\r\n" in meta and "language: de\r\n" in meta
    assert "outlink: https://a.example/y?q=1 A/@href\r\n" in meta
    assert "http-header-content-type: text/html; charset=utf-8\r\n" in meta
    assert len({r["record_id"] for r in rows}) == 2 * 4 and len({r["refers_to"] for r in rows}) == 4
    assert "\r\nX: y" not in next(r["record"] for r in rows if r["source"] == "3")


def test_files_hold_the_records(spark):
    records = m.derive(m.responses(frame(spark), DATE))
    path = shared_folder(spark, "warc")
    m.write_records(records, path)
    found = []
    for name in glob.glob(f"{path.removeprefix('file:')}/*.gz"):
        octets = gzip.open(name).read()
        while octets:
            head, _, rest = octets.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            assert rest[size : size + 4] == b"\r\n\r\n"
            found.append((head + b"\r\n\r\n" + rest[:size]).decode())
            octets = rest[size + 4 :]
    assert sorted(found) == sorted(r["record"] for r in records.collect())


def test_no_rows(spark):
    assert m.derive(m.responses(frame(spark).limit(0), DATE)).collect() == []
