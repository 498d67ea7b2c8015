"""Operator 1: archives round-trip exactly and revisits point at the smallest page id."""

import base64
import hashlib

from replaygate.llm import warc
from replaygate.session import scratch_path

ROWS = [
    (5, "http://a/\r\nX: y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "u", None), (2, "u", ""), (4, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "u", "\r\n\r\n"), (7, "u", "x" * 300_000), (8, "u", "x" * 300_000), (10, "u", "line\n"), (10, "u", "line\n"), (None, "u", "line\n"), (11, "u", "line"), (7, "v", "other"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def brute(rows):
    groups = {}
    for i, _, html in rows:
        if i is not None:
            groups[html or ""] = min(groups.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = groups.get(html or "")
        again = i is not None and first != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_equals_brute_force(spark):
    got = warc.round_trip(spark, frame(spark, ROWS), records_per_archive=3)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted(got, key=str) == brute(ROWS)


def test_payloads_survive_and_revisits_carry_none(spark):
    raw, clean = scratch_path(spark, "t"), scratch_path(spark, "t")
    warc.write_archives(warc.crawl_records(frame(spark, ROWS)), raw, 4)
    assert sorted((r.page_id or -1, r.payload) for r in warc.read_archives(spark, raw).collect()) == sorted((i or -1, h or "") for i, _, h in ROWS)
    warc.deduplicate_archives(spark, raw, clean, min_bytes=6)
    for r in warc.read_archives(spark, clean).collect():
        assert r.payload == ("" if r.record_type == "revisit" else next(h or "" for i, _, h in ROWS if i == r.page_id and warc_digest(h) == r.payload_digest))
        assert r.record_type == "response" or r.payload_bytes >= 6


def warc_digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_empty_table(spark):
    assert warc.round_trip(spark, frame(spark, ROWS).limit(0)).count() == 0
