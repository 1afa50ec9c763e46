"""Archives: round trips, archives of other makers, and captures put together."""

from __future__ import annotations

import base64
import gzip
import hashlib
import pathlib
import re

import pytest

from rankloom.llm import queries, warc
from rankloom.session import fresh_path

SF_DIR = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, record_id string, digest string, row long, kind string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], PAGES)


def base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def brute(rows):
    """The rows of the query, for pages without repeated ids."""
    last, out = {}, []
    for page_id, _, html in rows:
        last[html or ""] = max(page_id, last.get(html or "", page_id))
    for page_id, _, html in rows:
        raw, top = (html or "").encode(), last[html or ""]
        again = page_id != top
        out.append((page_id, len(raw), base32(raw), "revisit" if again else "response", top if again else None))
    return sorted(out)


def archived(spark, pages, **how):
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path, **how)
    return path


def page_rows(spark, path):
    rows = warc.page_payloads(spark, path).collect()
    assert all(r["intact"] for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


ODD = [
    (1, "http://a.example/x?y=1", "<p>one</p>"),
    (2, None, None),
    (3, "", ""),
    (4, "http://a.example/ b\r\nX: 1", "<p>one</p>"),
    (5, "no scheme", "tail\r\n\r\n"),
    (6, "http://ü.example/ß", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 999999\r\n\r\n"),
    (7, "http://user@b.example:80", "WARC/1.1\r\n\r\n" * 3),
    (8, "http://b.example/long", "word " * 200_000),
    (9, "http://b.example/z", "\x00\x1f \U0001f600\n\r\n\r\n\r\nWARC/1."),
    (10, "http://b.example/z", "last"),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_of_odd_pages(spark, compression):
    path = archived(spark, table(spark, ODD).repartition(3), compression=compression)
    assert page_rows(spark, path) == sorted(brute(ODD), key=str)
    kept = {r["response"]["payload_bytes"]: r["response"]["payload"] for r in warc.captures(warc.read_records(spark, path)).collect()}
    for _, _, html in ODD:
        raw = (html or "").encode()
        assert bytes(kept[len(raw)]) == raw


def test_one_file_read_in_small_splits(spark):
    path = archived(spark, table(spark, ODD).coalesce(1), compression="none")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert page_rows(spark, path) == sorted(brute(ODD), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_payloads_that_end_like_a_record(spark):
    """Record ends at every place of the reader's buffer, more than one behind the other."""
    rows = [(k, "u", "x" * (k % 97) + "\r\n" * (k % 5)) for k in range(4000)]
    path = archived(spark, table(spark, rows).coalesce(1))
    assert page_rows(spark, path) == sorted(brute(rows), key=str)


def test_query_on_its_table(spark):
    found = queries.QUERIES["op13_warc_transactions"](spark, SF_DIR)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "string", "string", "bigint"]


def test_files_hold_valid_records(spark):
    path = archived(spark, table(spark, ODD[:5]).coalesce(1))
    (file,) = pathlib.Path(path).glob("part-*")
    raw, at, kinds = gzip.decompress(file.read_bytes()), 0, []
    while at < len(raw):
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and {"WARC-Record-ID", "WARC-Date", "WARC-Type"} <= set(fields)
        kinds.append(fields["WARC-Type"])
        at += len(head) + 4 + int(fields["Content-Length"])
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert at == len(raw) and sorted(set(kinds)) == ["metadata", "request", "response", "revisit"]


def test_min_bytes_repeated_ids_and_nothing(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "a much longer payload"), (4, "u", "a much longer payload")]
    got = page_rows(spark, archived(spark, table(spark, rows), min_bytes=5))
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    twice = table(spark, [(1, "u", "p"), (1, "u", "p"), (1, "u", "p"), (None, "u", "p"), (None, "v", "q")])
    got = [r[:1] + r[3:] for r in page_rows(spark, archived(spark, twice))]
    assert sorted(got, key=str) == sorted([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None)], key=str)
    empty = archived(spark, table(spark, []))
    assert warc.page_payloads(spark, empty).count() == 0
    assert warc.captures(warc.read_records(spark, empty)).count() == 0


def record(kind, id, block=b"", version="1.0", extra=(), length=None):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <{id}>", *extra, f"content-length:  {len(block) if length is None else length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def to(*ids):
    return [f"WARC-Concurrent-To: <{i}>" for i in ids]


def test_archives_of_other_makers(spark, tmp_path):
    http = ["Content-Type: application/http; msgtype=response"]
    body = bytes(range(256)) * 3 + b"\r\n\r\nWARC/1.0\r\nContent-Length: 1\r\n\r\n"
    digest = base32(body)
    answer = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    members = [
        record("warcinfo", "info", b"software: other"),
        record("response", "r1", answer, extra=[*http, f"WARC-Payload-Digest: sha1:{digest}", "WARC-Target-URI:\r\n http://folded.example/"]),
        record("request", "q1", b"GET / HTTP/1.0\r\n\r\n", extra=to("r1")),
        # Metadata names the request only, and what it names by other records.
        record("metadata", "m1", b"a: 1", extra=to("q1")),
        record("metadata", "m0", b"a: 0", extra=to("nowhere", "q1")),
        # The response names its request, which names nothing.
        record("request", "q2", b"GET /2", version="1.1"),
        record("response", "r2", answer, version="1.1", extra=[*http, "WARC-Payload-Digest: sha1:" + "A" * 32, *to("q2")]),
        record("resource", "s3", b"plain", extra=["Content-Type: text/plain"]),
        # A request whose response is missing, and one that is alone.
        record("request", "q4", b"GET /4", extra=to("gone")),
        record("metadata", "m4", b"b: 4", extra=to("gone")),
        record("request", "q5", b"GET /5"),
        record("response", "r6", b"HTTP/1.1 200 OK\r\n\r\ncut", extra=http, length=5000),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "two.warc").write_bytes(record("resource", "t1", b"WARC/1.0\r\n\r\n", extra=["Content-Type: text/plain"]))
    records = warc.read_records(spark, str(tmp_path))
    found = {r["record_id"]: r for r in records.collect()}
    assert set(found) == {re.search(rb"Record-ID: <(\w+)>", m)[1].decode() for m in members} | {"t1"}
    assert found["r1"]["target_uri"] == "http://folded.example/" and bytes(found["r1"]["block"]) == answer
    assert found["m0"]["concurrent_to"] == ["nowhere", "q1"]
    assert [k for k, r in found.items() if r["truncated"]] == ["r6"]
    rows = {r["capture"]: r for r in warc.captures(records).collect()}
    assert set(rows) == {"r1", "r2", "s3", "gone", "q5", "r6", "t1"}
    one = rows["r1"]
    assert (one["n_requests"], one["n_metadata"], one["request"]["record_id"], one["metadata"]["record_id"]) == (1, 2, "q1", "m0")
    assert bytes(one["response"]["payload"]) == body and one["response"]["intact"] and one["response"]["digest"] == digest
    assert rows["r2"]["request"]["text"] == "GET /2" and rows["r2"]["response"]["intact"] is False
    assert bytes(rows["s3"]["response"]["payload"]) == b"plain" and rows["s3"]["response"]["http"] is None
    lost = rows["gone"]
    assert lost["response"] is None and (lost["n_requests"], lost["n_metadata"]) == (1, 1) and lost["request"]["record_id"] == "q4"
    assert rows["q5"]["n_requests"] == 1 and bytes(rows["t1"]["response"]["payload"]) == b"WARC/1.0\r\n\r\n"


def test_plans_stay_in_the_jvm(spark):
    found = warc.page_payloads(spark, archived(spark, table(spark, ODD[:3])))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
