import gzip
import hashlib
import json
import os
import random

from pyspark.sql import functions as F

from quillstone.llm import warc as W
from quillstone.llm.runtime import Scratch


def test_round_trip_against_brute_force(spark):
    big, tricky = "é" * 600, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 60
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "http://b/\r\nX: y", big), (2, None, None), (4, "http://c", ""), (6, "http://d", "small"), (7, "http://e", "small"), (8, "http://f", tricky), (9, "http://g", tricky), (10, "http://h", "x\r\n\r\ny\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit("clash"))
    out = {r["page_id"]: r for r in W.round_trip(pages).collect()}
    got = {i: tuple(r)[1:5] for i, r in out.items()}
    want = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        last = max(j for j, _, h in rows if (h or "").encode() == raw)
        revisit = len(raw) >= 1000 and last != i
        want[i] = (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
    assert got == want
    for i, url, html in rows:
        assert out[i]["payload"] == ("" if want[i][2] == "revisit" else html or "") and out[i]["response_head"].startswith("HTTP/1.1 200 OK")
        (asked,), (told,) = json.loads(out[i]["requests"]), json.loads(out[i]["metadata"])
        assert told["block"] == f"page_id: {i}\r\n" and asked["block"] == "" and asked["head"].startswith("GET ")
        assert asked["uri"] == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)
    assert W.round_trip(pages.limit(0)).count() == 0


def archive(*records):
    out = b""
    for headers, block in records:
        head = "".join(f"{k}: {v}\r\n" for k, v in headers)
        out += f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


def test_assembly_follows_chains(spark, tmp_path):
    http = [("Content-Type", "application/http;msgtype=response")]
    data = archive(
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>")], b"software: x"),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), *http], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"),
        ([("WARC-Type", "request"), ("WARC-Record-ID", "<q>"), ("WARC-Concurrent-To", "<r>")], b"GET /"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m>"), ("WARC-Concurrent-To", "<q>")], b"k: v"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<n>"), ("WARC-Concurrent-To", "<m>")], b"far"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<x>"), ("WARC-Concurrent-To", "<y>")], b"loop"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<y>"), ("WARC-Concurrent-To", "<x>")], b"loop"),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), *http], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"),
    )
    (tmp_path / "plain.warc").write_bytes(data)
    records = W.read_archive(spark, f"file://{tmp_path}").cache()
    assert records.count() == 8
    with Scratch(spark, "t") as scratch:
        rows = W.assemble(records, scratch).collect()
    assert len(rows) == 1
    assert bytes(rows[0]["payload"]) == b"body" and rows[0]["head"].startswith("HTTP/1.1 200")
    assert [bytes(x["payload"]) for x in rows[0]["requests"]] == [b"GET /"]
    assert {bytes(x["payload"]) for x in rows[0]["metadata"]} == {b"k: v", b"far"}


def test_gzip_members():
    data = archive(([("WARC-Type", "response"), ("WARC-Record-ID", "<r>")], b"one"), ([("WARC-Type", "request")], b"two"))
    half = data.index(b"WARC/1.1", 5)
    packed = gzip.compress(data[:half]) + gzip.compress(data[half:])
    assert [b for _, b, _ in W.parse_records(packed)] == [b"one", b"two"]
    assert [b for _, b, _ in W.parse_records(packed + bytes(512))] == [b"one", b"two"]
    assert list(W.parse_records(b"")) == []


def test_repeated_rows_are_captures_of_their_own(spark):
    big = "z" * 1500
    rows = [(1, "u", big)] * 3 + [(2, "u", big)] * 2 + [(3, None, None)] * 2 + [(4, "v", "w"), (None, "n", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in W.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 1500)] * 3 + [(2, "response", None, 1500)] * 2 + [(3, "response", None, 0)] * 2 + [(4, "response", None, 1)] + [(None, "revisit", 2, 1500)] * 2, key=str)


def test_broken_archives_give_status_rows(spark, tmp_path):
    good = archive(([("WARC-Type", "response"), ("WARC-Record-ID", "<r>")], b"one"), ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m>"), ("WARC-Concurrent-To", "<r>")], b"two"))
    files = {
        "length": good + good.replace(b"Content-Length: 3", b"Content-Length: x"),
        "cut": good[:-6],
        "head": good + b"WARC/1.1\r\nWARC-Type: res",
        "gzip": gzip.compress(good) + gzip.compress(good)[:40],
        "noise": gzip.compress(good) + b"no gzip",
        "padded": gzip.compress(good) + bytes(600),
        "negative": good.replace(b"Content-Length: 3", b"Content-Length: -3"),
        "empty": b"",
        "fine": good,
    }
    want = {"length": ["ok", "ok", "bad_length"], "cut": ["ok", "truncated"], "head": ["ok", "ok", "truncated"], "gzip": ["ok", "ok", "bad_gzip"], "noise": ["ok", "ok", "bad_gzip"], "padded": ["ok", "ok"], "negative": ["bad_length"], "empty": [], "fine": ["ok", "ok"]}
    assert {n: [s for _, _, s in W.parse_records(raw)] for n, raw in files.items()} == want
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    records = W.read_archive(spark, f"file://{tmp_path}").cache()
    assert {r["status"]: r["count"] for r in records.groupBy("status").count().collect()} == {"ok": 13, "bad_length": 2, "truncated": 2, "bad_gzip": 2}
    with Scratch(spark, "t") as scratch:
        assert [len(r["metadata"]) for r in W.assemble(records, scratch).collect()] == [1]


def test_files_are_bounded_by_bytes(spark, tmp_path):
    r = random.Random(1)
    noise = lambda n: "".join(chr(r.randrange(33, 126)) for _ in range(n))
    pages = spark.createDataFrame([(i, f"u{i}", noise(60_000 if i % 10 == 0 else 400)) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    with Scratch(spark, "t") as scratch:
        W.write_archive(W.captures_of(pages, scratch), f"file://{tmp_path}/out", 40_000)
    sizes = [len(gzip.decompress((tmp_path / "out" / f).read_bytes())) for f in os.listdir(tmp_path / "out") if f.endswith(".gz")]
    assert max(sizes) < 63_000 and sum(s > 40_000 for s in sizes) == 6 and len(sizes) > 6
