"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as a response (or a revisit that refers to the response with the same payload),
its request and its metadata record; request and metadata name the capture by WARC-Concurrent-To.
Reading parses records by their Content-Length, plain or gzip members, and assembly joins the
records of a capture through those identifiers, chains included, into one nested row.

Archives are written and read by Spark's own file sources, in the shared folder. Captures are packed
by running bytes, so a file holds FILE_BYTES and one capture at most; a lost executor repeats its
files only.

Defined cases: a null payload is empty; a null URL has no target header; line breaks in a URL are
percent-encoded; repeated rows are captures of their own; records of equal identifiers are one
record; concurrent-to identifiers that name no record, or only each other, belong to no capture; an
empty table writes and reads no records. What can't be read gives one row with a status and no
identifier, and the rest of the archive or the other archives are read on: bad_gzip (the members
before it count), bad_length (Content-Length is no number; the archive ends there), truncated (the
block ends before its length). Zero bytes after a gzip member are padding.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import Scratch, cut_table, scratch_path

REVISIT_LEAST = 1000
FILE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
OK = "ok"
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record types that stand for a capture; others join one.
ROOTS = ("response", "revisit", "resource")

RECORD = "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, head string, payload binary, payload_bytes long, payload_digest string, status string"


def record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record as text, headers without a value left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise("") for k, v in ((k, F.lit(v) if isinstance(v, str) else v) for k, v in headers)]
    return F.concat(F.lit(f"{VERSION}\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def captures_of(pages: DataFrame, scratch: Scratch, least: int = REVISIT_LEAST) -> DataFrame:
    """page_id, url, payload, digest, id, refers_to (the id of the response whose payload a revisit repeats, else null).

    Of equal payloads of at least least bytes that of the largest page_id is the response. Rows that are
    repeated are few or one hot row: they are counted, and numbered apart, without being gathered.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    base = base.withColumn("row", record_id("response", F.col("page_id"), F.col("url"), F.col("digest")))
    narrow = scratch.table(base.select("row", "digest", "n"))
    again = scratch.table(narrow.groupBy("row").agg(F.count("*").alias("times")).where("times > 1"))
    if again.isEmpty():
        base = base.withColumn("copy", F.lit(0))
    else:
        own = ["row", "page_id", "url", "payload", "digest", "n"]
        counted = base.join(again, "row", "left_semi").groupBy(*own).agg(F.count("*").cast("int").alias("times"))
        numbered = counted.select(*own, F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
        base = base.join(again, "row", "left_anti").select(*own, F.lit(0).alias("copy")).union(numbered)
    base = base.withColumn("id", F.when(F.col("copy") == 0, F.col("row")).otherwise(record_id("response", F.col("row"), F.col("copy"))))
    # as tables their sizes are known, and payloads need not be shuffled where repeated ones are few
    repeated = scratch.table(narrow.where(F.col("n") >= least).groupBy("digest", "n").agg(F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    best = base.join(repeated, ["digest", "n"], "left_semi").groupBy("digest", "n").agg(F.max(F.struct("page_id", "id")).alias("best"))
    joined = base.join(scratch.table(best), ["digest", "n"], "left")
    refers = F.when(F.col("page_id") < F.col("best.page_id"), F.col("best.id"))
    refers = F.when(F.col("page_id").isNull() & (F.col("id") != F.col("best.id")), F.col("best.id")).otherwise(refers)
    return joined.select("page_id", "url", "payload", "digest", "id", refers.alias("refers_to"))


def write_archive(captures: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes the three records of each capture, gzipped; a file holds file_bytes at most, or one capture."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for value in batch.column("value"):
                one = value.as_buffer()
                if held and size + one.size > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
                held.append(one.to_pybytes())
                size += one.size
        if held:
            # the sink ends each row with \n, the last byte of the last record
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(""))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    own = [("WARC-Target-URI", url), ("WARC-Date", DATE)]
    first = record([("WARC-Type", kind), ("WARC-Record-ID", F.col("id")), *own, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), PROFILE)), ("Content-Type", "application/http;msgtype=response")], response)
    request_id = record_id("request", F.col("id"))
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", request_id), *own, ("WARC-Concurrent-To", F.col("id")), ("Content-Type", "application/http;msgtype=request")], F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    fields = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", F.col("id"))), *own, ("WARC-Concurrent-To", request_id), ("Content-Type", "application/warc-fields")], fields)
    text = F.concat(first, request, metadata).cast("binary")
    rows = captures.select(text.alias("value")).mapInArrow(pack, "value binary")
    value = F.expr("substring(value, 1, octet_length(value) - 1)").cast("string")
    rows.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path, compression="gzip", lineSep="\n")


def unzipped(raw: bytes) -> tuple[bytes, bool]:
    """Content of the gzip members, and whether all of them could be read; zeros after a member are padding."""
    plain, rest = [], raw
    while rest.strip(b"\0"):
        unzip = zlib.decompressobj(31)
        try:
            member = unzip.decompress(rest) + unzip.flush()
        except zlib.error:
            return b"".join(plain), False
        if not unzip.eof:
            return b"".join(plain), False
        plain.append(member)
        rest = unzip.unused_data.lstrip(b"\0")
    return b"".join(plain), True


def parse_records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes, str]]:
    """Headers, block and status of an archive's records; stops at bytes that begin no record."""
    whole = True
    if raw[:2] == b"\x1f\x8b":
        raw, whole = unzipped(raw)
    at = 0
    while raw.startswith(b"WARC/", at):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            yield [], b"", "truncated"
            break
        headers = []
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                headers.append((name.strip().lower(), value.strip()))
        length = dict(headers).get("content-length", "0")
        if not (length.isascii() and length.isdigit()):
            yield [], b"", "bad_length"
            break
        block = raw[end + 4 : end + 4 + int(length)]
        if len(block) < int(length):
            yield [], b"", "truncated"
            break
        yield headers, block, OK
        at = end + 4 + int(length) + 4
    if not whole:
        yield [], b"", "bad_gzip"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, one row each; what can't be read has a status other than ok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for content in batch.column("content"):
                for headers, block, status in parse_records(content.as_py()):
                    h = dict(headers)
                    head, _, body = block.partition(b"\r\n\r\n") if "application/http" in h.get("content-type", "") else (b"", b"", block)
                    kind = h.get("warc-type")
                    size = digest = None
                    if kind != "revisit" and status == OK:
                        size, digest = len(body), hashlib.sha1(body).hexdigest()
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), [v for k, v in headers if k == "warc-concurrent-to"], h.get("warc-refers-to"), head.decode("utf-8", "replace"), body if status == OK else None, size, digest, status))
                    held += len(block) + 500
                    if held >= BATCH_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def parts(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per capture without its payload: record_id, type, refers_to, payload_bytes, payload_digest, n_records (how
    often its record is there), and requests and metadata as arrays of structs.

    Followers find their capture through concurrent-to identifiers; pointers are doubled until none
    leads to another follower.
    """
    cut = scratch.table
    root = F.col("type").isin(*ROOTS)
    records = records.where(F.col("status") == OK)
    slim = cut(records.select(*(F.when(~root, F.col(c)).alias(c) if c in ("payload", "head") else F.col(c) for c in records.columns if c != "status")))
    own = F.struct("type", "refers_to", "payload_bytes", "payload_digest")
    roots = slim.where(root).groupBy("record_id").agg(F.min(own).alias("own"), F.count("*").alias("n_records")).select("record_id", "own.*", "n_records")
    follows = slim.where(~root).select("record_id", F.explode("concurrent_to").alias("to")).where("record_id <> to").distinct()
    root_ids = roots.select(F.col("record_id").alias("to"), F.lit(True).alias("ends"))
    state = cut(follows.join(root_ids, "to", "left").select("record_id", "to", F.coalesce("ends", F.lit(False)).alias("ends")))
    links = state.where("ends").select("record_id", "to")
    open_ = state.where("not ends")
    while not open_.isEmpty():
        step = links.select(F.col("record_id").alias("to"), F.col("to").alias("far"))
        found = open_.join(step, "to").select("record_id", F.col("far").alias("to"))
        grown = cut(links.union(found).distinct())
        open_ = cut(open_.join(step.select("to"), "to", "left_anti"))
        if found.isEmpty():
            break
        links = grown
    members = slim.where(~root).dropDuplicates(["record_id"]).join(links, "record_id")
    item = F.struct("record_id", "type", "uri", "date", "head", "payload")
    grouped = members.groupBy(F.col("to").alias("record_id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", item))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", item))).alias("metadata"),
    )
    return roots.join(grouped, "record_id", "left")


def with_payload(captures: DataFrame, records: DataFrame) -> DataFrame:
    """captures, a table of one row per record_id, with uri, date, head and payload of their records: the one step that moves payloads."""
    roots = records.where((F.col("status") == OK) & F.col("type").isin(*ROOTS)).select("record_id", "uri", "date", "head", "payload")
    if not captures.where("n_records > 1").isEmpty():
        roots = roots.dropDuplicates(["record_id"])
    return roots.join(captures.drop("n_records"), "record_id")


def assemble(records: DataFrame, scratch: Scratch) -> DataFrame:
    """The nested row of each capture: its own columns, payload included, requests and metadata.

    records is read twice; an archive may be handed in as it is read.
    """
    return with_payload(scratch.table(parts(records, scratch)), records)


def write_pages(pages: DataFrame) -> str:
    """Writes pages as an archive in the shared folder; gives its path."""
    path = scratch_path(pages.sparkSession, "archive")
    with Scratch(pages.sparkSession, "warc") as scratch:
        write_archive(captures_of(pages, scratch), path)
    return path


def round_trip(pages: DataFrame) -> DataFrame:
    """One row per page out of its assembled capture: page_id, payload_bytes, payload_digest (of a revisit those of the
    response that it refers to), record_type, refers_to (that response's page_id), and the capture's parts:
    response_head, payload (a revisit's own is empty), requests and metadata as JSON arrays of (uri, date, head, block).

    The archive stays in the shared folder, and payloads are read from it.
    """
    spark = pages.sparkSession
    records = read_archive(spark, write_pages(pages))
    page = F.regexp_extract(F.col("metadata")[0]["payload"].cast("string"), "(?m)^page_id: (-?[0-9]+)", 1)
    shown = lambda c: F.to_json(F.transform(c, lambda x: F.struct(x["uri"].alias("uri"), x["date"].alias("date"), x["head"].alias("head"), x["payload"].cast("string").alias("block"))), {"ignoreNullFields": "false"})
    with Scratch(spark, "warc") as scratch:
        rows = scratch.table(parts(records, scratch).withColumns({"page_id": F.when(page != "", page).cast("long"), "requests": shown("requests"), "metadata": shown("metadata")}))
        full = rows.where("type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("p"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
        rows = cut_table(rows.join(full, "refers_to", "left"), "captures")
    return with_payload(rows, records).select(
        "page_id",
        F.coalesce("payload_bytes", "b").alias("payload_bytes"),
        F.coalesce("payload_digest", "d").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("p").alias("refers_to"),
        F.col("head").alias("response_head"),
        F.col("payload").cast("string").alias("payload"),
        "requests",
        "metadata",
    )
