"""Secrets in text: named patterns and sliding-window entropy.

Base spans are the non-overlapping leftmost matches of three patterns. Added to them are spans of
kind entropy: candidate strings (runs of token characters) are searched, for each character class,
by a window whose Shannon entropy is kept up to date from incremental counts; overlapping windows at
or over the class's threshold merge into one span. A candidate that an allow-list pattern matches
adds nothing, nor does a span that lies within a base span. Base spans are never suppressed.

Offsets count code points, ends are exclusive. Defined cases: a null or empty text has no spans;
repeated rows each get a row; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

WINDOW = 20
#: Character classes of the entropy search: name, characters, least bits a character, parts that a window must all hold.
CLASSES = (
    ("hex", b"0123456789abcdefABCDEF", 2.8, (b"0123456789", b"abcdefABCDEF")),
    ("base64", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.7, (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
)
#: Candidates that are no secrets: examples, runs of the alphabet, UUIDs, integrity digests named as such.
ALLOW = (
    rb"EXAMPLE",
    rb"(?i)abcdefghijkl|0123456789abcdef|1234567890",
    rb"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rb"^(sha1|sha256|sha384|sha512|md5)[-_=]",
)


def table_of(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


IS_CANDIDATE = table_of(CLASSES[1][1])
IS_HEX = table_of(b"0123456789abcdef")
IS_ACCESS = table_of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_TERM = [0.0] + [n * math.log2(n) for n in range(1, 4096)]


def hot_windows(run: bytes, window: int, least: float, parts: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Merged spans of the windows of run that hold all parts and least bits of entropy a character."""
    if len(run) < window:
        return []
    counts = [0] * 256
    group = [-1] * 256
    for g, characters in enumerate(parts):
        for c in characters:
            group[c] = g
    held = [0] * (len(parts) + 1)
    total, out = 0.0, []
    for i, c in enumerate(run):
        total += _TERM[counts[c] + 1] - _TERM[counts[c]]
        counts[c] += 1
        held[group[c]] += 1
        if i >= window:
            o = run[i - window]
            total += _TERM[counts[o] - 1] - _TERM[counts[o]]
            counts[o] -= 1
            held[group[o]] -= 1
        if i + 1 >= window and all(held[g] for g in range(len(parts))) and math.log2(window) - total / window >= least - 1e-12:
            start = i + 1 - window
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(candidate: bytes, window: int = WINDOW, allow: tuple[re.Pattern, ...] = tuple(map(re.compile, ALLOW))) -> list[tuple[int, int]]:
    """Spans within a candidate string, of all classes, without those inside another."""
    if len(candidate) < window or any(p.search(candidate) for p in allow):
        return []
    out: list[tuple[int, int]] = []
    for _, characters, least, parts in CLASSES:
        for m in re.finditer(rb"[%s]{%d,}" % (re.escape(characters), window), candidate):
            out += [(m.start() + a, m.start() + b) for a, b in hot_windows(m[0], window, least, parts)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def long_runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    starts, ends, rows = B.spans(inside, offsets)
    for i in np.flatnonzero(ends - starts >= least).tolist():
        yield int(rows[i]), int(starts[i]), int(ends[i])


def scan_slice(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (start, kind number, end) in bytes of the rows that have any."""
    raw, found = data.tobytes(), {}
    low = B.LOWER[data].tobytes()
    rows = set()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
            at = low.find(word, int(offsets[np.searchsorted(offsets, at, "right")]))
    for row in rows:
        for m in ASSIGN.finditer(raw[offsets[row] : offsets[row + 1]]):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.setdefault(row, []).append((m.start(), 0, m.end()))
    for row, a, b in long_runs(IS_ACCESS[data], offsets, ACCESS_LEAST):
        at = raw.find(b"AKIA", a, b)
        if at >= 0 and b - at >= ACCESS_LEAST:
            found.setdefault(row, []).append((at - int(offsets[row]), 1, b - int(offsets[row])))
    for row, a, b in long_runs(IS_HEX[data], offsets, HEX_LEAST):
        found.setdefault(row, []).append((a - int(offsets[row]), 2, b - int(offsets[row])))
    base = {row: list(spans) for row, spans in found.items()}
    for row, a, b in long_runs(IS_CANDIDATE[data], offsets, WINDOW):
        for x, y in entropy_spans(raw[a:b]):
            x, y = x + a - int(offsets[row]), y + a - int(offsets[row])
            if not any(s <= x and y <= e for s, _, e in base.get(row, ())):
                found.setdefault(row, []).append((x, 3, y))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row: array of (kind, start, end), by start and then kind as in KINDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = B.flat(batch.column("text"))
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j in B.slices(offsets):
                part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for row, spans in scan_slice(part, offs).items():
                    own = part[offs[row] : offs[row + 1]]
                    inner = np.concatenate(([0], np.cumsum((own & 0xC0) == 0x80)))
                    out[i + row] = [{"kind": KINDS[k], "start": int(a - inner[a]), "end": int(b - inner[b])} for a, k, b in sorted(spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind_type)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def base_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
