"""URL filtering with a sorted digest array.

Rules are strings host/path; a rule fits its host and every subdomain if the URL's path starts with
the rule's path, and the longest fitting rule decides. The index is one file: 64-bit xxhash digests
in order, offsets, verdicts and the rule strings. It is written to the shared folder, goes to each executor once as a Spark file and
is memory-mapped there; each batch is probed by one vectorised binary search, and every hit is
confirmed against the stored string.

Defined cases: a null URL or one without :// has an empty host and path and fits no rule; URLs that
fit none are allowed; repeated rows each get a row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import shared_dir, write_bytes

ALLOW, BLOCK = 0, 1
VERDICTS = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def build_index(rules: Sequence[tuple[str, str]]) -> bytes:
    """File content: counts, digests, offsets, verdicts, path lengths in use, strings. Later rules replace equal earlier ones."""
    own = {rule: VERDICTS.index(verdict) for verdict, rule in rules}
    entries = sorted((xxhash.xxh64_intdigest(rule.encode()), rule.encode(), verdict) for rule, verdict in own.items())
    lengths = sorted({len(rule.partition("/")[2]) + 1 if "/" in rule else 0 for rule in own})
    offsets = np.concatenate(([0], np.cumsum([len(e[1]) for e in entries]))).astype(np.uint64)
    parts = [np.array([len(entries), len(lengths)], np.uint64), np.array([e[0] for e in entries], np.uint64), offsets, np.array(lengths, np.uint64), np.array([e[2] for e in entries], np.uint64)]
    return b"".join(p.tobytes() for p in parts) + b"".join(e[1] for e in entries)


class DigestIndex:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view(np.uint64))
        numbers = raw[16 : 16 + 8 * (3 * n + m + 1)].view(np.uint64)
        self.digests, self.offsets, self.lengths, self.verdicts = np.split(numbers, [n, 2 * n + 1, 2 * n + 1 + m])
        self.strings = raw[16 + 8 * (3 * n + m + 1) :]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Entry numbers, -1 where a probe is no entry."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        lo = np.searchsorted(self.digests, digests, "left")
        hi = np.searchsorted(self.digests, digests, "right")
        out = np.full(len(probes), -1)
        for i in np.flatnonzero(hi > lo):
            for e in range(lo[i], hi[i]):
                if self.strings[int(self.offsets[e]) : int(self.offsets[e + 1])].tobytes() == probes[i]:
                    out[i] = e
        return out


def probes_of(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """Every suffix of the host at a label's start with every prefix of the path that some rule is as long as, longest first."""
    out, at = [], 0
    while host:
        out += [(host[at:] + path[:n]).encode() for n in lengths if n <= len(path)]
        at = host.find(".", at) + 1
        if not at:
            break
    return sorted(out, key=len, reverse=True)


def publish(spark: SparkSession, content: bytes) -> str:
    """Ships the index to all executors, present and later ones, from the shared folder; gives its name there."""
    name = f"urlrules-{hashlib.sha256(content).hexdigest()[:16]}.bin"
    if not any(str(x).endswith(name) for x in spark.sparkContext.listFiles):
        path = f"{shared_dir(spark)}/quillstone/{name}"
        write_bytes(spark, path, content)
        spark.sparkContext.addFile(path)
    return name


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages."""
    name = publish(pages.sparkSession, build_index(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(SparkFiles.get(name))
        lengths = index.lengths.astype(int).tolist()
        for batch in batches:
            probes, owners = [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                own = probes_of(host, path, lengths)
                probes += own
                owners += [i] * len(own)
            found = index.find(probes)
            rule: list[str | None] = [None] * batch.num_rows
            verdict = [VERDICTS[ALLOW]] * batch.num_rows
            for p in np.flatnonzero(found >= 0)[::-1]:
                rule[owners[p]] = probes[p].decode()
                verdict[owners[p]] = VERDICTS[int(index.verdicts[found[p]])]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = split_url(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
