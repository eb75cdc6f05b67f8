"""Incremental line dedup over sharded cuckoo filters and exact reference counts.

A line's key is the line stripped of ASCII white space and lower-cased (A-Z); keys are held as MD5
digests. The exact table (key, refs) counts the documents that hold a key; it is one shuffle with
map-side sums, so a line of a third of all documents is no hot key. Keys at or over the threshold
are common: all their lines go. Each shard of the common keys has a cuckoo filter of 16-bit
fingerprints, from which keys can be taken out again, so that documents can be inserted and
deleted at any time.

There is one way at every size. The digests of every document's lines go to their shard, where the
shard's filter is probed and its hits are confirmed among the shard's exact keys; what is confirmed
comes back to its document by a hash of the row. A shard's digests are dealt to as many parts as
its reference counts call for, so neither a hot line nor a hot shard is one task, and every part
holds one filter and the keys of one shard, which SHARD_KEYS bounds.

Defined cases: null and empty texts are one empty line; empty keys are never common; rows of one
doc_id are one document, whose lines count once, and rows of a null doc_id count each; every row is
returned; an empty table gives empty tables; columns named n_lines, n_dropped or kept are replaced by
apply() and kept by drop_common_lines(). Documents that are inserted are taken to be new ones.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import map_groups
from .runtime import cut_table, drop_table

THRESHOLD, SHARD_KEYS = 10, 50_000
#: Digests of one probing task, about.
PROBE_ROWS = 300_000
HELD_KEYS = 200_000
SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def digest_of(line: bytes) -> bytes | None:
    key = key_of(line)
    return hashlib.md5(key).digest() if key else None


class CuckooFilter:
    """16-bit fingerprints in buckets of four; power-of-two buckets; supports removal."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, (int(capacity / SLOTS / 0.85)).bit_length())
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table

    @staticmethod
    def places(digests: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of an (n, 2) array of 64-bit digest halves."""
        low = digests[:, 1]
        print_ = np.maximum(low & np.uint64(0xFFFF), np.uint64(1))
        mask = np.uint64(buckets - 1)
        first = (low >> np.uint64(16)) & mask
        return print_.astype(np.uint16), first.astype(np.int64), (first ^ CuckooFilter.spread(print_, mask)).astype(np.int64)

    @staticmethod
    def spread(print_: np.ndarray, mask: np.uint64) -> np.ndarray:
        return ((print_ * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & mask

    def contains(self, digests: np.ndarray) -> np.ndarray:
        p, a, b = self.places(digests, len(self.table))
        return ((self.table[a] == p[:, None]) | (self.table[b] == p[:, None])).any(axis=1)

    def add(self, digests: np.ndarray) -> bool:
        """False where an entry found no place; the filter is then to be built anew, larger."""
        p, a, b = (x.tolist() for x in self.places(digests, len(self.table)))
        mask = np.uint64(len(self.table) - 1)
        for print_, one, two in zip(p, a, b):
            at = one
            for kick in range(500):
                for bucket in (one, two) if not kick else (at,):
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = print_
                        break
                else:
                    slot = kick % SLOTS
                    print_, self.table[at, slot] = int(self.table[at, slot]), print_
                    at = at ^ int(self.spread(np.array([print_], np.uint64), mask)[0])
                    continue
                break
            else:
                return False
        return True

    def remove(self, digests: np.ndarray) -> None:
        """Takes out entries that were added before."""
        p, a, b = (x.tolist() for x in self.places(digests, len(self.table)))
        for print_, one, two in zip(p, a, b):
            for bucket in (one, two):
                slot = np.flatnonzero(self.table[bucket] == print_)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break

    @classmethod
    def of(cls, digests: np.ndarray) -> CuckooFilter:
        capacity = len(digests)
        while True:
            out = cls(capacity)
            if out.add(digests):
                return out
            capacity = 2 * capacity + SLOTS


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


def line_counts(docs: DataFrame) -> DataFrame:
    """(key, refs): the documents that hold each key; rows are summed before they are shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["key", "refs"])
            held.clear()
            return out

        for batch in batches:
            for value in batch.column("raw"):
                raw = value.as_buffer()
                if raw is None:
                    continue
                held.update({d for line in raw.to_pybytes().split(b"\n") if (d := digest_of(line))})
                if len(held) >= HELD_KEYS:
                    yield flush()
        if held:
            yield flush()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(batch.column("doc_id"), batch.column("raw")):
                if (raw := value.as_buffer()) is not None:
                    keys = list({d for line in raw.to_pybytes().split(b"\n") if (d := digest_of(line))})
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(keys), pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        counts = rows.mapInArrow(sums, "key binary, refs long")
    else:
        alone = rows.join(again, "doc_id", "left_anti").mapInArrow(sums, "key binary, refs long")
        pairs = rows.join(again, "doc_id", "left_semi").mapInArrow(each, "doc_id long, key binary").distinct()
        counts = alone.union(pairs.select("key", F.lit(1).cast("long").alias("refs")))
    return counts.groupBy("key").agg(F.sum("refs").alias("refs"))


def merge_counts(*signed: tuple[DataFrame, int]) -> DataFrame:
    """Sum of tables (key, refs) times their signs; keys that no document holds any more go."""
    union = None
    for counts, sign in signed:
        part = counts.select("key", (F.col("refs") * sign).alias("refs"))
        union = part if union is None else union.union(part)
    return union.groupBy("key").agg(F.sum("refs").alias("refs")).where("refs > 0")


def shard_of(shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long"), F.lit(shards))


def shards_of(digests: np.ndarray, shards: int) -> np.ndarray:
    """The same of digest halves."""
    return (digests[:, 0] >> np.uint64(32)).astype(np.int64) % shards


class LineIndex:
    """Reference counts of one collection, with insert and delete, the common keys and their filters."""

    def __init__(self, counts: DataFrame, threshold: int = THRESHOLD, shards: int | None = None, filters: DataFrame | None = None):
        self.counts, self.threshold = counts, threshold
        self.common = counts.where(F.col("refs") >= threshold).select("key")
        self.n_common = self.common.count()
        self.shards = shards or max(1, -(-self.n_common // SHARD_KEYS))
        self._filters = filters

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = THRESHOLD) -> LineIndex:
        return cls(cut_table(line_counts(docs), "lines"), threshold)

    def remove(self) -> None:
        """Deletes the tables of the index; what apply() gave stays readable."""
        drop_table(self.counts)
        if self._filters is not None:
            drop_table(self._filters)

    @property
    def filters(self) -> DataFrame:
        """(shard, bits): one cuckoo filter for each shard that has common keys; a table, for indexes that follow."""
        if self._filters is None:
            self._filters = cut_table(self.lazy_filters(), "filters")
        return self._filters

    def lazy_filters(self) -> DataFrame:
        """The filters for one reading: no table is written for it, one that is there is read."""
        if self._filters is not None:
            return self._filters

        def make(group: pa.Table) -> pa.RecordBatch:
            table = CuckooFilter.of(halves(group.column("key").to_pylist())).table
            return pa.RecordBatch.from_arrays([group.column("shard").combine_chunks().slice(0, 1), pa.array([table.tobytes()], pa.binary())], ["shard", "bits"])

        keys = self.common.select(shard_of(self.shards).alias("shard"), "key")
        return map_groups(keys, ["shard"], make, "shard long, bits binary")

    def changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = line_counts(docs)
        counts = cut_table(merge_counts((self.counts, 1), (delta, sign)), "lines")
        now = counts.where(F.col("refs") >= self.threshold).select("key")
        gained = now.join(self.common, "key", "left_anti").withColumn("kind", F.lit(1))
        lost = self.common.join(now, "key", "left_anti").withColumn("kind", F.lit(-1))
        shards = self.shards

        def update(group: pa.Table) -> pa.RecordBatch:
            kind, key = np.array(group.column("kind").to_pylist()), group.column("key").to_pylist()
            bits = [k for k, t in zip(key, kind) if t == 0]
            own = lambda t: [k for k, x in zip(key, kind) if x == t]
            table = np.frombuffer(bits[0], np.uint16).reshape(-1, SLOTS).copy() if bits else None
            filter_ = CuckooFilter(len(key), table)
            filter_.remove(halves(own(-1)))
            full = not filter_.add(halves(own(1)))
            # an overfull filter is left out; it is rebuilt from the exact table
            return pa.RecordBatch.from_arrays([group.column("shard").combine_chunks().slice(0, 1), pa.array([None if full else filter_.table.tobytes()], pa.binary())], ["shard", "bits"])

        old = self.filters.select("shard", F.col("bits").alias("key"), F.lit(0).alias("kind"))
        moves = gained.union(lost).select(shard_of(shards).alias("shard"), "key", "kind")
        filters = cut_table(map_groups(old.union(moves), ["shard"], update, "shard long, bits binary"), "filters")
        keep = filters if filters.where("bits is null").isEmpty() else None
        return LineIndex(counts, self.threshold, shards, keep)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self.changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self.changed(docs, -1)

    def common_lines(self, docs: DataFrame) -> DataFrame:
        """(row, gone): the digests of the common lines of each row, by row_key(); rows without any have none."""
        shards, parts = self.shards, self.parts()
        state = docs.sparkSession.sparkContext.broadcast(parts)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n_parts = state.value
            for batch in batches:
                rows, digests = [], []
                for row, value in zip(batch.column("row").to_pylist(), batch.column("raw")):
                    if (raw := value.as_buffer()) is not None:
                        own = {d for line in raw.to_pybytes().split(b"\n") if (d := digest_of(line))}
                        digests += own
                        rows += [row] * len(own)
                row = np.array(rows, np.int64)
                shard = shards_of(halves(digests), shards)
                part = (row.view(np.uint64) % n_parts[shard].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part), pa.array(np.ones(len(row), np.int64)), pa.array(row), pa.array(digests, pa.binary())], ["shard", "part", "kind", "row", "data"])

        def probe(group: pa.Table) -> pa.RecordBatch | None:
            kind, data = group.column("kind").to_numpy(), group.column("data")
            bits, own = (np.flatnonzero(kind == k) for k in (-1, 1))
            if not len(bits) or not len(own):
                return None
            filter_ = CuckooFilter(table=np.frombuffer(data[int(bits[0])].as_buffer(), np.uint16).reshape(-1, SLOTS))
            exact = set()
            for k in np.flatnonzero(kind == 0).tolist():
                raw = data[k].as_py()
                exact.update(raw[i : i + 16] for i in range(0, len(raw), 16))
            asked = data.take(pa.array(own)).to_pylist()
            maybe = np.flatnonzero(filter_.contains(halves(asked)))
            sure = [i for i in maybe.tolist() if asked[i] in exact]
            return pa.RecordBatch.from_arrays([group.column("row").take(pa.array(own[sure])).combine_chunks(), pa.array([asked[i] for i in sure], pa.binary())], ["row", "key"])

        rows = docs.select(row_key().alias("row"), F.col("text").cast("binary").alias("raw")).where("raw is not null")
        asked = rows.mapInArrow(deal, "shard long, part long, kind long, row long, data binary")
        # every part of a shard gets the shard's filter and its exact keys
        spread = docs.sparkSession.createDataFrame([(s, int(n)) for s, n in enumerate(parts)], "shard long, n int")
        every = lambda own, kind: own.join(F.broadcast(spread), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("part"), F.lit(kind).cast("long").alias("kind"), F.lit(0).cast("long").alias("row"), "data")
        exact = self.common.select(shard_of(shards).alias("shard"), "key").groupBy("shard").agg(F.unhex(F.array_join(F.transform(F.collect_list("key"), F.hex), "")).alias("data"))
        state_rows = every(self.lazy_filters().select("shard", F.col("bits").alias("data")), -1).union(every(exact, 0))
        found = map_groups(state_rows.union(asked), ["shard", "part"], probe, "row long, key binary")
        return found.groupBy("row").agg(F.collect_set("key").alias("gone"))

    def parts(self) -> np.ndarray:
        """Parts of each shard, by the digests that the counted documents hold there; one number for each shard."""
        out = np.ones(self.shards, np.int64)
        for r in self.counts.groupBy(shard_of(self.shards).alias("shard")).agg(F.sum("refs").alias("n")).collect():
            out[r["shard"]] = -(-r["n"] // PROBE_ROWS)
        return out

    def cleaned(self, docs: DataFrame, carry: DataFrame) -> DataFrame:
        """The columns of carry (docs with the columns __row and text) but text, and n_lines, n_dropped and kept."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_lines, n_dropped, kept = [], [], []
                for value, gone in zip(batch.column("__raw"), batch.column("__gone").to_pylist()):
                    raw = b"" if (v := value.as_buffer()) is None else v.to_pybytes()
                    n_lines.append(raw.count(b"\n") + 1)
                    if gone:
                        gone = frozenset(gone)
                        rest = [line for line in raw.split(b"\n") if digest_of(line) not in gone]
                        n_dropped.append(n_lines[-1] - len(rest))
                        raw = b"\n".join(rest)
                    else:
                        n_dropped.append(0)
                    kept.append(raw)
                names = [n for n in batch.schema.names if n not in ("__raw", "__gone")]
                columns = [batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_lines", "n_dropped", "__kept"])

        gone = cut_table(self.common_lines(docs), "common-lines")
        # one kind of join at every size; a hot row key is many equal rows, which adaptive execution splits
        source = carry.join(gone.hint("merge"), carry["__row"] == gone["row"], "left").drop("row", "__row").withColumnRenamed("gone", "__gone")
        source = source.withColumn("__raw", F.col("text").cast("binary")).drop("text")
        schema = source.drop("__raw", "__gone").withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long"), "__kept": F.lit(b"")}).schema
        for field in schema:
            field.nullable = True
        return source.mapInArrow(run, schema).withColumn("kept", F.col("__kept").cast("string")).drop("__kept")

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with columns n_lines, n_dropped and kept (the text without its common lines) in place of text."""
        return self.cleaned(docs, docs.drop("n_lines", "n_dropped", "kept").withColumn("__row", row_key()))


def row_key() -> Column:
    """A hash of doc_id and text. Rows that share one only look for each other's common lines too, which is no harm."""
    return F.xxhash64("doc_id", "text")


def drop_common_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with their columns, texts rid of lines that at least threshold documents hold; n_chars follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    carry = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__doc"), "text", row_key().alias("__row"))
    index = LineIndex.build(docs, threshold)
    out = index.cleaned(docs, carry)
    index.remove()
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("__doc.n_chars")) if "n_chars" in rest else None
    columns = [F.col("kept").alias("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)
