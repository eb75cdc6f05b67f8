"""Near-duplicates by Order MinHash with banded alignment.

A document's words are lower-cased; its k-mers are runs of k words, each labelled with its occurrence
number. Every sketch takes the labelled k-mers of least hash, two of them in text order where texts are
long enough, so that equal sketches point to a small edit distance, not only to shared content. Short
texts are told by fewer and shorter k-mers (LEVELS); a text near a level's bound is sketched on both
sides of it, so that any two texts of the least similarity share a level. Documents with a sketch in
common are candidates; a link needs a banded alignment of the whole word sequences with
1 - distance / longer length >= 0.8. Classes are connected components of links.

With k-mer similarity J a pair shares one of n sketches of order o with chance about 1 - (1 - J^o)^n.
Scattered substitutions at similarity 0.8 give J = 0.34 for k = 3 and 0.47 for k = 2, so 0.997 and more
of 48 sketches of order 2; tests measure it against all pairs.

Defined cases: a null text counts as empty; equal texts form one class whatever their length; a
text without words links with equal texts only; one word is one k-mer. Rows of one doc_id are one
document: each of its texts is compared, its class is the least of theirs. Rows with a null doc_id
belong to no class. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .edit import coarser, cut_points, histogram, similar, split_histograms
from .graph import components
from .grouping import map_groups
from .runtime import Scratch, cut_table, drop_table

SHINGLE, SKETCHES, ORDER, SIMILARITY = 3, 48, 2, 0.8
#: Most words of the texts of the first two levels: single k-mers of two words, ordered k-mers of two words.
LEVELS = (15, 40)
#: Rows of one bucket that one task compares with each other.
CHUNK = 2000


def labelled(shingle: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """K-mer hashes that also tell a k-mer's first occurrence in its row from its second, and so on."""
    key = B.mix(shingle ^ B.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    sorted_key = key[order]
    again = np.flatnonzero(sorted_key[1:] == sorted_key[:-1])
    out = shingle.copy()
    if len(again):
        hit = np.unique(np.concatenate((again, again + 1)))
        place = order[hit]
        by = np.lexsort((place, sorted_key[hit]))
        k, place = sorted_key[hit][by], place[by]
        first = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
        count = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
        out[place] = B.mix(shingle[place] + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out


def sketches(shingle: np.ndarray, rows: np.ndarray, n_rows: int, count: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have k-mers, count keys for each)."""
    bounds = B.row_bounds(rows, n_rows)
    sizes = np.diff(bounds)
    own = np.flatnonzero(sizes)
    if not len(own):
        return own, np.zeros((0, count), np.int64)
    starts, sizes = bounds[own], sizes[own]
    label = labelled(shingle, rows)
    at_row = np.repeat(np.arange(len(own)), sizes)
    seeds = B.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    out = np.empty((len(own), count), np.uint64)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(count):
        x = (label ^ seeds[j]) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        picks = np.empty((order, len(own)), np.int64)
        for t in range(order):
            least = np.minimum.reduceat(x, starts)
            hits = np.flatnonzero(x == least[at_row])
            owner = at_row[hits]
            keep = np.ones(len(hits), bool)
            keep[1:] = owner[1:] != owner[:-1]
            picks[t] = hits[keep]
            x[picks[t]] = most
            picks[t] = np.where(sizes > t, picks[t], -1)
        picks.sort(axis=0)
        key = np.full(len(own), seeds[j], np.uint64)
        for t in range(order):
            key = B.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(picks[t] < 0, np.uint64(0), label[picks[t]]))
        out[:, j] = key
    return own, out.view(np.int64)


def levels(least: float, order: int, k: int) -> list[tuple[int, int, int, int]]:
    """Fewest and most words, length and number of k-mers of each level; texts of the least similarity share one."""
    fewest = [0] + [int(least * (most + 1)) for most in LEVELS]
    return list(zip(fewest, (*LEVELS, 1 << 62), (min(2, k), min(2, k), k), (1, order, order)))


def sketch_table(docs: DataFrame, count: int = SKETCHES, order: int = ORDER, k: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, level, keys) of every document: count keys of its first level, then of the next ones that it
    belongs to; keys are empty where it has no words."""
    plan = levels(least, order, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.flat(batch.column("text"))
            for i, j in B.slices(offsets):
                lo, hi = offsets[i], offsets[j]
                _, _, rows, hashes = B.words(data[lo:hi], offsets[i : j + 1] - lo)
                n_words = np.bincount(rows, minlength=j - i)
                first, owners, parts = np.full(j - i, len(plan)), [], []
                for level, (fewest, most, size, picks) in enumerate(plan):
                    chosen = (n_words >= fewest) & (n_words <= most) & (n_words > 0)
                    mine = chosen[rows]
                    shingle, srows, _ = B.shingles(hashes[mine], rows[mine], j - i, size)
                    own, keys = sketches(shingle, srows, j - i, count, picks)
                    first[own] = np.minimum(first[own], level)
                    owners.append(own)
                    parts.append(B.mix(keys.view(np.uint64) + np.uint64(level)).view(np.int64))
                owner = np.concatenate(owners)
                keys = np.concatenate(parts)[np.argsort(owner, kind="stable")]
                sizes = np.bincount(owner, minlength=j - i) * count
                part = batch.slice(i, j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(first.astype(np.int32)), lists], ["doc_id", "digest", "level", "keys"])

    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    return source.mapInArrow(run, "doc_id long, digest binary, level int, keys array<long>")


def word_table(docs: DataFrame, ids: DataFrame, repeated: DataFrame) -> DataFrame:
    """(node, words) of the texts of ids (node, rep, digest): 64-bit word hashes in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.flat(batch.column("text"))
            for i, j in B.slices(offsets):
                lo, hi = offsets[i], offsets[j]
                _, _, rows, hashes = B.words(data[lo:hi], offsets[i : j + 1] - lo)
                at = B.row_bounds(rows, j - i).astype(np.int64) * 8
                raw = np.ascontiguousarray(hashes, np.uint64)
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), words.cast(pa.binary())], ["node", "words"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    rows = one_each(rows.join(ids, ["rep", "digest"]), repeated.withColumnRenamed("doc_id", "rep"), ["rep", "digest"])
    return rows.select("node", "text").mapInArrow(run, "node long, words binary")


def one_each(rows: DataFrame, repeated: DataFrame, key: list[str]) -> DataFrame:
    """rows with one row of each of the repeated keys, a table; only their rows are shuffled."""
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates(key))


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose word sequences align with the least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("wa"), batch.column("wb")):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                longer = max(len(u), len(v))
                room = (1 - least) * longer + 1e-9
                close = abs(len(u) - len(v)) <= room and np.abs(histogram(u) - histogram(v)).sum() <= 2 * room
                keep.append(bool(close and similar(u, v, least)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def gathered(links: DataFrame) -> DataFrame:
    """The links (a, b) of a wide map stage in partitions of the advised size, not a tiny file for each of its tasks."""
    return links.hint("rebalance", F.col("a"))


def compare_bucket(group: pa.Table, least: float) -> pa.RecordBatch | None:
    """Links (between classes) that a chunk pair of one bucket still lacks: documents of different classes are
    compared until their classes meet. Pairs with the bucket's hub have been compared before, and a pair of several
    buckets is compared in that of its first common sketch only."""
    i, j, turn = (group.column(c)[0].as_py() for c in ("i", "j", "turn"))
    ids = group.column("node").to_numpy()
    cls = group.column("class").to_numpy().copy()
    hub = group.column("hub").to_numpy()
    part = group.column("part").to_numpy()
    if (cls == cls[0]).all():
        return None
    words = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in group.column("words").chunks for x in chunk]
    sizes = np.array([len(w) for w in words])
    fine = np.stack([histogram(w) for w in words])
    coarse = coarser(fine)
    keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[:, :turn]
    cuts = cut_points(int(sizes.max()))
    split = np.stack([split_histograms(w, cuts) for w in words])
    found_a, found_b = [], []
    for x in range(len(ids)):
        if i != j and part[x] != i or ids[x] == hub[x]:
            continue
        at = np.arange(x + 1, len(ids)) if i == j else np.flatnonzero(part == j)
        room = (1 - least) * np.maximum(sizes[at], sizes[x]) + 1e-9
        near = (cls[at] != cls[x]) & (np.abs(sizes[at] - sizes[x]) <= room) & (ids[at] != hub[x])
        near &= ~(keys[at] == keys[x]).any(axis=1)
        at, room = at[near], room[near]
        near = np.abs(coarse[at] - coarse[x]).sum(axis=1) <= 2 * room
        at, room = at[near], room[near]
        apart = np.abs(fine[at] - fine[x]).sum(axis=1)
        # the likeliest first: once classes meet, the rest of both is settled
        near = apart <= 2 * room
        at, room, apart = at[near], room[near], apart[near]
        for c in range(len(cuts)):
            near = np.abs(split[at, c] - split[x, c]).sum(axis=(1, 2)) <= 3 * room
            at, room, apart = at[near], room[near], apart[near]
        at = at[np.argsort(apart, kind="stable")]
        for y in at.tolist():
            if cls[y] != cls[x] and similar(words[x], words[y], least):
                found_a.append(cls[x])
                found_b.append(cls[y])
                cls[cls == cls[y]] = cls[x]
    return pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])


def classes(docs: DataFrame, least: float, count: int, order: int, k: int, chunk: int) -> DataFrame:
    """(doc_id, digest, copies, group, class_id) of every document's text, a table in the shared folder: the rows of that
    doc_id and text, its class, and the smallest doc_id of this class.

    Copies of a text are sketched but compared once. Within a bucket every member is first held
    against one hub; what the hub leaves in different classes is compared exhaustively, in chunk
    pairs, so neither the rows of a bucket nor its pairs ever gather in one task. No bucket,
    candidate or partner is capped.
    """
    with Scratch(docs.sparkSession, "order-minhash") as scratch:
        table = scratch.table
        sk = table(sketch_table(docs, count, order, k, least))
        texts = table(sk.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("level").alias("level"), F.min("keys").alias("keys")))
        own = table(sk.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")))
        drop_table(sk)
        # a text is told by its smallest doc_id; only where this has several texts, by a hash
        several = table(own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("rep"), F.lit(True).alias("hashed")))
        repeated = table(own.where("copies > 1").select("doc_id", "digest"))
        node = F.when(F.col("hashed"), -1 - F.abs(F.xxhash64("digest") % (1 << 62))).otherwise(F.col("rep"))
        texts = texts.join(several, "rep", "left").select(node.alias("node"), "rep", "digest", "level", "keys")
        keys = texts.select("node", "level", F.posexplode("keys").alias("turn", "key")).withColumn("turn", F.col("turn") + F.col("level") * count)
        keys = keys.select("key", "turn", "node")
        buckets = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
        member = table(keys.join(buckets, "key").select("key", "turn", "node", "hub", "n"))
        pairs = table(member.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        words = table(word_table(docs, texts.join(ids, "node", "left_semi").select("node", "rep", "digest"), repeated))
        label = components(gathered(verified(pairs, words, least)), scratch)
        named = label.select("node", F.col("component").alias("class"))
        classed = table(member.where("n > 2").join(named, "node", "left").select("key", "turn", "node", "hub", F.coalesce("class", "node").alias("class")))
        # buckets that hold several classes; of equal buckets that of the first sketch
        mixed = classed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.min("node").alias("least"), F.min("turn").alias("turn")).where("lo <> hi")
        mixed = mixed.groupBy("size", "sum", "least", "lo", "hi").agg(F.min_by("key", F.struct("turn", "key")).alias("key")).select("key", F.ceil(F.col("size") / chunk).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        rows = classed.join(mixed, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("key", F.least("part", "other").cast("long").alias("i"), F.greatest("part", "other").cast("long").alias("j"), "node", "hub", "class", "part", "turn")
        rows = rows.join(words, "node").join(texts.select("node", "level", "keys"), "node")
        # the keys of the bucket's level
        level = F.slice("keys", ((F.floor(F.col("turn") / count) - F.col("level")) * count + 1).cast("int"), count)
        rows = rows.select("key", "i", "j", (F.col("turn") % count).alias("turn"), "node", "hub", "class", "part", "words", level.alias("keys"))
        rest = map_groups(rows, ["key", "i", "j"], lambda group: compare_bucket(group, least), "a long, b long")
        joined = components(gathered(rest), scratch).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        # a class of one text has no label yet; as a table joined's size is known, and beyond that of a broadcast
        # the labels of one giant class can be split
        merged = label.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("group"))
        alone = joined.join(label.select("node"), joined["component"] == label["node"], "left_anti")
        merged = merged.union(alone.select(F.col("component"), F.col("joined")))
        known = texts.select("node", "digest", "rep").join(merged, "node", "left").select("digest", "rep", F.coalesce("group", "node").alias("group"))
        named = known.withColumn("class_id", F.col("group"))
        if not several.isEmpty():
            # hashes are no doc_ids: a class is named by the smallest of its texts'
            known = table(known)
            names = table(known.groupBy("group").agg(F.min("rep").alias("class_id")))
            named = known.join(names, "group")
        return cut_table(own.join(named, "digest").select("doc_id", "digest", "copies", "group", "class_id"), "near-duplicates")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, count: int = SKETCHES, order: int = ORDER, k: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, class_id (its class's smallest doc_id), kept (doc_id = class_id)."""
    out = classes(docs, least, count, order, k, chunk).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def deduplicate(docs: DataFrame, least: float = SIMILARITY, count: int = SKETCHES, order: int = ORDER, k: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id (of several texts of this doc_id that of the
    smallest digest); rows without a doc_id stay. Columns, extra ones included, are kept as they are.

    Rows of one doc_id with texts that are no near-duplicates all stay; of rows of one doc_id and text one stays.
    """
    found = classes(docs, least, count, order, k, chunk)
    winner = found.groupBy("group").agg(F.min(F.struct("doc_id", "digest", "copies")).alias("x")).select("x.*")
    winner = cut_table(winner.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "copies"), "kept")
    numbered = docs.where("doc_id is not null").withColumns({"__id": F.col("doc_id").cast("long"), "__digest": F.unhex(F.md5(F.coalesce("text", F.lit(""))))})
    key = ["__id", "__digest"]
    kept = one_each(numbered.join(winner, key, "left_semi"), winner.where("copies > 1"), key).drop(*key)
    return kept.unionByName(docs.where("doc_id is null"))
