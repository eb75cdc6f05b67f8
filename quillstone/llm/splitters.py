"""Sharding by sampled splitters, in DataFrame functions only.

Rows are ordered by (MD5 of the text, doc_id), so equal texts are neighbours and a hot text still
divides by doc_id. A Poisson sample whose chances are in proportion to size gives splitters at
quantiles of bytes; ranges that turn out overfull are divided by splitters of a denser sample of their
own, until none is overfull that holds two keys. Exact bytes and rows of the ranges then place every
row: law "bytes", shard s holding the rows whose preceding bytes fall in the s-th equal part of all
bytes, so shards differ by less than the largest row. Slots number a shard's rows from 0 in that order.

Splitters are a table: its rows are grouped by the leading digits of their keys and joined to the rows
by these digits, and within a group a row counts the smaller splitters in two steps of at most a few
dozen comparisons. Every task holds one range. The number of ranges grows with the input up to
MAX_RANGES, which bounds the splitters and the samples; beyond it ranges grow.

Defined cases: a null text counts as empty (size 1, CRC 0); a null doc_id sorts first; repeated rows
get slots of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, cut_table

RANGE_BYTES = 8 << 20
MAX_RANGES = 1 << 16
#: Sampled rows for each range.
SAMPLE = 32
#: Hexadecimal digits that group the splitters, and splitters of one array of a group.
DIGITS, WIDTH = 3, 32


def keyed(docs: DataFrame, *carry: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.struct(F.md5(text).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k2")).alias("key"),
        *carry,
    )


def drawn(rows: DataFrame, step: float, seed: int) -> DataFrame:
    """(key, weight, ...) of a sample drawn by size, a row for every step bytes; weight is the bytes that it stands for."""
    chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(chance < F.col("size") / F.lit(step)).withColumn("weight", F.greatest(F.col("size").cast("double"), F.lit(step)))


def quantiles(sample: DataFrame, parts: Column, within: Column) -> DataFrame:
    """(k1, k2) of the sampled keys at which the weight reaches another of the equal parts, for each value of within."""
    upto = F.sum("weight").over(Window.partitionBy(within).orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("weight").over(Window.partitionBy(within))
    marked = sample.select("key", (upto * parts / whole).alias("upto"), ((upto - F.col("weight")) * parts / whole).alias("before"), parts.alias("parts"))
    return marked.where((F.floor("upto") > F.floor("before")) & (F.floor("before") < F.col("parts") - 1)).select("key.*").distinct()


def ranged(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """rows with the number of splitters (k1, k2), a bounded table, before their keys."""
    spark = rows.sparkSession
    own = splitters.groupBy(F.substring("k1", 1, DIGITS).alias("digits")).agg(F.sort_array(F.collect_list(F.struct("k1", "k2"))).alias("all"))
    every = spark.range(16**DIGITS).select(F.lpad(F.lower(F.hex("id")), DIGITS, "0").alias("digits"))
    count = F.coalesce(F.size("all"), F.lit(0))
    ahead = Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    groups = every.join(own, "digits", "left").select("digits", F.coalesce(F.sum(F.greatest(count, F.lit(0))).over(ahead), F.lit(0)).alias("before"), "all")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / WIDTH).cast("int")), lambda i: F.slice("all", i * WIDTH + 1, F.lit(WIDTH)))
    groups = groups.withColumn("blocks", F.when(F.col("all").isNotNull(), blocks)).withColumn("tops", F.transform("blocks", lambda b: F.element_at(b, -1))).drop("all")
    smaller = lambda keys: F.size(F.filter(keys, lambda s: s < F.col("key")))
    whole = smaller(F.col("tops"))
    inner = F.coalesce(F.get("blocks", whole), F.array().cast("array<struct<k1:string,k2:bigint>>"))
    inside = F.when(F.col("tops").isNull(), 0).otherwise(whole * WIDTH + smaller(inner))
    # full arrays before the last one hold WIDTH splitters each; past the last one all are smaller
    last = F.size(F.element_at("blocks", -1))
    inside = F.when(whole == F.size("tops"), (whole - 1) * WIDTH + last).otherwise(inside)
    joined = rows.withColumn("digits", F.substring("key.k1", 1, DIGITS)).join(F.broadcast(groups), "digits")
    return joined.select(*rows.columns, (F.col("before") + inside).cast("int").alias("range"))


def divided(rows: DataFrame, total: int, ranges: int, scratch: Scratch) -> DataFrame:
    """Splitters (k1, k2) that leave no range of two keys or more overfull."""
    goal = max(1.0, total / ranges)
    sample = drawn(rows, max(1.0, goal / SAMPLE), 1).select("key", "weight")
    splitters = scratch.table(quantiles(sample, F.lit(ranges), F.lit(0)))
    seed = 1
    while True:
        seed += 1
        placed = ranged(rows, splitters)
        loads = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        over = scratch.table(loads.where((F.col("bytes") > 1.5 * goal) & (F.col("lo") < F.col("hi"))))
        if over.isEmpty():
            return splitters
        # a bounded table: fewer than the ranges
        dense = drawn(placed.join(F.broadcast(over), "range"), max(1.0, goal / SAMPLE / seed), seed).where(F.col("key") < F.col("hi"))
        inner = quantiles(dense.select("key", "weight", "range", "bytes"), F.ceil(F.col("bytes") / goal), F.col("range"))
        # the least key of a range always divides it
        splitters = scratch.table(splitters.union(inner).union(over.select("lo.*")).distinct())


def assign(docs: DataFrame, shards: int = 8, *carry: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and the carried columns."""
    with Scratch(docs.sparkSession, "splitters") as scratch:
        rows = scratch.table(keyed(docs, *carry))
        total, count = rows.agg(F.sum("size"), F.count("*")).first()
        total = total or 0
        ranges = min(MAX_RANGES, max(8 * shards, -(-total // range_bytes)))
        placed = ranged(rows, divided(rows, total, ranges, scratch)) if count else rows.withColumn("range", F.lit(0))
        by_range = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        # a row for each range, at most the splitters and one: a bounded table
        earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        by_range = by_range.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
        inside = Window.partitionBy("range").orderBy("key")
        ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
        ordered = placed.withColumns({"ahead": F.coalesce(F.sum("size").over(ahead), F.lit(0)), "place": F.row_number().over(inside)})
        ordered = ordered.join(F.broadcast(by_range), "range")
        before = F.col("bytes_before") + F.col("ahead")
        shard = F.least(F.lit(shards - 1), F.floor(before * shards / F.lit(max(total, 1)))).cast("int")
        ordered = cut_table(ordered.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("place") - 1).alias("index"), *carry), "shards")
    first = ordered.groupBy("shard").agg(F.min("index").alias("first"))
    out = ordered.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)
