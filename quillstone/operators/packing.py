"""Packing of ordered pieces under size budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(rows: DataFrame, by: list[str], order: list[Column], budget: int, least: int = 500, text: str = "text") -> DataFrame:
    """Blocks of each group in order while earlier ones leave room; the last is cut to the rest, or dropped under least characters.

    Empty blocks are left out first; labels C1, C2, ... are dense over what is kept.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    size = F.length(text)
    out = rows.where(size > 0).withColumn("before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.where(F.col("before") < budget).withColumn("room", budget - F.col("before"))
    out = out.where((size <= F.col("room")) | (F.col("room") >= least))
    out = out.withColumn(text, F.expr(f"substring({text}, 1, room)"))
    return out.withColumn("label", F.format_string("C%d", F.row_number().over(w))).drop("before", "room")


def budget_stop(rows: DataFrame, by: list[str], order: list[Column], budget: int, text: str = "text") -> DataFrame:
    """Blocks of each group up to the first that overflows the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(F.length(text)).over(w)).where(F.col("upto") <= budget)


def pack(sizes: Column, budget: int, overlap: int = 0) -> Column:
    """Array of packs for an array of piece sizes: structs (first, last) of 0-based piece numbers.

    Greedy: a pack closes when the next piece would overflow the budget (one newline between
    pieces). With overlap the trailing pieces of a closed pack that fit in overlap, at least one,
    begin the next; a single larger piece is a pack of its own.
    """
    state = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("packs"), F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        grown = s["size"] + F.when(s["size"] > 0, 1).otherwise(0) + x
        closes = (s["at"] > s["first"]) & (grown > budget)
        if overlap:
            # trailing pieces that fit the overlap, one at least
            tail = F.aggregate(
                F.sequence(F.lit(1), F.greatest(s["at"] - s["first"] - 1, F.lit(1))),
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open")),
                lambda t, k: F.struct(
                    F.when(t["open"] & ((k == 1) | (t["size"] + F.get(sizes, s["at"] - k) <= overlap)), t["n"] + 1).otherwise(t["n"]).alias("n"),
                    F.when(t["open"] & ((k == 1) | (t["size"] + F.get(sizes, s["at"] - k) <= overlap)), t["size"] + F.get(sizes, s["at"] - k)).otherwise(t["size"]).alias("size"),
                    (t["open"] & ((k == 1) | (t["size"] + F.get(sizes, s["at"] - k) <= overlap))).alias("open"),
                ),
            )
            first, size = s["at"] - tail["n"], tail["size"] + F.when(tail["size"] > 0, 1).otherwise(0) + x
        else:
            first, size = s["at"], x
        packed = F.concat(s["packs"], F.array(F.struct(s["first"].cast("int").alias("first"), (s["at"] - 1).cast("int").alias("last"))))
        return F.struct(
            F.when(closes, packed).otherwise(s["packs"]).alias("packs"),
            F.when(closes, first).otherwise(s["first"]).cast("int").alias("first"),
            F.when(closes, size).otherwise(grown).cast("int").alias("size"),
            (s["at"] + 1).cast("int").alias("at"),
        )

    def finish(s: Column) -> Column:
        last = F.array(F.struct(s["first"].cast("int").alias("first"), (s["at"] - 1).cast("int").alias("last")))
        return F.when(s["at"] > s["first"], F.concat(s["packs"], last)).otherwise(s["packs"])

    return F.aggregate(F.transform(sizes, lambda x: x.cast("int")), state, step, finish)


def pack_texts(units: Column, budget: int, overlap: int = 0) -> Column:
    """Packs of an array of texts, each joined by newlines."""
    packs = pack(F.transform(units, F.length), budget, overlap)
    return F.transform(packs, lambda p: F.array_join(F.slice(units, p["first"] + 1, p["last"] - p["first"] + 1), "\n"))


def split_fixed(text: Column, size: int) -> Column:
    """Consecutive parts of size characters; an empty text has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / size), F.lit(0)).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def split_at_spaces(frames: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Parts of at most size characters, cut at the last space past the half where there is one: adds part_no, part."""

    def parts(value: str) -> list[str]:
        out, rest, lo = [], (value or "").strip(), 0
        while len(rest) - lo > size:
            at = rest.rfind(" ", lo, lo + size + 1)
            at = at if at - lo > size // 2 else lo + size
            out.append(rest[lo:at].strip())
            while rest[at].isspace():
                at += 1
            lo = at
        return [*out, rest[lo:]] if rest else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch, text):
                lists = pa.array([parts(x) for x in few.column(text).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*few.columns, lists], [*few.schema.names, "part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(run, f"{fields}, part array<string>").select(*frames.columns, F.posexplode("part").alias("part_no", "part"))


#: Bytes of text that a task splits at once.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most SLICE_BYTES of text, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def overflow_order(rows: DataFrame, by: list[str], order: list[Column], budget: int, text: str = "text") -> DataFrame:
    """Hits that fit the budget in order, then the ones that did not: an oversized hit is passed over and smaller
    ones may still fit; the first is always kept. Groups are a query's few boosted hits."""
    numbered = rows.withColumn("__pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    grouped = numbered.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__pos", F.length(text).alias("n")))).alias("hits"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("fits"))
    fits = lambda s, h: (F.size(s["fits"]) == 0) | (s["used"] + h["n"] <= budget)
    kept = F.aggregate("hits", start, lambda s, h: F.struct(F.when(fits(s, h), s["used"] + h["n"]).otherwise(s["used"]).alias("used"), F.concat(s["fits"], F.array(fits(s, h))).alias("fits")), lambda s: s["fits"])
    flags = grouped.select(*by, F.posexplode(kept).alias("__i", "fits")).withColumn("__pos", F.col("__i") + 1).drop("__i")
    out = numbered.join(flags, [*by, "__pos"])
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fits"), "__pos"))).drop("__pos")


def overlap_size(left: str, right: str, least: int) -> int:
    """Length of the longest suffix of left, of at least least characters, that right begins with, else 0; in linear time."""
    top = min(len(left), len(right))
    if top < max(least, 1) or right[: max(least, 1)] not in left[-top:]:
        return 0
    right, left = right[:top], left[-top:]
    fail, k = [0] * top, 0
    for i in range(1, top):
        while k and right[i] != right[k]:
            k = fail[k - 1]
        k += right[i] == right[k]
        fail[i] = k
    k = 0
    for c in left:
        while k and (k == top or c != right[k]):
            k = fail[k - 1]
        k += c == right[k]
    return k if k >= least else 0


def merge_overlapping(texts: Column, least: int = 40) -> Column:
    """Texts joined in order; the longest suffix of at least least characters that the next text begins with is not
    repeated, else a newline parts them. A null text counts as empty."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        def merged(parts) -> str | None:
            if parts is None:
                return None
            out = ""
            for text in parts:
                text = text or ""
                size = overlap_size(out, text, least) if out else 0
                out = out + ("" if size or not out else "\n") + text[size:]
            return out

        return lists.map(merged)

    return run(texts)
