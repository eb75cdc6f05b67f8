"""Rankings over hits (query_id, run, rank, chunk_id, doc_id, score), ranks from 1 within a run.

Every ranking has a total order; groups are reduced with map-side combinable aggregates before any
window, and windows rank within one query only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Papers to return by task family, and how many count as sufficient.
FAMILY_CUTOFF = {"hidden_source_single_paper": 2, "multi_paper": 5}
FAMILY_ENOUGH = {"hidden_source_single_paper": 1, "multi_paper": 4}


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each group; none for k <= 0."""
    return numbered(df, by, order, name).where(F.col(name) <= max(k, 0))


def rrf_chunks(hits: DataFrame, weights: Mapping[str, float] | None = None, k: int = RRF_K, limit: int | None = None, runs: list[str] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion; unknown runs weigh 1; the payload is that of the first run (in the order of runs) that has the chunk."""
    weight = F.lit(1.0)
    for run, w in (weights or {}).items():
        weight = F.when(F.col("run") == run, float(w)).otherwise(weight)
    order = F.coalesce(F.array_position(F.array(*map(F.lit, runs)), F.col("run")), F.lit(0)) if runs else F.col("run")
    first = F.struct(order.alias("o"), F.col("rank").alias("r"))
    fused = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.min_by("doc_id", first).alias("doc_id"), F.min(first).alias("first"))
    sort = [F.desc("score"), F.asc("first"), F.asc("chunk_id")]
    ranked = numbered(fused, ["query_id"], sort) if limit is None else top_k(fused, limit, ["query_id"], sort)
    return ranked.select("query_id", "rank", "chunk_id", "doc_id", "score")


def rrf_docs(hits: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Documents by the sum of 1 / (k + rank) over all their hits; blank ids use up ranks but are not returned."""
    fused = hits.where("doc_id is not null and cast(doc_id as string) <> ''").groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"))
    sort = [F.desc("score"), F.asc("best_rank"), F.asc("doc_id")]
    ranked = numbered(fused, ["query_id"], sort) if limit is None else top_k(fused, limit, ["query_id"], sort)
    return ranked.select("query_id", "rank", "doc_id", "score", "best_rank")


def doc_scores(hits: DataFrame, how: str = "max", limit: int | None = None) -> DataFrame:
    """Documents by the max or sum of their hits' scores; ties by first appearance."""
    if how not in ("max", "sum"):
        raise ValueError(f"unknown aggregation: {how}")
    total = F.max("score") if how == "max" else F.round(F.sum("score"), 6)
    grouped = hits.groupBy("query_id", "doc_id").agg(total.alias("score"), F.min("rank").alias("first_rank"))
    sort = [F.desc("score"), F.asc("first_rank"), F.asc("doc_id")]
    ranked = numbered(grouped, ["query_id"], sort) if limit is None else top_k(grouped, limit, ["query_id"], sort)
    return ranked.select("query_id", "rank", "doc_id", "score", "first_rank")


def best_hits(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Of each key's hits that of the highest score, the first of equals by (run, rank)."""
    order = F.struct(F.negative("score").alias("s"), "run", "rank")
    rest = [c for c in hits.columns if c not in ("query_id", key)]
    best = hits.groupBy("query_id", key).agg(F.min_by(F.struct(*rest), order).alias("hit"))
    return best.select("query_id", key, *(F.col(f"hit.{c}").alias(c) for c in rest))


def best_snippets(hits: DataFrame, size: int = 200) -> DataFrame:
    order = F.struct(F.negative("score").alias("s"), "run", "rank")
    return hits.groupBy("query_id", "doc_id").agg(F.min_by(F.substring("text", 1, size), order).alias("snippet"))


def first_hits(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    order = F.struct("run", "rank")
    rest = [c for c in hits.columns if c not in ("query_id", key)]
    best = hits.groupBy("query_id", key).agg(F.min_by(F.struct(*rest), order).alias("hit"))
    return best.select("query_id", key, *(F.col(f"hit.{c}").alias(c) for c in rest))


def candidate_docs(hits: DataFrame, docs: int, chunks: int) -> DataFrame:
    """The docs best documents by best chunk, each with its chunks best chunks: doc_rank and chunk_rank."""
    unique = best_hits(hits)
    inner = top_k(unique, chunks, ["query_id", "doc_id"], [F.desc("score"), F.asc("run"), F.asc("rank"), F.asc("chunk_id")], "chunk_rank")
    lead = unique.groupBy("query_id", "doc_id").agg(F.max("score").alias("best"))
    lead = top_k(lead, docs, ["query_id"], [F.desc("best"), F.asc("doc_id")], "doc_rank")
    return inner.join(lead, ["query_id", "doc_id"]).select("query_id", "doc_rank", "doc_id", "chunk_rank", "chunk_id", "score")


def first_n_hits(hits: DataFrame, n: int = 2) -> DataFrame:
    """The first n hits of each document in order of (run, rank)."""
    return top_k(hits, n, ["query_id", "doc_id"], [F.asc("run"), F.asc("rank"), F.asc("chunk_id")], "hit_no")


def merge_best_position(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Several lists in one: a chunk stands at its smallest position (first list on ties); by position, then score."""
    order = F.struct("rank", "run")
    grouped = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("position"), F.min_by("score", order).alias("score"), F.min_by("doc_id", order).alias("doc_id"))
    sort = [F.asc("position"), F.desc("score"), F.asc("chunk_id")]
    return numbered(grouped, ["query_id"], sort) if limit is None else top_k(grouped, limit, ["query_id"], sort)


def merge_primary_wins(primary: DataFrame, other: DataFrame, key: list[str], position: str = "rank") -> DataFrame:
    """Ordered union without repeated keys; rows of primary come first and win."""
    return merge_lists([primary, other], key, position)


def merge_lists(sources: list[DataFrame], key: list[str], position: str = "rank", limit: int | None = None, strict: bool = False) -> DataFrame:
    """Ordered union of any number of lists without repeated keys: earlier lists come first and win; the first limit rows
    (of each query_id, if that is part of the key). strict refuses lists that repeat a key."""
    both = reduce(DataFrame.unionByName, (s.withColumn("source_no", F.lit(n)) for n, s in enumerate(sources)))
    if strict and (row := both.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").orderBy(*key).first()):
        raise ValueError(f"repeated key: {tuple(row[k] for k in key)}")
    order = F.struct("source_no", position)
    rest = [c for c in both.columns if c not in key]
    kept = both.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*key, *(F.col(f"row.{c}").alias(c) for c in rest))
    group = [c for c in key if c == "query_id"]
    sort = [F.asc("source_no"), F.asc(position), *(F.asc(k) for k in key)]
    return numbered(kept, group, sort, "merged_rank") if limit is None else top_k(kept, limit, group, sort, "merged_rank")


def round_robin(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """First chunks of all documents, then second ones, documents in order of their first rank."""
    inner = numbered(hits, ["query_id", "doc_id"], [F.asc("rank"), F.asc("chunk_id")], "turn")
    inner = inner.withColumn("doc_order", F.min("rank").over(Window.partitionBy("query_id", "doc_id")))
    sort = [F.asc("turn"), F.asc("doc_order"), F.asc("doc_id")]
    return numbered(inner, ["query_id"], sort, "slot") if limit is None else top_k(inner, limit, ["query_id"], sort, "slot")


def family_cutoff(ranked: DataFrame, families: DataFrame, mode: str = "task_family", most: int = 10) -> DataFrame:
    """ranked cut to its query's number of documents: by task family, else most."""
    if mode not in ("task_family", "llm"):
        raise ValueError(f"unknown cutoff mode: {mode}")
    if mode == "llm":
        return ranked.where(F.col("rank") <= most)
    limit = F.lit(most)
    for family, n in FAMILY_CUTOFF.items():
        limit = F.when(F.col("task_family") == family, n).otherwise(limit)
    return ranked.join(families.select("query_id", limit.alias("cutoff")), "query_id", "left").where(F.col("rank") <= F.coalesce("cutoff", F.lit(most))).drop("cutoff")


def final_count(family: Column, asked: Column) -> Column:
    """Submission size: the asked number, else 1 or 4 by family, at least 1."""
    fallback = F.when(family == "hidden_source_single_paper", 1).otherwise(4)
    return F.greatest(F.lit(1), F.coalesce(asked, fallback))


def rerank(hits: DataFrame, k: int, fn: Callable[[DataFrame], DataFrame] | None = None, over: int = 3) -> DataFrame:
    """With a reranker over * k candidates are fetched, reranked by fn (hits -> hits with new scores) and cut to k; without, the first k."""
    if fn is None:
        return hits.where(F.col("rank") <= k)
    scored = fn(hits.where(F.col("rank") <= over * k))
    return top_k(scored.drop("rank"), k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])


def evidence_numbers(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return numbered(rows, by, order, "__n").withColumn("evidence_id", F.format_string("ev_%03d", "__n")).drop("__n")


def growth(rounds: DataFrame, value: str = "total", threshold: float = 0.0) -> DataFrame:
    """Growth against the previous round (from 0: 1 if anything came, else 0) and the running length of rounds at or under the threshold."""
    w = Window.partitionBy("query_id").orderBy("round")
    before = F.coalesce(F.lag(value).over(w), F.lit(0))
    rate = F.when(before == 0, F.when(F.col(value) > 0, 1.0).otherwise(0.0)).otherwise((F.col(value) - before) / before)
    out = rounds.withColumn("growth", F.round(rate, 6))
    island = F.sum(F.when(F.col("growth") > threshold, 1).otherwise(0)).over(w)
    out = out.withColumn("island", island)
    return out.withColumn("stagnant", F.sum(F.when(F.col("growth") <= threshold, 1).otherwise(0)).over(Window.partitionBy("query_id", "island").orderBy("round"))).drop("island")
