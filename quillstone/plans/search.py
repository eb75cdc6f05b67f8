"""Hybrid retrieval: several runs for all queries at once, fused, cut and optionally reranked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import ranking
from quillstone.operators.retrieval import BM25Index, hashed_vector, knn
from quillstone.plans.registry import register


#: English words that lexical search leaves out on both sides.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


@register("indexer", "bm25")
class LexicalIndexer:
    """BM25 without English stop words, unless others are given (none: [])."""

    name = "bm25"

    def __init__(self, stopwords: list[str] | None = None):
        self.stopwords = STOPWORDS if stopwords is None else stopwords

    def build(self, chunks: DataFrame) -> LexicalIndexer:
        self.index = BM25Index.build(chunks, self.stopwords)
        return self

    def search(self, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
        return self.index.search(queries, k, self.name, within)


@register("indexer", "dense")
class DenseIndexer:
    """Exact search over encode(text column); the stand-in encoder counts tokens by hash bucket."""

    name = "dense"

    def __init__(self, encode: Callable = hashed_vector):
        self.encode = encode

    def build(self, chunks: DataFrame) -> DenseIndexer:
        self.vectors = chunks.select("chunk_id", "doc_id", self.encode(F.col("text")).alias("vector"))
        return self

    def search(self, queries: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
        vectors = self.vectors if within is None else self.vectors.join(within.select("chunk_id"), "chunk_id", "left_semi")
        return knn(vectors, queries.select("query_id", self.encode(F.col("text")).alias("vector")), k, self.name)


@register("fuser", "rrf")
class Fuser:
    def __init__(self, weights: dict[str, float] | None = None, k: int = ranking.RRF_K):
        self.weights, self.k = weights, k

    def fuse(self, hits: DataFrame, limit: int, runs: list[str]) -> DataFrame:
        return ranking.rrf_chunks(hits, self.weights, self.k, limit, runs)


@register("reranker", "none")
class Unchanged:
    def __call__(self, hits: DataFrame) -> DataFrame:
        return hits


class HybridRetriever:
    """Runs each indexer for per_index_k hits, fuses them and returns top_k; with a reranker three times as many are fused first."""

    def __init__(self, indexers: list, fuser: Fuser, per_index_k: int = 100, reranker: Callable | None = None):
        self.indexers, self.fuser, self.per_index_k, self.reranker = indexers, fuser, per_index_k, reranker

    def retrieve(self, queries: DataFrame, top_k: int, within: DataFrame | None = None) -> DataFrame:
        """within (chunk_id) restricts the search to some chunks before the best are taken; statistics stay the corpus's."""
        hits = None
        for indexer in self.indexers:
            run = indexer.search(queries, self.per_index_k) if within is None else indexer.search(queries, self.per_index_k, within)
            hits = run if hits is None else hits.unionByName(run)
        wide = top_k * 3 if self.reranker else top_k
        fused = self.fuser.fuse(hits, wide, [i.name for i in self.indexers])
        return ranking.rerank(fused, top_k, self.reranker) if self.reranker else fused


def multi_query(queries: DataFrame, extra: DataFrame, search: Callable[[DataFrame], DataFrame], limit: int, most: int = 4) -> DataFrame:
    """Original and up to most distinct further wordings (query_id, sub_no, text) in one batched search, merged by best position.

    Further wordings equal to the original or to each other, case aside, are left out.
    """
    base = queries.select("query_id", F.lit(0).alias("sub_no"), "text")
    rows = base.unionByName(extra.select("query_id", "sub_no", "text")).where(F.trim("text") != "")
    low = F.lower(F.trim("text"))
    first = rows.groupBy("query_id", low.alias("low")).agg(F.min_by(F.struct("sub_no", "text"), "sub_no").alias("x")).select("query_id", "x.sub_no", "x.text")
    kept = ranking.top_k(first, most + 1, ["query_id"], [F.asc("sub_no")], "n")
    back = search_apart(kept.select("query_id", F.col("n").alias("sub_no"), "text"), search).withColumnRenamed("sub_no", "run")
    return ranking.merge_best_position(back, limit)


def search_apart(wordings: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Hits of wordings (query_id, sub_no, text), each searched on its own in one batch: the hits' columns with query_id and sub_no."""
    keyed = wordings.select(F.xxhash64("query_id", "sub_no", "text").alias("wording"), F.col("query_id").alias("__q"), "sub_no", "text")
    hits = search(keyed.select(F.col("wording").alias("query_id"), "text")).withColumnRenamed("query_id", "wording")
    back = hits.join(keyed.drop("text"), "wording").drop("wording").withColumnRenamed("__q", "query_id")
    return back.select("query_id", "sub_no", *(c for c in back.columns if c not in ("query_id", "sub_no")))


def first_attribution(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, first_sub): the first wording that found each document."""
    return hits.groupBy("query_id", "doc_id").agg(F.min("sub_no").alias("first_sub"))
