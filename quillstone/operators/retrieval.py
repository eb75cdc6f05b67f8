"""Batched lexical, dense and late-interaction search: queries in, hits out.

The corpus is scanned once for all queries. Query terms and query vectors are the small side; they
are handed to every task only under a measured bound, beyond which terms are joined by shuffle and
vectors are taken in blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.functions.text import tokens
from quillstone.operators.ranking import top_k

K1, B = 1.5, 0.75
#: Query terms that are broadcast at most.
TERMS_BOUND = 500_000
#: Query vectors of one block.
VECTOR_BLOCK = 2048
#: Hits that a task keeps at most, the best k of each query of a pass.
HELD_BOUND = 500_000
#: Numbers that a task works on at once: tokens, pairs of a posting and a query, scores.
SLICE = 500_000


def query_terms(queries: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """(query_id, term) of queries (query_id, text), each pair once, whatever rows of a query_id repeat or add."""
    terms = F.array_distinct(tokens(F.col("text")))
    if stopwords:
        terms = F.array_except(terms, F.array(*map(F.lit, stopwords)))
    return queries.select("query_id", F.explode(terms).alias("term")).distinct()


class Best:
    """Running best k of each query over the batches of a task, ties by key; what can no longer count is dropped as it grows."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.held, self.size = max(k, 0), [], 0
        self.floor = np.full(n_queries, -np.inf)
        self.room = max(1 << 18, 2 * self.k * n_queries)

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.floor[query]
        self.held.append((query[good], score[good], key[good], doc[good]))
        self.size += int(good.sum())
        if self.size > self.room:
            self.cut()

    def cut(self) -> None:
        query, score, key, doc = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((key, -score, query))
        query, score, key, doc = query[order], score[order], key[order], doc[order]
        first = np.concatenate(([0], np.flatnonzero(query[1:] != query[:-1]) + 1)) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        if self.k:
            last = place == self.k - 1
            self.floor[query[last]] = score[last]
        keep = place < self.k
        self.held = [(query[keep], score[keep], key[keep], doc[keep])]
        self.size = int(keep.sum())

    def rows(self) -> tuple[np.ndarray, ...]:
        self.cut()
        return self.held[0]


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their scan has fewer partitions, as of one small file; large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


class BM25Index:
    """BM25 (k1 1.5, b 0.75, ln(1 + (N - df + 0.5) / (df + 0.5))) over chunks (chunk_id, doc_id, text).

    Lengths come from the token arrays before anything is exploded. Up to TERMS_BOUND pairs of query
    and term, which is counted, one pass over the corpus counts the documents of each query term; in a
    second one every task scores its own postings for all queries and keeps a running best k, so k rows
    for each query and task are shuffled. Batches are taken in slices of bounded size, so a task's memory
    depends neither on the corpus nor on how often its words are asked for. Beyond the bound, the postings
    of query terms are joined by shuffle. Terms without a match give no hit: zero scores never pad a result.
    """

    def __init__(self, chunks: DataFrame, stopwords: list[str] | None = None):
        self.stopwords = stopwords
        own = tokens(F.col("text"))
        if stopwords:
            own = F.filter(own, lambda t: ~t.isin(*stopwords))
        self.chunks = spread(chunks.select("chunk_id", "doc_id", "text")).select("chunk_id", "doc_id", own.alias("tokens")).withColumn("dl", F.size("tokens"))

    @classmethod
    def build(cls, chunks: DataFrame, stopwords: list[str] | None = None) -> BM25Index:
        return cls(chunks, stopwords)

    def save(self, path: str) -> None:
        self.chunks.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, stopwords: list[str] | None = None) -> BM25Index:
        out = cls.__new__(cls)
        out.stopwords, out.chunks = stopwords, spark.read.parquet(path)
        return out

    def statistics(self) -> DataFrame:
        """One row: n documents and their mean length, empty ones left out."""
        return self.chunks.where("dl > 0").agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))

    def term_statistics(self) -> DataFrame:
        """(term, df, idf) of every term of the corpus."""
        df = self.chunks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return df.join(F.broadcast(self.statistics())).select("term", "df", idf.alias("idf"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(term, chunk_id, doc_id, tf, dl, df) of the given distinct terms."""
        bounded = terms.limit(TERMS_BOUND + 1).count() <= TERMS_BOUND
        terms = F.broadcast(terms) if bounded else terms
        found = self.chunks.select("chunk_id", "doc_id", "dl", F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
        tf = found.groupBy("term", "chunk_id", "doc_id", "dl").agg(F.count("*").alias("tf"))
        df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
        return tf.join(df, "term")

    def search(self, queries: DataFrame, k: int = 10, run: str = "bm25", within: DataFrame | None = None, by: str = "bm25") -> DataFrame:
        """hits of queries (query_id, text, ...), the best k of each; of the chunks of within (chunk_id) only, if given, under statistics of all.

        by "terms" the score is the number of distinct query terms that a chunk holds.
        """
        if by not in ("bm25", "terms"):
            raise ValueError(f"unknown score: {by}")
        wanted = query_terms(queries, self.stopwords)
        pairs = wanted.limit(TERMS_BOUND + 1).collect()
        scored = self.scored_here(queries, pairs, k, within, by) if len(pairs) <= TERMS_BOUND else self.scored_by_join(wanted, within, by)
        hits = top_k(scored, k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
        return hits.select("query_id", F.lit(run).alias("run"), "rank", "chunk_id", "doc_id", "score")

    def scored_by_join(self, wanted: DataFrame, within: DataFrame | None = None, by: str = "bm25") -> DataFrame:
        posted = self.postings(wanted.select("term").distinct())
        if within is not None:
            posted = posted.join(within.select("chunk_id"), "chunk_id", "left_semi")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) if by == "bm25" else F.lit(1.0)
        scored = posted.crossJoin(F.broadcast(self.statistics())).select("term", "chunk_id", "doc_id", part.alias("part"))
        return scored.join(wanted, "term").groupBy("query_id", "chunk_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))

    def weights(self, known: Broadcast) -> tuple[float, np.ndarray]:
        """The mean length of chunks with any token, and idf of each of the sorted terms."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, n, total = pa.array(known.value, pa.string()), 0, 0
            df = np.zeros(len(terms), np.int64)
            for held in postings_of(batches, terms):
                n, total = n + len(held.dl), total + int(held.dl.sum())
                df += np.bincount(held.term, minlength=len(df))
            place = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], place))), pa.array(np.concatenate(([n, total], df[place])))], ["place", "n"])

        df = np.zeros(len(known.value) + 2)
        for r in self.chunks.where("dl > 0").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            df[r["place"]] = r["n"]
        n, df, total = df[-2], df[:-2], df[-1]
        return total / n if n else 1.0, np.log(1 + (n - df + 0.5) / (df + 0.5))

    def posted(self, known: Broadcast) -> DataFrame:
        """(chunk_id, doc_id, dl, place, tf) of chunks with any token: which of the sorted terms they hold, and how often."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in postings_of(batches, pa.array(known.value, pa.string())):
                offsets = pa.array(held.offsets.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (held.term, held.tf)]
                yield pa.RecordBatch.from_arrays([held.rows.column("chunk_id"), held.rows.column("doc_id"), pa.array(held.dl.astype(np.int32)), *lists], ["chunk_id", "doc_id", "dl", "place", "tf"])

        types = {c: self.chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")}
        return self.chunks.where("dl > 0").mapInArrow(run, f"chunk_id {types['chunk_id']}, doc_id {types['doc_id']}, dl int, place array<int>, tf array<int>")

    def scored_here(self, queries: DataFrame, pairs: list, k: int, within: DataFrame | None = None, by: str = "bm25") -> DataFrame:
        """The best k and their ties of each task's chunks, for each query; one pass for all queries whose best k a task can hold."""
        spark, kind = self.chunks.sparkSession, queries.schema["query_id"].dataType
        terms = sorted({p["term"] for p in pairs})
        ids = list(dict.fromkeys(p["query_id"] for p in pairs))
        known = spark.sparkContext.broadcast(terms)
        mean, idf = self.weights(known) if by == "bm25" else (None, np.ones(len(terms)))
        number = {t: i for i, t in enumerate(terms)}
        place = {q: i for i, q in enumerate(ids)}
        by_term = np.array(sorted((number[p["term"]], place[p["query_id"]]) for p in pairs), np.int64).reshape(-1, 2)
        types = {c: self.chunks.schema[c].dataType for c in ("chunk_id", "doc_id")}
        schema = f"query_id {kind.simpleString()}, chunk_id {types['chunk_id'].simpleString()}, doc_id {types['doc_id'].simpleString()}, score double"
        posted = self.posted(known).join(within.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "doc_id", "dl", "place", "tf") if within is not None else None
        block, out = max(1, HELD_BOUND // max(k, 1)), None
        for first in range(0, max(len(ids), 1), block):
            own = by_term[(by_term[:, 1] >= first) & (by_term[:, 1] < first + block)]
            starts = np.searchsorted(own[:, 0], np.arange(len(terms) + 1))
            state = spark.sparkContext.broadcast((ids[first : first + block], idf, starts, own[:, 1] - first))

            def run(batches: Iterator[pa.RecordBatch], state=state, fresh=within is None) -> Iterator[pa.RecordBatch]:
                ids, idf, starts, asked = state.value
                best = Best(len(ids), k)
                for held in postings_of(batches, pa.array(known.value, pa.string())) if fresh else postings_again(batches):
                    chunk, doc = (held.rows.column(c).to_numpy(zero_copy_only=False) for c in ("chunk_id", "doc_id"))
                    for lo, found, query, score in scores_of(held, idf, mean, starts, asked, best):
                        best.add(query, score, chunk[lo + found], doc[lo + found])
                query, score, chunk, doc = best.rows() if best.held else (np.zeros(0, np.int64),) * 4
                for s in range(0, len(query), 100_000):
                    at = slice(s, s + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)).take(pa.array(query[at])), pa.array(chunk[at], to_arrow_type(types["chunk_id"])), pa.array(doc[at], to_arrow_type(types["doc_id"])), pa.array(score[at].astype(float))], ["query_id", "chunk_id", "doc_id", "score"])

            part = (self.chunks.where("dl > 0") if posted is None else posted).mapInArrow(run, schema)
            out = part if out is None else out.unionByName(part)
        return out


class Postings(NamedTuple):
    """Rows of a slice, their lengths, and which terms each holds how often: those of row i are offsets[i] to offsets[i + 1]."""

    rows: pa.RecordBatch
    dl: np.ndarray
    offsets: np.ndarray
    term: np.ndarray
    tf: np.ndarray


def steps(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive rows of at most so many rows and the sum of at most most, one row at least."""
    upto, lo = np.concatenate(([0], np.cumsum(sizes))), 0
    while lo < len(sizes):
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1))
        yield lo, hi
        lo = hi


def postings_of(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[Postings]:
    """Postings of the given terms in batches (chunk_id, doc_id, tokens, dl), from slices of at most SLICE tokens."""
    width = max(len(terms), 1)
    for batch in batches:
        for lo, hi in steps(batch.column("dl").to_numpy(), SLICE, batch.num_rows):
            part = batch.slice(lo, hi - lo)
            lists = part.column("tokens")
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy()
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))[at >= 0]
            key, tf = np.unique(row * width + at[at >= 0], return_counts=True)
            yield Postings(part.drop_columns(["tokens"]), part.column("dl").to_numpy(), np.searchsorted(key // width, np.arange(part.num_rows + 1)), key % width, tf)


def postings_again(batches: Iterator[pa.RecordBatch]) -> Iterator[Postings]:
    """Postings out of the batches that BM25Index.posted() made of them."""
    for batch in batches:
        lists = batch.column("place")
        offsets = lists.offsets.to_numpy()
        yield Postings(batch, batch.column("dl").to_numpy(), offsets - offsets[0], lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy())


def scores_of(held: Postings, idf: np.ndarray, mean: float | None, starts: np.ndarray, asked: np.ndarray, best: Best) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row in the slice, query, score) of what may be among the best, in steps of at most SLICE pairs of a posting and a query that asks for it. Without a mean length a term's weight is its idf alone."""
    fan, wide = np.diff(starts), len(best.floor)
    pairs = np.diff(np.concatenate(([0], np.cumsum(fan[held.term])))[held.offsets])
    for lo, hi in steps(pairs, SLICE, max(1, SLICE // max(wide, 1))):
        own = slice(held.offsets[lo], held.offsets[hi])
        row, term, tf = np.repeat(np.arange(hi - lo), np.diff(held.offsets[lo : hi + 1])), held.term[own], held.tf[own]
        part = idf[term] if mean is None else idf[term] * tf / (tf + K1 * (1 - B + B * held.dl[lo:hi][row] / mean))
        n = fan[term]
        ends = np.cumsum(n)
        query = asked[np.repeat(starts[term] - (ends - n), n) + np.arange(int(n.sum()))]
        score = np.bincount(np.repeat(row, n) * wide + query, np.repeat(part, n), (hi - lo) * wide).reshape(hi - lo, wide)
        # ties after rounding stay
        found, query = np.nonzero((score > 0) & (score >= best.floor - 1e-6))
        yield lo, found, query, np.round(score[found, query], 6)


def fielded_search(rows: DataFrame, key: str, fields: list[str], queries: DataFrame, k: int = 10) -> DataFrame:
    """BM25 of each field on its own, with statistics of its own: hits with run = field."""
    out = None
    for field in fields:
        chunks = rows.select(F.col(key).alias("chunk_id"), F.col(key).alias("doc_id"), F.col(field).alias("text"))
        hits = BM25Index.build(chunks).search(queries, k, field)
        out = hits if out is None else out.unionByName(hits)
    return out


def vector_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Query vectors (query_id, vector, __scope) in bounded blocks, streamed through the driver."""
    rows = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), "__scope").toLocalIterator()
    while block := list(islice(rows, VECTOR_BLOCK)):
        yield [r["query_id"] for r in block], np.array([r["vector"] for r in block]), np.array([r["__scope"] for r in block])


def knn(corpus: DataFrame, queries: DataFrame, k: int = 10, run: str = "dense", normalize: bool = True, skip_self: bool = False, scope: str | None = None) -> DataFrame:
    """Exact inner-product search of queries (query_id, vector) in corpus (chunk_id, doc_id, vector): hits.

    Each task multiplies slices of its batches with a block of queries, a million scores at once, and keeps a
    running best k of each query, so what is shuffled is k rows for each query and task. normalize makes it
    cosine. scope names a column of both sides whose values have to be equal.
    """
    spark = corpus.sparkSession
    out = None
    own_scope = F.coalesce(F.xxhash64(scope), F.lit(0)) if scope else F.lit(0).cast("long")
    source = corpus.select("chunk_id", "doc_id", F.col("vector").cast("array<double>").alias("vector"), own_scope.alias("scope"))
    for ids, matrix, scopes in vector_blocks(queries.withColumn("__scope", own_scope)):
        state = spark.sparkContext.broadcast((np.array(ids), unit_rows(matrix) if normalize else matrix, scopes))

        def run_block(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            ids, matrix, scopes = state.value
            best = Best(len(ids), k)
            for rows, part in vectors_of(batches, matrix.shape[1], max(1, 2 * SLICE // len(ids))):
                chunk, doc, here = (part.column(c).to_numpy() for c in ("chunk_id", "doc_id", "scope"))
                scores = matrix @ (unit_rows(rows) if normalize else rows).T
                np.round(scores, 6, out=scores)
                scores[~np.isfinite(scores)] = -np.inf
                if skip_self:
                    scores[ids[:, None] == chunk[None, :]] = -np.inf
                if scope:
                    scores[scopes[:, None] != here[None, :]] = -np.inf
                least = best.floor
                if scores.shape[1] > k > 0:
                    # of a slice the best k of a query and their ties
                    least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
                q, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                best.add(q, scores[q, at], chunk[at], doc[at])
            if best.held:
                q, score, chunk, doc = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(chunk), pa.array(doc), pa.array(score + 0.0)], ["query_id", "chunk_id", "doc_id", "score"])

        part = source.mapInArrow(run_block, "query_id long, chunk_id long, doc_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, run string, rank int, chunk_id long, doc_id long, score double")
    hits = top_k(out, k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
    return hits.select("query_id", F.lit(run).alias("run"), "rank", "chunk_id", "doc_id", "score")


def vectors_of(batches: Iterator[pa.RecordBatch], dims: int, most: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Vectors of so many components, and their rows, in slices of at most most rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column("vector")), dims), False))
            if part.num_rows:
                yield part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), part


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=rows.astype(float).copy(), where=norm > 0)


def max_sim(doc_tokens: DataFrame, query_tokens: DataFrame, k: int = 10, run: str = "late") -> DataFrame:
    """Late interaction: for each query token the largest inner product with a document's tokens, summed.

    doc_tokens (doc_id, vector), query_tokens (query_id, token_no, vector). Maxima are taken within
    slices of batches first and combined map-side, so no document's tokens need to meet in one task.
    """
    spark = doc_tokens.sparkSession
    numbered = query_tokens.select(F.struct("query_id", "token_no").alias("query_id"), "vector")
    out = None
    for ids, matrix, _ in vector_blocks(numbered.withColumn("__scope", F.lit(0))):
        state = spark.sparkContext.broadcast((np.array([i["query_id"] for i in ids]), np.array([i["token_no"] for i in ids]), matrix))

        def run_block(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            query, token, matrix = state.value
            for rows, part in vectors_of(batches, matrix.shape[1], max(1, 4 * SLICE // len(query))):
                doc = part.column("doc_id").to_numpy()
                order = np.argsort(doc, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], doc[order][1:] != doc[order][:-1])))
                best = np.maximum.reduceat(matrix @ rows[order].T, starts, axis=1)
                docs = doc[order][starts]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, n)), pa.array(np.repeat(token, n)), pa.array(np.tile(docs, len(query))), pa.array(best.ravel())], ["query_id", "token_no", "doc_id", "best"])

        part = doc_tokens.select("doc_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null").mapInArrow(run_block, "query_id long, token_no long, doc_id long, best double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, run string, rank int, chunk_id long, doc_id long, score double")
    best = out.groupBy("query_id", "token_no", "doc_id").agg(F.max("best").alias("best"))
    total = best.groupBy("query_id", "doc_id").agg(F.round(F.sum("best"), 6).alias("score"))
    hits = top_k(total, k, ["query_id"], [F.desc("score"), F.asc("doc_id")])
    return hits.select("query_id", F.lit(run).alias("run"), "rank", F.col("doc_id").alias("chunk_id"), "doc_id", "score")


def hashed_vector(text: Column, dims: int = 64) -> Column:
    """Deterministic stand-in for an encoder: counts of tokens by hash bucket, in Arrow batches as a real encoder would run."""

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        find = re.compile(r"\w{2,}").findall
        buckets = ([zlib.crc32(t.encode()) % dims for t in find((x or "").lower())] for x in texts)
        return pd.Series([np.bincount(np.array(b, np.int64), minlength=dims).astype(float) for b in buckets])

    return encode(text)


def phrase_hits(hits: DataFrame, texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """hits whose text holds the query's phrase, case aside, no letter or digit touching it."""
    text, phrase = F.lower(F.col("text")), F.lower(F.col("phrase"))
    at = F.instr(text, phrase)
    before, after = F.when(at > 1, F.substring(text, at - 1, F.lit(1))).otherwise(""), F.substring(text, at + F.length(phrase), F.lit(1))
    clear = (at > 0) & ~before.rlike("[a-z0-9]") & ~after.rlike("[a-z0-9]")
    return hits.join(phrases, "query_id").join(texts.select("chunk_id", "text"), "chunk_id").where(clear).drop("text", "phrase")


def citing_hubs(verified: DataFrame, exclude: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Documents that quote the most different titles: by number quoted, then best score."""
    grouped = verified.groupBy("doc_id").agg(F.count_distinct("query_id").alias("n_quoted"), F.max("score").alias("best"))
    if exclude is not None:
        grouped = grouped.join(exclude, "doc_id", "left_anti")
    return grouped.orderBy(F.desc("n_quoted"), F.desc("best"), F.asc("doc_id")).limit(most)
