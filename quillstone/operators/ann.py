"""An inverted-list index over vectors, for corpora too large for exact search.

Centroids are fitted to a bounded sample; every vector is indexed, in the list of its nearest centroid,
and the lists are the partitions of a Parquet table. A search reads the lists nearest to its queries
only, and compares each query with its own lists' vectors exactly. Recall grows with the lists probed;
tests hold it against exact search.

Defined cases: zero, null and other-length vectors are in no list; an empty corpus gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.ranking import top_k
from quillstone.operators.retrieval import Best, unit_rows, vector_blocks

#: Vectors that centroids are fitted to, at most; most lists; rounds of the fit.
SAMPLE, MOST_LISTS, ROUNDS = 50_000, 4096, 10


def fit_centroids(rows: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means of unit rows; a centroid without rows moves to the row that fits its own worst."""
    rng = np.random.default_rng(7)
    centroids = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = rows @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(near.max(axis=1))[: len(empty)]]
        centroids = unit_rows(sums)
    return centroids


class InvertedIndex:
    """Cosine search; rows (chunk_id, doc_id, vector, list_no) partitioned by list_no, centroids beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/rows")
        got = spark.read.parquet(f"{path}/centroids").orderBy("list_no").collect()
        self.centroids = np.array([r["vector"] for r in got]) if got else np.zeros((0, 0))

    @classmethod
    def build(cls, corpus: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> InvertedIndex:
        """Indexes corpus (chunk_id, doc_id, vector) below path; by default about the square root of its rows in lists."""
        spark = corpus.sparkSession
        source = corpus.select("chunk_id", "doc_id", F.col("vector").cast("array<double>").alias("vector")).where(F.exists("vector", lambda x: x != 0))
        n = source.count()
        # a bounded sample, the same for the same rows
        chosen = source.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").collect()
        dims = len(chosen[0]["vector"]) if chosen else 0
        rows = unit_rows(np.array([r["vector"] for r in chosen if len(r["vector"]) == dims])) if chosen else np.zeros((0, 0))
        lists = lists or max(1, min(MOST_LISTS, int(n**0.5)))
        centroids = fit_centroids(rows, lists) if len(rows) else rows
        state = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column("vector")
                keep = np.flatnonzero(np.diff(vectors.offsets.to_numpy()) == state.value.shape[1])
                own = vectors.take(pa.array(keep))
                near = unit_rows(own.flatten().to_numpy(zero_copy_only=False).reshape(len(keep), -1)) @ state.value.T
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.argmax(axis=1).astype(np.int32))], [*part.schema.names, "list_no"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
        placed = source.mapInArrow(assign, f"{kinds}, list_no int")
        # a list that holds a third of all rows is written by many tasks
        spread = placed.repartition(F.col("list_no"), F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // (len(centroids) or 1) // 1_000_000 + 1))))
        spread.write.mode("overwrite").partitionBy("list_no").parquet(f"{path}/rows")
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list_no int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, run: str = "ann", skip_self: bool = False) -> DataFrame:
        """hits of queries (query_id, vector): the best k of the probes lists nearest to each."""
        spark = queries.sparkSession
        out = None
        for ids, matrix, _ in vector_blocks(queries.withColumn("__scope", F.lit(0))):
            if not len(self.centroids):
                break
            unit = unit_rows(matrix)
            near = np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, :probes]
            askers: dict[int, list[int]] = {}
            for q, lists in enumerate(near.tolist()):
                for n in lists:
                    askers.setdefault(n, []).append(q)
            state = spark.sparkContext.broadcast((np.array(ids), unit, {n: np.array(q) for n, q in askers.items()}))

            def run_block(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
                ids, matrix, askers = state.value
                best = Best(len(ids), k)
                for batch in batches:
                    lists, rows = batch.column("list_no").to_numpy(), batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    chunk, doc = batch.column("chunk_id").to_numpy(), batch.column("doc_id").to_numpy()
                    for n in np.unique(lists).tolist():
                        at, own = np.flatnonzero(lists == n), askers[n]
                        scores = np.round(matrix[own] @ unit_rows(rows[at]).T, 6)
                        if skip_self:
                            scores[ids[own][:, None] == chunk[at][None, :]] = -np.inf
                        q, x = np.nonzero((scores >= best.floor[own][:, None]) & np.isfinite(scores))
                        best.add(own[q], scores[q, x], chunk[at[x]], doc[at[x]])
                if best.held:
                    q, score, chunk, doc = best.rows()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(chunk), pa.array(doc), pa.array(score + 0.0)], ["query_id", "chunk_id", "doc_id", "score"])

            rows = self.rows.where(F.col("list_no").isin(sorted(askers))).select("chunk_id", "doc_id", "vector", "list_no")
            part = rows.mapInArrow(run_block, "query_id long, chunk_id long, doc_id long, score double")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return spark.createDataFrame([], "query_id long, run string, rank int, chunk_id long, doc_id long, score double")
        hits = top_k(out, k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
        return hits.select("query_id", F.lit(run).alias("run"), "rank", "chunk_id", "doc_id", "score")
