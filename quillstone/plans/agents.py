"""Agents as bounded rounds over the whole batch of queries. Models are injected as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import MULTI, task_family
from quillstone.operators import ranking
from quillstone.plans.registry import register
from quillstone.plans.rounds import Rounds
from quillstone.plans.search import HybridRetriever, search_apart

Judge = Callable[[DataFrame], DataFrame]


def families(queries: DataFrame) -> DataFrame:
    """(query_id, task_family): the query's own, else by the wording of the question."""
    own = F.col("task_family") if "task_family" in queries.columns else F.lit(None).cast("string")
    return queries.select("query_id", F.coalesce(own, task_family(F.col("text"))).alias("task_family"))


@register("agent", "simple")
class SimpleAgent:
    """Search, documents by best chunk, cut by task family."""

    def __init__(self, retriever: HybridRetriever, top_k: int = 20, mode: str = "task_family", most: int = 10):
        self.retriever, self.top_k, self.mode, self.most = retriever, top_k, mode, most

    def run(self, queries: DataFrame) -> DataFrame:
        hits = self.retriever.retrieve(queries, self.top_k).withColumn("run", F.lit("fused"))
        return ranking.family_cutoff(ranking.doc_scores(hits), families(queries), self.mode, self.most)


@register("agent", "verifying")
class VerifyingAgent:
    """As simple, but judge (candidates -> (query_id, doc_id, order)) picks; ids that are no candidates are dropped, and
    a query without picks keeps the order of retrieval."""

    def __init__(self, retriever: HybridRetriever, judge: Judge, top_k: int = 20, mode: str = "task_family", most: int = 10):
        self.retriever, self.judge, self.top_k, self.mode, self.most = retriever, judge, top_k, mode, most

    def run(self, queries: DataFrame) -> DataFrame:
        hits = self.retriever.retrieve(queries, self.top_k).withColumn("run", F.lit("fused"))
        docs = ranking.doc_scores(hits)
        picks = self.judge(docs).join(docs.select("query_id", "doc_id", "score"), ["query_id", "doc_id"])
        picks = picks.groupBy("query_id", "doc_id").agg(F.min("order").alias("order"), F.max("score").alias("score"))
        picked = ranking.numbered(picks, ["query_id"], [F.asc("order"), F.asc("doc_id")]).select("query_id", "rank", "doc_id", "score")
        rest = docs.join(picked.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "rank", "doc_id", "score")
        return ranking.family_cutoff(picked.unionByName(rest), families(queries), self.mode, self.most)


def with_question(queries: DataFrame, proposed: DataFrame) -> DataFrame:
    """Wordings (query_id, sub_no, text) that are not blank; a query without any keeps its question."""
    rows = proposed.select("query_id", F.col("sub_no").cast("int").alias("sub_no"), "text").where("trim(text) <> ''")
    bare = queries.join(rows.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(0).alias("sub_no"), "text")
    return rows.join(queries.select("query_id"), "query_id", "left_semi").unionByName(bare)


def tried(wordings: DataFrame, before: DataFrame | None) -> DataFrame:
    """(query_id, text) of all wordings so far."""
    rows = wordings.select("query_id", "text")
    return rows if before is None else before.unionByName(rows).distinct()


@register("agent", "reading")
class ReadingAgent:
    """Decomposes, searches every wording on its own, reads and judges the candidates, and refines what is missing.

    decompose (queries -> (query_id, sub_no, text)); judge (candidates -> (query_id, doc_id, order, sufficient,
    missing)); refine ((query_id, text, missing), tried -> (query_id, sub_no, text)). A chunk counts with its
    best score of all wordings. A query's verdict is its last one that names a candidate; it stops once that is
    sufficient, or nothing new is proposed. Without a verdict the candidates' order stands.
    """

    def __init__(self, retriever: HybridRetriever, judge: Judge, refine: Callable[[DataFrame, DataFrame], DataFrame], decompose: Judge | None = None, top_k: int = 20, rounds: int = 3, docs: int = 15, chunks: int = 2, mode: str = "task_family", most: int = 10):
        self.retriever, self.judge, self.refine, self.decompose = retriever, judge, refine, decompose
        self.top_k, self.rounds, self.docs, self.chunks, self.mode, self.most = top_k, rounds, docs, chunks, mode, most

    def run(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(picked documents, candidate documents, 50 a query)."""
        rounds = Rounds(queries.sparkSession)
        base = rounds.keep(queries)
        split = self.decompose(base) if self.decompose else base.select("query_id", F.lit(0).alias("sub_no"), "text")
        wordings, chunks, verdicts, used = rounds.keep(with_question(base, split)), None, None, None
        for turn in range(self.rounds):
            used = rounds.keep(tried(wordings, used))
            hits = search_apart(wordings, lambda q: self.retriever.retrieve(q, self.top_k)).withColumn("run", F.col("sub_no") + (turn << 16)).drop("sub_no")
            every = hits if chunks is None else chunks.unionByName(hits)
            chunks = rounds.keep(ranking.best_hits(every).select("query_id", "run", "rank", "chunk_id", "doc_id", "score"))
            open_ = wordings.select("query_id").distinct()
            found = ranking.candidate_docs(chunks.join(open_, "query_id", "left_semi"), self.docs, self.chunks)
            new = self.judge(found).join(found.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
            new = new.groupBy("query_id", "doc_id").agg(F.min("order").alias("order"), F.bool_or("sufficient").alias("sufficient"), F.max("missing").alias("missing"))
            new = rounds.keep(new)
            if verdicts is None:
                verdicts = new
            else:
                verdicts = rounds.keep(verdicts.join(new.select("query_id").distinct(), "query_id", "left_anti").unionByName(new))
            if turn + 1 == self.rounds:
                break
            state = verdicts.groupBy("query_id").agg(F.bool_or("sufficient").alias("s"), F.max("missing").alias("missing"))
            left = base.join(open_, "query_id", "left_semi").join(state, "query_id", "left").where(~F.coalesce("s", F.lit(False)))
            left = left.select("query_id", "text", F.coalesce("missing", F.lit("")).alias("missing"))
            wordings = rounds.keep(self.refine(left, used).where("trim(text) <> ''").join(left.select("query_id"), "query_id", "left_semi").select("query_id", F.col("sub_no").cast("int").alias("sub_no"), "text"))
            if wordings.isEmpty():
                break
        candidates = ranking.doc_scores(chunks.drop("rank").withColumn("rank", F.col("run") * 1000), "max", 50)
        judged = verdicts.join(candidates.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
        picked = ranking.numbered(judged, ["query_id"], [F.asc("order"), F.asc("doc_id")]).select("query_id", "rank", "doc_id", "score")
        rest = candidates.join(verdicts.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "rank", "doc_id", "score")
        final = ranking.family_cutoff(picked.unionByName(rest), families(base), self.mode, self.most)
        return rounds.finish(final, candidates)


@register("agent", "iterative")
class IterativeAgent:
    """Decomposes comparing questions and searches round by round until enough documents are found or growth stops.

    decompose (comparing queries -> (query_id, sub_no, text)); passage (wordings -> wordings with hypothetical
    passages for texts); estimate (comparing queries -> (query_id, n) documents needed); refine ((query_id, text),
    found, tried -> (query_id, sub_no, text)). A document counts with the hit that found it first. A query stops
    when it has as many documents as its estimate or family asks for (a family without a number asks for none),
    when growth stayed at or under the threshold for patience rounds, or when nothing new is proposed.
    Documents come by score, cut to the estimate or the family's number.
    """

    def __init__(
        self,
        retriever: HybridRetriever,
        refine: Callable[[DataFrame, DataFrame, DataFrame], DataFrame],
        decompose: Judge | None = None,
        passage: Judge | None = None,
        estimate: Judge | None = None,
        top_k: int = 20,
        rounds: int = 3,
        threshold: float = 0.0,
        patience: int = 1,
    ):
        self.retriever, self.refine, self.decompose, self.passage, self.estimate = retriever, refine, decompose, passage, estimate
        self.top_k, self.rounds, self.threshold, self.patience = top_k, rounds, threshold, patience

    def run(self, queries: DataFrame) -> DataFrame:
        rounds = Rounds(queries.sparkSession)
        known = families(queries)
        base = rounds.keep(queries.select("query_id", "text").join(known, "query_id"))
        multi = base.where(F.col("task_family") == MULTI)
        empty = base.limit(0).select("query_id", F.lit(0).alias("sub_no"), "text")
        wordings = rounds.keep(with_question(base, self.decompose(multi) if self.decompose else empty))
        asked = self.estimate(multi).where("n >= 1").select("query_id", F.floor("n").cast("int").alias("n")) if self.estimate else base.limit(0).select("query_id", F.lit(0).alias("n"))
        number = lambda table: reduce(lambda out, item: F.when(F.col("task_family") == item[0], item[1]).otherwise(out), table.items(), F.lit(None).cast("int"))
        goals = rounds.keep(base.join(asked, "query_id", "left").select("query_id", F.coalesce("n", number(ranking.FAMILY_ENOUGH)).alias("enough"), F.coalesce("n", number(ranking.FAMILY_CUTOFF)).alias("cutoff")))
        found, sizes, used = None, None, None
        for turn in range(self.rounds):
            used = rounds.keep(tried(wordings, used))
            sought = wordings
            if self.passage:
                better = self.passage(wordings).where("trim(text) <> ''").select("query_id", "sub_no", F.trim("text").alias("passage"))
                sought = wordings.join(better, ["query_id", "sub_no"], "left").select("query_id", "sub_no", F.coalesce("passage", "text").alias("text"))
            hits = search_apart(sought, lambda q: self.retriever.retrieve(q, self.top_k)).withColumn("run", F.col("sub_no") + (turn << 16)).drop("sub_no")
            first = ranking.first_hits(hits).select("query_id", "doc_id", "run", "rank", "chunk_id", "score")
            if found is not None:
                first = found.unionByName(first.join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))
            found = rounds.keep(first)
            total = base.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("total")), "query_id", "left").select("query_id", F.coalesce("total", F.lit(0)).alias("total"), F.lit(turn).alias("round"))
            sizes = rounds.keep(total if sizes is None else sizes.unionByName(total))
            if turn + 1 == self.rounds:
                break
            now = ranking.growth(sizes, threshold=self.threshold).where(F.col("round") == turn).join(goals, "query_id")
            done = F.col("enough").isNull() | (F.col("total") >= F.col("enough")) | (F.col("stagnant") >= self.patience)
            left = base.join(wordings.select("query_id").distinct(), "query_id", "left_semi").join(now.where(~done).select("query_id"), "query_id", "left_semi").select("query_id", "text")
            wordings = rounds.keep(self.refine(left, found, used).where("trim(text) <> ''").join(left.select("query_id"), "query_id", "left_semi").select("query_id", F.col("sub_no").cast("int").alias("sub_no"), "text"))
            if wordings.isEmpty():
                break
        ranked = ranking.numbered(found, ["query_id"], [F.desc("score"), F.asc("run"), F.asc("rank"), F.asc("doc_id")], "place").join(goals.select("query_id", "cutoff"), "query_id")
        ranked = ranked.where(F.col("cutoff").isNull() | (F.col("place") <= F.col("cutoff")))
        return rounds.finish(ranked.select("query_id", F.col("place").alias("rank"), "doc_id", "score"))[0]
