"""Deterministic shells around injected models: planning, fallback and merge rules."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import strip, task_family
from quillstone.operators import ranking

MOST_CHARS, LEAST_CHARS = 30_000, 512


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], dims: int, text: str = "text") -> DataFrame:
    """chunks with a nullable vector: texts are cut to 30,000 characters, halved while the model finds them too long
    (down to 512), and null where it refuses them otherwise. A vector of other dimensions is an error."""

    def one(value: str) -> list[float] | None:
        value = (value or "")[:MOST_CHARS]
        while True:
            try:
                vector = model([value])[0]
            except OverflowError:
                if len(value) <= LEAST_CHARS:
                    return None
                value = value[: max(LEAST_CHARS, len(value) // 2)]
                continue
            except ValueError:
                return None
            if len(vector) != dims:
                raise RuntimeError(f"model gave {len(vector)} dimensions, not {dims}")
            return np.asarray(vector, float).tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield df.assign(vector=df[text].map(one))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "vector")
    return chunks.mapInPandas(run, f"{fields}, vector array<double>")


def describe(figures: DataFrame, model: Callable[[str], str | None] | None = None) -> DataFrame:
    """Figures with text: the model's description, else the caption; figures with neither caption nor image are dropped."""
    rows = figures.where("coalesce(caption, '') <> '' or coalesce(image_path, '') <> ''")
    if model is None:
        return rows.withColumn("text", F.coalesce("caption", F.lit("")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            said = df["image_path"].map(lambda p: model(p) if p else None)
            yield df.assign(text=[s or c or "" for s, c in zip(said, df["caption"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in figures.schema if f.name != "text")
    return rows.mapInPandas(run, f"{fields}, text string")


def infer_families(queries: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(query_id, task_family): the input's value, else the last verdict (query_id, pos, task_family) of a known family, else the wording."""
    known = F.lit(None).cast("string")
    rows = queries
    if verdicts is not None:
        good = verdicts.where(F.col("task_family").isin(*ranking.FAMILY_CUTOFF)).groupBy("query_id").agg(F.max_by("task_family", "pos").alias("verdict"))
        rows, known = queries.join(good, "query_id", "left"), F.col("verdict")
    own = F.col("task_family") if "task_family" in queries.columns else F.lit(None).cast("string")
    return rows.select("query_id", F.coalesce(own, known, task_family(F.col("text"))).alias("task_family"))


def wordings(queries: DataFrame, proposed: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, sub_no, text): the original first, then distinct proposals, case aside, most in all."""
    rows = queries.select("query_id", F.lit(0).alias("sub_no"), strip(F.col("text")).alias("text")).unionByName(proposed.select("query_id", "sub_no", strip(F.col("text")).alias("text"))).where("text <> ''")
    first = rows.groupBy("query_id", F.lower("text").alias("low")).agg(F.min(F.struct("sub_no", "text")).alias("x"))
    kept = ranking.top_k(first.select("query_id", "x.sub_no", "x.text"), most, ["query_id"], [F.asc("sub_no")], "n")
    return kept.select("query_id", (F.col("n") - 1).alias("sub_no"), "text")


def scoped_filters(plans: DataFrame, venues: DataFrame) -> DataFrame:
    """plans (query_id, venue, year) with the venue in its known spelling, null if unknown, and years of 1900 to 2100 only."""
    known = venues.groupBy(F.lower("venue").alias("low")).agg(F.min("venue").alias("known"))
    joined = plans.withColumn("low", F.lower(strip(F.col("venue")))).join(known, "low", "left")
    return joined.select("query_id", F.col("known").alias("venue"), F.when(F.col("year").between(1900, 2100), F.col("year")).alias("year"))


def answer_with_retries(ask: Callable[[str, int], str], prompt: str, budget: int = 1000) -> dict | None:
    """The model's JSON object: a length error doubles the budget once, an unreadable answer is asked for again once."""
    for turn in range(2):
        try:
            raw = ask(prompt, budget)
        except OverflowError:
            budget *= 2
            continue
        start, end = raw.find("{"), raw.rfind("}")
        try:
            value = json.loads(raw[start : end + 1])
            if isinstance(value, dict):
                return value
        except json.JSONDecodeError:
            pass
        prompt = f"{prompt}\nAnswer with one JSON object only."
    return None


def corpus_enumeration(hits: DataFrame, verdict: Callable[[DataFrame], DataFrame], shown: int = 20, most: int = 8) -> DataFrame:
    """Documents that a verdict (candidates -> (query_id, doc_id)) keeps of the shown best by fused rank, most at most."""
    fused = ranking.rrf_docs(hits, limit=shown)
    kept = fused.join(verdict(fused).select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    return ranking.top_k(kept.drop("rank"), most, ["query_id"], [F.desc("score"), F.asc("best_rank"), F.asc("doc_id")])


def grow_group(start: DataFrame, propose: Callable[[DataFrame], DataFrame], size: int = 4, rounds: int = 3) -> DataFrame:
    """Groups (query_id, doc_id, order) filled up to size by proposals (query_id, doc_id, rank) in at most rounds rounds."""
    group = start.select("query_id", "doc_id", "order")
    for turn in range(rounds):
        new = propose(group).join(group.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        new = new.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).select("query_id", "doc_id", (F.lit((turn + 1) << 20) + F.col("rank")).alias("order"))
        grown = group.unionByName(new.select("query_id", "doc_id", F.col("order").cast(group.schema["order"].dataType)))
        group = ranking.top_k(grown, size, ["query_id"], [F.asc("order"), F.asc("doc_id")], "__n").drop("__n")
    return group


def confident_only(answers: DataFrame, vision: DataFrame) -> DataFrame:
    """answers (query_id, answer) overwritten by vision answers whose confident is exactly true."""
    sure = vision.where("confident").select("query_id", F.col("answer").alias("seen"))
    return answers.join(sure, "query_id", "left").withColumn("answer", F.coalesce("seen", "answer")).drop("seen")


def provenance(arguments: dict, folder: str = ".") -> dict:
    """Arguments and the revision that they ran on, none if unknown."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
        revision = done.stdout.strip() or None
    except OSError:
        revision = None
    return {"arguments": {k: str(v) for k, v in arguments.items()}, "revision": revision}


def upload(rows: DataFrame, send: Callable[[list[dict]], list[bool]], key: str, rounds: int = 3, size: int = 256) -> DataFrame:
    """Sends rows in batches; those that send refuses, or all of a batch that it fails on, are tried again, rounds times in all: (key, status, attempts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            records = df.to_dict("records")
            for s in range(0, len(records), size):
                left, status, tries = records[s : s + size], {}, {}
                for turn in range(rounds):
                    if not left:
                        break
                    try:
                        good = send(left)
                    except Exception as e:
                        good, note = [False] * len(left), type(e).__name__
                    else:
                        note = "refused"
                    for r, ok in zip(left, good):
                        status[r[key]], tries[r[key]] = "ok" if ok else note, turn + 1
                    left = [r for r, ok in zip(left, good) if not ok]
                yield pd.DataFrame({key: list(status), "status": list(status.values()), "attempts": list(tries.values())})

    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, status string, attempts long")
