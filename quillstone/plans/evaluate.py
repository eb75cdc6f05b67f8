"""Scores of predictions against gold: documents, evidence, choices, free text, tables and recall cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import normalize_id, normalize_text
from quillstone.operators import metrics
from quillstone.operators.logs import last_write_wins, missing_and_extra


def predictions_by_id(predictions: DataFrame) -> DataFrame:
    """The last prediction of each id; blank ids are dropped."""
    return last_write_wins(predictions.where(F.trim("query_id") != ""), ["query_id"])


def exploded(rows: DataFrame, column: str) -> DataFrame:
    ids = F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), normalize_id), lambda x: x != "")
    return rows.select("query_id", F.posexplode(F.array_distinct(ids)).alias("pos", "doc_id"))


def answer_table(rows: DataFrame, column: str = "answer_rows") -> DataFrame:
    """(query_id, row_no, cells) of table answers, an array of maps."""
    return rows.select("query_id", F.posexplode(column).alias("row_no", "cells"))


def evaluate(gold: DataFrame, predictions: DataFrame, ks: tuple[int, ...] = metrics.KS) -> tuple[DataFrame, DataFrame]:
    """(per query, summary) for gold and predictions (query_id, pos, task_family, papers, evidence, choice, freeform, candidates).

    Table answers are scored where gold has the columns table_schema (an array of (name, type,
    is_row_key)) and answer_rows (an array of maps), which predictions then have too. A gold row without
    prediction scores as an empty one. The summary is one row of all metrics: macro means of
    documents, evidence and tables (0 without a query), accuracies (null without one), the recall cells
    recall_<k>_<scenario>, null where no query falls in one or no prediction lists candidates, and counts.
    """
    pred = predictions_by_id(predictions)
    ids = gold.select("query_id").distinct()
    own = pred.join(ids, "query_id", "left_semi")
    papers = metrics.set_prf(exploded(gold, "papers"), exploded(own, "papers"), ["doc_id"], ids)
    unpack = lambda df: df.select("query_id", F.explode("evidence").alias("e")).select("query_id", F.col("e.paper_id").alias("doc_id"), "e.source_type", "e.page", "e.table_id", "e.figure_id")
    evidence = metrics.set_prf(metrics.evidence_keys(unpack(gold)), metrics.evidence_keys(unpack(own)), ["doc_id", "source_type", "page", "object_id"], ids)
    has = lambda kind: F.coalesce(F.array_contains("answer_types", kind), F.lit(False))
    answers = gold.select("query_id", "task_family", F.upper(normalize_id(F.col("choice"))).alias("gc"), normalize_text(F.col("freeform")).alias("gf"), has("multiple_choice").alias("mc"), has("freeform").alias("ff"), has("table").alias("tt"))
    given = pred.select("query_id", F.upper(normalize_id(F.col("choice"))).alias("pc"), normalize_text(F.col("freeform")).alias("pf"), F.col("candidates").isNotNull().alias("listed"))
    joined = answers.join(given, "query_id", "left").na.fill("", ["pc", "pf"]).na.fill(False, ["listed"])
    joined = joined.select("query_id", "task_family", "listed", "tt", F.when(F.col("mc"), (F.col("gc") == F.col("pc")).cast("double")).alias("mc_accuracy"), F.when(F.col("ff"), (F.col("gf") == F.col("pf")).cast("double")).alias("freeform_accuracy"))
    named = lambda rows, kind: rows.select("query_id", *(F.col(c).alias(f"{kind}_{c}") for c in ("precision", "recall", "f1")))
    rows = joined.join(named(papers, "paper"), "query_id").join(named(evidence, "evidence"), "query_id")
    scores = ("row_f1", "cell_accuracy", "cell_correct", "cell_total")
    if "table_schema" in gold.columns:
        schema = gold.select("query_id", F.posexplode("table_schema").alias("pos", "c")).select("query_id", "pos", "c.name", "c.type", "c.is_row_key")
        asked = gold.where(has("table")).select("query_id")
        tables = metrics.table_scores(*(df.join(asked, "query_id", "left_semi") for df in (schema, answer_table(gold), answer_table(own))))
        rows = rows.join(tables, "query_id", "left")
        # without rows and schema on both sides nothing is wrong
        whole = F.when(F.col("tt") & F.col("row_f1").isNull(), 1.0)
        rows = rows.withColumns({"row_f1": F.when(F.col("tt"), F.coalesce("row_f1", whole)), "cell_accuracy": F.when(F.col("tt"), F.coalesce("cell_accuracy", whole))})
    else:
        rows = rows.select("*", *(F.lit(None).cast("double" if c in scores[:2] else "long").alias(c) for c in scores))
    rows = rows.drop("tt")
    zero = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    null = lambda c: F.round(F.avg(c), 6).alias(c)
    means = [zero(f"{kind}_{c}") for kind in ("paper", "evidence") for c in ("precision", "recall", "f1")]
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in scores[2:]]
    micro = F.round(F.try_divide(F.sum("cell_correct").cast("double"), F.sum("cell_total")), 6).alias("cell_accuracy_micro")
    summary = rows.agg(*means, null("mc_accuracy"), null("freeform_accuracy"), zero("row_f1"), zero("cell_accuracy"), micro, *counts, F.count("*").alias("n"))
    sides = missing_and_extra(gold.select("query_id"), pred.select("query_id"))
    n_sides = sides.agg(F.count_if(F.col("side") == "missing").alias("n_missing"), F.count_if(F.col("side") == "extra").alias("n_extra"))
    cells = candidate_recall(gold, predictions, ks)
    wide = cells.agg(*(F.max(F.when((F.col("scenario") == s) & (F.col("k") == k), F.round("recall", 6))).alias(f"recall_{k}_{s}") for s in ("single", "multi", "total") for k in ks), *(F.max(F.when((F.col("scenario") == s) & (F.col("k") == ks[0]), F.col("n"))).alias(f"n_{s}") for s in ("single", "multi", "total")))
    # rows of one line each
    return rows, summary.join(F.broadcast(n_sides)).join(F.broadcast(wide))


def candidate_recall(gold: DataFrame, predictions: DataFrame, ks: tuple[int, ...] = metrics.KS) -> DataFrame:
    """Recall cells of scenario and k; all null if no prediction lists candidates."""
    pred = predictions_by_id(predictions)
    ranked = exploded(pred, "candidates").select("query_id", "doc_id", (F.col("pos") + 1).alias("rank"))
    wanted = gold.select("query_id").distinct().join(exploded(gold, "papers").drop("pos"), "query_id", "left")
    grid = metrics.scenario_grid(metrics.recall_at(ranked, wanted, ks), gold.select("query_id", "task_family").distinct(), ks)
    if pred.where("candidates is not null").isEmpty():
        return grid.withColumn("recall", F.lit(None).cast("double"))
    return grid
