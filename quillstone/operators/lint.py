"""Submission lint: one boolean per check and row, counted with examples; checks without a failure appear with 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.metrics import EVIDENCE_TYPES

EXAMPLES = 5


def checks() -> dict[str, Column]:
    """Conditions under which a prediction row fails; columns as in the predictions' schema."""
    papers = F.transform(F.coalesce("gold_papers", F.array().cast("array<string>")), lambda p: F.trim(p))
    evidence = F.coalesce("evidence", F.array().cast("array<struct<paper_id:string,source_type:string,page:string,text:string>>"))
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    return {
        "blank_query_id": blank(F.col("query_id")),
        "papers_missing": F.col("gold_papers").isNull(),
        "papers_empty": F.size(F.coalesce("gold_papers", F.array().cast("array<string>"))) == 0,
        "paper_id_blank": F.exists(papers, blank),
        "papers_repeated": F.size(F.array_distinct(papers)) < F.size(papers),
        "evidence_missing": F.col("evidence").isNull(),
        "evidence_too_many": F.size(evidence) > 4,
        "evidence_type_unknown": F.exists(evidence, lambda e: ~F.coalesce(e["source_type"], F.lit("")).isin(*EVIDENCE_TYPES)),
        "evidence_paper_foreign": F.exists(evidence, lambda e: ~F.coalesce(F.array_contains(papers, F.trim(e["paper_id"])), F.lit(False))),
        "evidence_page_blank": F.exists(evidence, lambda e: blank(e["page"])),
        "evidence_page_not_number": F.exists(evidence, lambda e: ~blank(e["page"]) & ~F.trim(e["page"]).rlike("^[0-9]+$")),
        "evidence_text_blank": F.exists(evidence, lambda e: blank(e["text"])),
        "answer_missing": F.col("answer").isNull(),
        "choice_not_offered": F.col("answer").isNotNull() & F.col("options").isNotNull() & ~F.coalesce(F.map_contains_key("options", F.upper(F.trim("answer"))), F.lit(False)),
    }


def lint(predictions: DataFrame, gold: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(check, n, examples): row checks, repeated ids, and ids that gold lacks or predictions lack."""
    failed = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks().items()))
    rows = predictions.select("query_id", F.explode(F.array_compact(failed)).alias("check"))
    repeated = predictions.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id", F.lit("query_id_repeated").alias("check"))
    missing = gold.select("query_id").distinct().join(predictions.select("query_id"), "query_id", "left_anti").withColumn("check", F.lit("query_missing"))
    extra = predictions.select("query_id").distinct().join(gold.select("query_id"), "query_id", "left_anti").withColumn("check", F.lit("query_unknown"))
    every = rows.unionByName(repeated).unionByName(missing).unionByName(extra)
    # the least examples of each check are kept by a bounded aggregate
    counted = every.groupBy("check").agg(F.count("*").alias("n"))
    shown = every.select("check", F.coalesce("query_id", F.lit("")).alias("query_id")).distinct()
    ranked = shown.withColumn("r", F.row_number().over(_by_check())).where(F.col("r") <= examples)
    shown = ranked.groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("query_id")), ",").alias("examples"))
    names = [*checks(), "query_id_repeated", "query_missing", "query_unknown"]
    dimension = predictions.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("check"))
    return dimension.join(counted, "check", "left").join(shown, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))


def _by_check():
    from pyspark.sql import Window

    return Window.partitionBy("check").orderBy("query_id")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
