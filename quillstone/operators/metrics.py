"""Set, ranking, evidence and table-answer metrics, one row per query until the last aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import cell_equal, normalize_id, normalize_text, normalize_visible_id

#: Recall cut-offs, scenarios, evidence types.
KS = (1, 5, 10, 20, 50)
SCENARIOS = {"hidden_source_single_paper": "single", "multi_paper": "multi"}
EVIDENCE_TYPES = ("text_span", "table", "figure", "citation_context", "equation_algorithm")


def prf(n_gold: Column, n_pred: Column, n_both: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1: both empty (1, 1, 1), no prediction (0, 0, 0), no gold (0, 1, 0)."""
    both_empty = (n_gold == 0) & (n_pred == 0)
    p = F.when(both_empty, 1.0).when(n_pred == 0, 0.0).otherwise(F.try_divide(n_both.cast("double"), n_pred))
    r = F.when(both_empty, 1.0).when(n_pred == 0, 0.0).when(n_gold == 0, 1.0).otherwise(F.try_divide(n_both.cast("double"), n_gold))
    f = F.when(both_empty, 1.0).when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(0.0)
    return p, r, f


def set_prf(gold: DataFrame, pred: DataFrame, key: list[str], queries: DataFrame | None = None) -> DataFrame:
    """prf per query_id of two relations of keys; queries names those that may have neither."""
    tagged = gold.select("query_id", *key).distinct().withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(pred.select("query_id", *key).distinct().withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
    per_key = tagged.groupBy("query_id", *key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counts = per_key.groupBy("query_id").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.col("g") * F.col("p")).alias("n_both"))
    if queries is not None:
        counts = queries.select("query_id").distinct().join(counts, "query_id", "left").na.fill(0)
    p, r, f = prf(F.col("n_gold"), F.col("n_pred"), F.col("n_both"))
    return counts.select("query_id", *(F.col(c).cast("long").alias(c) for c in ("n_gold", "n_pred", "n_both")), F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f1"))


def recall_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, empty: float = 1.0) -> DataFrame:
    """(query_id, k, n_gold, n_found, recall) for every query of gold; ranks from 1; a query of null doc_ids has no gold."""
    n = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_gold"))
    found = ranked.join(gold.where("doc_id is not null").distinct(), ["query_id", "doc_id"]).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    ranks = found.groupBy("query_id").agg(F.collect_list("rank").alias("ranks"))
    grid = n.join(ranks, "query_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.size(F.filter(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: r <= F.col("k"))).cast("long")
    recall = F.when(F.col("n_gold") == 0, empty).otherwise(F.try_divide(hit.cast("double"), F.col("n_gold")))
    return grid.select("query_id", "k", "n_gold", hit.alias("n_found"), F.round(recall, 9).alias("recall"))


def scenario_grid(recalls: DataFrame, families: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Mean recall of single, multi and total at each k; all cells, null where no query falls in one; unknown families count in total only."""
    spark = recalls.sparkSession
    scenario = F.lit(None).cast("string")
    for family, name in SCENARIOS.items():
        scenario = F.when(F.col("task_family") == family, name).otherwise(scenario)
    rows = recalls.join(families, "query_id", "left").select("k", "recall", F.explode(F.array_compact(F.array(scenario, F.lit("total")))).alias("scenario"))
    means = rows.groupBy("scenario", "k").agg(F.round(F.avg("recall"), 9).alias("recall"), F.count("*").alias("n"))
    cells = spark.range(1).select(F.explode(F.array(*map(F.lit, ("single", "multi", "total")))).alias("scenario")).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return cells.join(means, ["scenario", "k"], "left").select("scenario", "k", "recall", F.coalesce("n", F.lit(0)).alias("n"))


def retrieval_sweep(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per k: mean recall, precision (hits / k) and hit rate over the queries of gold."""
    rows = recall_at(ranked, gold, ks)
    return rows.groupBy("k").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.col("n_found") / F.col("k")), 6).alias("precision"), F.round(F.avg((F.col("n_found") > 0).cast("double")), 6).alias("hit_rate"), F.count("*").alias("n_queries"))


def macro(value: Column) -> tuple[Column, Column]:
    """Mean with 0 for no rows, and with null for no rows."""
    return F.coalesce(F.avg(value), F.lit(0.0)), F.avg(value)


def micro(correct: Column, total: Column) -> Column:
    return F.try_divide(F.sum(correct).cast("double"), F.sum(total))


def evidence_keys(evidence: DataFrame) -> DataFrame:
    """Distinct (query_id, doc_id, source_type, page, object_id); rows without document, type or page are dropped."""
    object_id = F.when(F.col("source_type") == "table", normalize_visible_id(F.col("table_id"), "table")).when(F.col("source_type") == "figure", normalize_visible_id(F.col("figure_id"), "figure")).otherwise("")
    keys = evidence.select("query_id", normalize_id(F.col("doc_id")).alias("doc_id"), normalize_id(F.col("source_type")).alias("source_type"), normalize_id(F.col("page")).alias("page"), object_id.alias("object_id"))
    return keys.where("doc_id <> '' and source_type <> '' and page <> ''").distinct()


def modality_hits(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per evidence type: gold items, those whose (document, page) was retrieved, those without a page. All types are returned."""
    pages = retrieved.select("query_id", "doc_id", F.col("page").cast("string").alias("page")).distinct().withColumn("hit", F.lit(1))
    rows = gold.withColumn("page", F.col("page").cast("string")).where(F.col("source_type").isin(*EVIDENCE_TYPES)).join(pages, ["query_id", "doc_id", "page"], "left")
    counts = rows.groupBy("source_type").agg(F.count("page").alias("n_total"), F.count("hit").alias("n_hit"), F.count_if(F.col("page").isNull()).alias("n_no_page"))
    types = gold.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, EVIDENCE_TYPES))).alias("source_type"))
    return types.join(counts, "source_type", "left").na.fill(0)


def table_scores(schema: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Row F1 and cell accuracy of table answers.

    schema (query_id, pos, name, type, is_row_key); gold and pred (query_id, row_no, cells map).
    Row keys default to the first column; of rows with equal keys the last counts; a gold row that
    the prediction lacks has all its cells wrong; with no comparable cell the accuracy is the row F1;
    without a schema the row F1 is 1.
    """
    declared = schema.groupBy("query_id").agg(F.max(F.col("is_row_key").cast("int")).alias("any_key"), F.min("pos").alias("first"))
    typed = schema.join(declared, "query_id").withColumn("key", F.when(F.col("any_key") == 1, F.col("is_row_key")).otherwise(F.col("pos") == F.col("first")))
    keys = typed.where("key").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("keys"))
    plain = typed.where(~F.col("is_row_key")).where("name <> ''").select("query_id", "name", "type")
    by_key = lambda rows: rows.join(keys, "query_id").withColumn("row_key", F.transform("keys", lambda k: normalize_text(F.col("cells")[k]))).groupBy("query_id", "row_key").agg(F.max_by("cells", "row_no").alias("cells"))
    g, p = by_key(gold), by_key(pred).withColumnRenamed("cells", "pred_cells")
    joined = g.join(p, ["query_id", "row_key"], "full")
    rows = joined.groupBy("query_id").agg(F.count("cells").alias("n_gold"), F.count("pred_cells").alias("n_pred"), F.count_if(F.col("cells").isNotNull() & F.col("pred_cells").isNotNull()).alias("n_both"))
    cells = joined.where("cells is not null").join(plain, "query_id")
    same = F.col("pred_cells").isNotNull() & cell_equal(F.col("cells")[F.col("name")], F.col("pred_cells")[F.col("name")], F.col("type"))
    cells = cells.groupBy("query_id").agg(F.count_if(same).alias("cell_correct"), F.count("*").alias("cell_total"))
    every = gold.select("query_id").union(pred.select("query_id")).union(schema.select("query_id")).distinct()
    out = every.join(rows, "query_id", "left").join(cells, "query_id", "left").na.fill(0)
    _, _, f1 = prf(F.col("n_gold"), F.col("n_pred"), F.col("n_both"))
    accuracy = F.when(F.col("cell_total") > 0, F.try_divide(F.col("cell_correct").cast("double"), F.col("cell_total"))).otherwise(f1)
    return out.select("query_id", F.round(f1, 9).alias("row_f1"), F.round(accuracy, 9).alias("cell_accuracy"), "cell_correct", "cell_total")


def run_delta(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two runs (query_id, metric, value): means and changes per metric, and the queries that changed."""
    pairs = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["query_id", "metric"])
    changed = F.abs(F.col("b") - F.col("a")) > 1e-9
    means = pairs.groupBy("metric").agg(F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg("b") - F.avg("a"), 6).alias("delta"), F.count_if(changed).alias("n_changed"))
    flips = pairs.where(changed).select("metric", "query_id", F.when(F.col("b") > F.col("a"), "+").otherwise("-").alias("sign"), F.round(F.col("b") - F.col("a"), 6).alias("change"))
    return means, flips
