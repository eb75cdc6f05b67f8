"""Object locators: alignment of captions with tables, and repair of positional ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import normalize_object_id


def first_captions(captions: DataFrame) -> DataFrame:
    """Of captions (paper_id, pos, label, page) with the same label, case aside, the first."""
    w = Window.partitionBy("paper_id", F.lower("label")).orderBy("pos")
    return captions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def align_tables(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """(paper_id, table_pos, label, mode) for tables (paper_id, pos, page) and captions (paper_id, pos, label, page).

    Where every page has as many tables as captions they are paired page by page, else where the
    totals agree in order, else greedily: see greedy_align.
    """
    t = tables.groupBy("paper_id", "page").agg(F.count("*").alias("nt"))
    c = captions.groupBy("paper_id", "page").agg(F.count("*").alias("nc"))
    pages = t.join(c, ["paper_id", "page"], "full").na.fill(0, ["nt", "nc"])
    mode = pages.groupBy("paper_id").agg(F.bool_and(F.col("nt") == F.col("nc")).alias("paged"), (F.sum("nt") == F.sum("nc")).alias("total"))
    mode = mode.select("paper_id", F.when(F.col("paged"), "page").when(F.col("total"), "total").otherwise("greedy").alias("mode"))
    by_page, by_all = Window.partitionBy("paper_id", "page").orderBy("pos"), Window.partitionBy("paper_id").orderBy("pos")
    number = lambda df: df.withColumns({"kp": F.row_number().over(by_page), "ka": F.row_number().over(by_all)}).join(mode, "paper_id")
    a = number(tables).withColumnRenamed("pos", "table_pos")
    b = number(captions).withColumnRenamed("pos", "caption_pos")
    paged = a.where("mode = 'page'").join(b.drop("mode", "ka"), ["paper_id", "page", "kp"]).select("paper_id", "table_pos", "label", "mode")
    total = a.where("mode = 'total'").join(b.drop("mode", "kp", "page"), ["paper_id", "ka"]).select("paper_id", "table_pos", "label", "mode")
    rest = mode.where("mode = 'greedy'").select("paper_id")
    greedy = greedy_align(tables.join(rest, "paper_id", "left_semi"), captions.join(rest, "paper_id", "left_semi"))
    return paged.unionByName(total).unionByName(greedy)


def greedy_align(tables: DataFrame, captions: DataFrame, slack: int = 1) -> DataFrame:
    """Order-keeping pairs of tables and captions whose pages differ by at most slack; whichever side lies further behind moves on."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left.sort_values("pos"), right.sort_values("pos")
        pages_a, pages_b = a["page"].tolist(), b["page"].tolist()
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            gap = pages_a[i] - pages_b[j]
            if abs(gap) <= slack:
                out.append((key[0], int(a["pos"].iloc[i]), b["label"].iloc[j], "greedy"))
                i, j = i + 1, j + 1
            elif gap < 0:
                i += 1
            else:
                j += 1
        return pd.DataFrame(out, columns=["paper_id", "table_pos", "label", "mode"])

    left, right = tables.select("paper_id", "pos", "page"), captions.select("paper_id", "pos", "page", "label")
    kind = left.schema["paper_id"].dataType.simpleString()
    pos = left.schema["pos"].dataType.simpleString()
    return left.groupBy("paper_id").cogroup(right.groupBy("paper_id")).applyInPandas(run, f"paper_id {kind}, table_pos {pos}, label string, mode string")


def repaired(chunks: DataFrame, aligned: DataFrame, owned: DataFrame) -> DataFrame:
    """chunks (paper_id, pos, page, table_id) with new_id: the aligned label, unless a caption owns it on another page or the chunk has a caption's label already."""
    labels = aligned.select("paper_id", F.col("table_pos").alias("pos"), "label")
    pages = owned.groupBy("paper_id", F.lower("label").alias("low")).agg(F.collect_set("page").alias("pages"))
    rows = chunks.join(labels, ["paper_id", "pos"], "left").withColumn("low", F.lower("label")).join(pages, ["paper_id", "low"], "left")
    free = F.col("pages").isNull() | F.array_contains("pages", F.col("page"))
    return rows.withColumn("new_id", F.when(F.col("label").isNotNull() & free, F.col("label")).otherwise(F.col("table_id"))).drop("low", "pages", "label")


def resolve_references(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs (ref_id, paper_id, object_id, page) to objects (paper_id, object_id, page): by normalized id first, else the first object of the page."""
    key = normalize_object_id(F.col("object_id"))
    named = objects.select("paper_id", key.alias("key"), F.col("object_id").alias("by_id")).groupBy("paper_id", "key").agg(F.min("by_id").alias("by_id"))
    placed = objects.groupBy("paper_id", "page").agg(F.min("object_id").alias("by_page"))
    out = refs.withColumn("key", key).join(named, ["paper_id", "key"], "left").join(placed, ["paper_id", "page"], "left")
    return out.select("ref_id", "paper_id", F.coalesce("by_id", "by_page").alias("resolved"), F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_page").isNotNull(), "page").otherwise("none").alias("how"))


def gold_coverage(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """gold items with whether their (paper_id, source_type, page, object) key is among the chunks before and after a repair."""
    key = ["paper_id", "source_type", "page", "object"]
    norm = lambda df: df.withColumn("object", normalize_object_id(F.col("object_id")))
    flag = lambda df, name: norm(df).select(*key).distinct().withColumn(name, F.lit(True))
    out = norm(gold).join(flag(before, "b"), key, "left").join(flag(after, "a"), key, "left")
    return out.withColumns({"before": F.coalesce("b", F.lit(False)), "after": F.coalesce("a", F.lit(False))}).drop("a", "b")
