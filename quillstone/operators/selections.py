"""Record selection, filters and small joins between records, samples and options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import blank_if_null, normalize_alias, strip
from quillstone.operators.logs import ordinals


def include_exclude(rows: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows of included keys (none given: all) that are not excluded; an excluded key loses even if included."""
    if include is not None:
        rows = rows.join(include.select(key).distinct(), key, "left_semi")
    return rows if exclude is None else rows.join(exclude.select(key).distinct(), key, "left_anti")


def equals_all(**wanted) -> Column:
    """AND of the equalities that have a value; true where none has."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items() if v is not None], F.lit(True))


def submission(papers: Column) -> Column:
    return F.transform(papers, lambda p: F.struct(p.alias("paper_id")))


def with_images(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose image_path is set and among the files (path)."""
    return chunks.where("coalesce(image_path, '') <> ''").join(files.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_semi")


def samples(rows: DataFrame, family: str | None = None, ids: DataFrame | None = None, limit: int | None = None, order: str = "pos") -> DataFrame:
    """In this order: a task family, a set of query ids, the first limit rows, those with gold."""
    if family is not None:
        rows = rows.where(F.col("task_family") == family)
    if ids is not None:
        rows = rows.join(ids.select("query_id").distinct(), "query_id", "left_semi")
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    return rows.where(F.size(F.coalesce("gold_papers", F.array().cast("array<string>"))) > 0)


def selected_records(records: DataFrame, selectors: list[DataFrame], done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records that any selector (paper_id) names, in their order and not done; named ids that no record has)."""
    named = reduce(lambda a, b: a.union(b), [s.select("paper_id") for s in selectors]).distinct()
    kept = records.join(named, "paper_id", "left_semi")
    if done is not None:
        kept = kept.join(done.select("paper_id").distinct(), "paper_id", "left_anti")
    return kept, named.join(records.select("paper_id"), "paper_id", "left_anti")


def page_missing(page: Column) -> Column:
    return page.isNull() | (strip(page.cast("string")) == "")


def answer_empty(answer: Column) -> Column:
    """No free text, no chosen letter and no table rows."""
    text = strip(blank_if_null(answer["freeform"]["text"])) == ""
    letter = strip(blank_if_null(answer["multiple_choice"]["gold"])) == ""
    rows = F.coalesce(F.size(answer["table"]["rows"]), F.lit(0)) <= 0
    return answer.isNull() | (text & letter & rows)


def retryable(answer: Column, papers: Column) -> Column:
    """An empty answer together with no papers."""
    return answer_empty(answer) & (F.coalesce(F.size(papers), F.lit(0)) <= 0)


def overlaps(a: DataFrame, b: DataFrame, key: str) -> bool:
    return not a.join(b, key, "left_semi").limit(1).isEmpty()


def resolve_paths(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, path): the first exact candidate name of a paper (names array) among files (path), else a file of its normalized stem."""
    base = F.substring_index("path", "/", -1)
    exact = papers.select("paper_id", F.posexplode("names").alias("order", "name")).join(files.select("path", base.alias("name")), "name").select("paper_id", "order", "path")
    loose = papers.select("paper_id", normalize_alias(F.col("paper_id")).alias("alias")).join(files.select("path", normalize_alias(base).alias("alias")), "alias").select("paper_id", F.lit(1 << 20).alias("order"), "path")
    best = exact.union(loose).groupBy("paper_id").agg(F.min_by("path", F.struct("order", "path")).alias("path"))
    return papers.select("paper_id").join(best, "paper_id", "left")


def against_baseline(run: DataFrame, baseline: DataFrame, metric: str = "recall") -> DataFrame:
    """Rows of run per k with the baseline's value and the difference, null where the baseline has no such k."""
    other = baseline.select("k", F.col(metric).alias("baseline"))
    return run.join(other, "k", "left").withColumn("delta", F.round(F.col(metric) - F.col("baseline"), 6))


def question_scores(gold: DataFrame, recalls: DataFrame) -> DataFrame:
    """Recall of every gold query (query_id, k, recall); a failed question counts as zero at every k."""
    ks = recalls.select("k").distinct()
    grid = gold.select("query_id").distinct().crossJoin(F.broadcast(ks))
    return grid.join(recalls.select("query_id", "k", "recall"), ["query_id", "k"], "left").withColumn("recall", F.coalesce("recall", F.lit(0.0)))


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("k").agg(F.round(F.avg("recall"), 6).alias("recall"), F.count_if(F.col("recall") >= 1).alias("n_complete"), F.count_if(F.col("recall") == 0).alias("n_failed"))


def report_level(ks: list[int], wanted: int = 8) -> int:
    """The wanted level if it was measured, else the middle one."""
    return wanted if wanted in ks else sorted(ks)[len(ks) // 2]


def gold_lists(rows: DataFrame) -> DataFrame:
    """Last list of each query id (query_id, pos, papers), blanks dropped, order kept."""
    clean = F.array_distinct(F.filter(F.transform("papers", lambda p: strip(blank_if_null(p))), lambda p: p != ""))
    return rows.groupBy("query_id").agg(F.max_by("papers", "pos").alias("papers")).withColumn("papers", clean)


def embedded_rows(chunks: DataFrame, name: str = "figure_id") -> tuple[Column, Column]:
    """(table_id, figure_id) of a locator_json column, '' where it has none."""
    parsed = F.from_json(blank_if_null(F.col("locator_json")), "table_id STRING, figure_id STRING")
    return F.coalesce(parsed["table_id"], F.lit("")), F.coalesce(parsed["figure_id"], F.lit(""))


def chunk_record(pages: Column, locator: Column, section: Column) -> tuple[Column, Column]:
    """Sorted distinct pages, and the locator map with page and section filled in where it lacks them."""
    own = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p > 0)))
    first = F.get(own, F.lit(0)).cast("string")
    extra = F.map_filter(F.create_map(F.lit("page"), first, F.lit("section"), section), lambda k, v: v.isNotNull() & ~F.map_contains_key(locator, k))
    return own, F.map_concat(locator, extra)


def batches(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """rows with the number of their fixed-size batch, in ascending order of the given columns."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return ordinals(rows, order, "__i").withColumn("batch", F.floor(F.col("__i") / size)).drop("__i")


def compared_methods(names: Column) -> Column:
    """Up to 8 distinct of the first 12 names, trimmed, of 1 to 80 characters."""
    clean = F.transform(F.slice(names, 1, 12), lambda n: strip(blank_if_null(n)))
    return F.slice(F.array_distinct(F.filter(clean, lambda n: (n != "") & (F.length(n) <= 80))), 1, 8)


def flat_params(options: Column, prefix: str) -> Column:
    return F.transform_keys(options, lambda k, v: F.concat(F.lit(f"{prefix}."), k))


def ocr_suspects(rows: DataFrame) -> DataFrame:
    """Table answers (query_id, row_no, cells map) with empty or lone superscript cells: (query_id, n_empty, n_superscript)."""
    cells = rows.select("query_id", F.explode("cells").alias("name", "value")).where("value is not null")
    return cells.groupBy("query_id").agg(F.count_if(strip(F.col("value")) == "").alias("n_empty"), F.count_if(strip(F.col("value")).rlike("^[⁰¹²³⁴⁵⁶⁷⁸⁹]+$")).alias("n_superscript")).where("n_empty > 0 or n_superscript > 0")
