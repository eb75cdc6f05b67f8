"""Manifest and run-log analytics over append-only logs (key, pos, status, ...), later pos being later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import error_class, url_host


def last_write_wins(log: DataFrame, key: list[str], pos: str = "pos", where: Column | None = None) -> DataFrame:
    """The last row of each key, among the rows that where holds for."""
    rows = log if where is None else log.where(where)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), pos).alias("row")).select(*key, *(F.col(f"row.{c}").alias(c) for c in rest))


def failed_and_missing(log: DataFrame, wanted: DataFrame, done: DataFrame, key: str, failed: str = "failed") -> DataFrame:
    """Keys whose last status is failed, and wanted keys without a done row: (key, reason)."""
    last = last_write_wins(log, [key])
    bad = last.where(F.col("status") == failed).select(key).join(done.select(key), key, "left_anti").withColumn("reason", F.lit("failed"))
    missing = wanted.select(key).distinct().join(done.select(key), key, "left_anti").join(last.select(key), key, "left_anti").withColumn("reason", F.lit("missing"))
    return bad.unionByName(missing)


def resume(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def missing_and_extra(gold: DataFrame, pred: DataFrame, key: str = "query_id") -> DataFrame:
    """Ids on one side only: (key, side)."""
    a, b = gold.select(key).distinct(), pred.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def skip_decision(plan: DataFrame, manifest: DataFrame, files: DataFrame, key: str, least_bytes: int) -> DataFrame:
    """plan with action: skip where the file is there, large enough and not failed last; redo where it is there but not sound; fetch otherwise."""
    last = last_write_wins(manifest, [key]).select(key, "status")
    joined = plan.join(last, key, "left").join(files.select(key, F.col("bytes").alias("have")), key, "left")
    sound = (F.col("have") >= least_bytes) & (F.coalesce("status", F.lit("ok")) != "failed")
    return joined.withColumn("action", F.when(sound, "skip").when(F.col("have").isNotNull(), "redo").otherwise("fetch")).drop("status", "have")


def host_plan(urls: DataFrame, intervals: dict[str, float] | None = None, builtin: dict[str, float] | None = None, default: float = 1.0) -> DataFrame:
    """Per host: number of URLs, seconds between requests (override, then builtin, then default) and the time they take."""
    rows = urls.where("url is not null and url <> ''").groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    wait = F.lit(default)
    for table in (builtin or {}, intervals or {}):
        for host, seconds in table.items():
            wait = F.when(F.col("host") == host, float(seconds)).otherwise(wait)
    return rows.select("host", "n", wait.alias("interval"), F.round(F.col("n") * wait, 6).alias("seconds"))


def error_tally(log: DataFrame, by: list[str]) -> DataFrame:
    """Failures by the given columns and error class, most frequent first by its order number."""
    rows = log.where(F.col("status") == "failed").withColumn("error_class", error_class(F.col("error"), F.col("http_status")))
    counts = rows.groupBy(*by, "error_class").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("error_class"))))


def archive_map(log: DataFrame) -> DataFrame:
    """Last archive of each paper among rows that name one."""
    return last_write_wins(log, ["paper_id"], where=F.coalesce(F.col("archive"), F.lit("")) != "").select("paper_id", "archive")


def shard_modulo(rows: DataFrame, order: Column, shard: int, shards: int) -> DataFrame:
    """Rows whose place in the order is shard modulo shards."""
    return ordinals(rows, [order], "__i").where(F.pmod("__i", F.lit(shards)) == shard).drop("__i")


#: Rows of one range of ordinals(), about, while there are fewer than MOST_RANGES, and sampled keys of a range.
RANGE_ROWS, MOST_RANGES, RANGE_SAMPLE = 500_000, 4000, 20


def ordinals(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows numbered from 0 in a global order, range by range.

    Keys sampled by hash divide the order into ranges of about RANGE_ROWS rows; each range numbers
    its own rows, and the counts of the ranges before it, a small table, are added.
    """
    keyed = rows.withColumn("__key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))))
    n = keyed.count()
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = []
    if parts > 1:
        rare = F.pmod(F.xxhash64("__key"), F.lit(max(1, n // (parts * RANGE_SAMPLE)))) == 0
        keys = [r["__key"] for r in keyed.where(rare).select("__key").distinct().orderBy("__key").collect()]
        bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    types = keyed.schema["__key"].dataType
    table = rows.sparkSession.createDataFrame([(bounds,)], f"bounds array<{types.simpleString()}>")
    placed = keyed.join(F.broadcast(table)).withColumn("__part", F.size(F.filter("bounds", lambda b: b <= F.col("__key")))).drop("bounds") if bounds else keyed.withColumn("__part", F.lit(0))
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    out = placed.withColumn("__own", own).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__key", "__part", "__own", "__before")


def shard_ranges(n: int, shards: int) -> list[tuple[int, int]]:
    """Contiguous ranges [n * i // shards, n * (i + 1) // shards) that cover 0 .. n - 1 once."""
    return [(n * i // shards, n * (i + 1) // shards) for i in range(shards)]


def take_groups(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first limit rows with run_id of their contiguous group and whether the whole group was taken.

    Only the first limit + 1 rows of the order are numbered: the row after the last says whether its group goes on.
    """
    first = rows.orderBy(order).limit(limit + 1)
    whole = Window.orderBy(order)
    starts = F.when(F.lag(group).over(whole).eqNullSafe(F.col(group)), 0).otherwise(1)
    out = first.withColumns({"__start": starts, "__n": F.row_number().over(whole)})
    out = out.withColumn("run_id", F.sum("__start").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    size = Window.partitionBy("run_id")
    out = out.withColumn("complete", F.max("__n").over(size) <= limit)
    return out.where(F.col("__n") <= limit).drop("__start", "__n")


def varying_params(runs: DataFrame) -> DataFrame:
    """Parameters that differ between runs (run_no, params map<string,string>); missing counts as null: (name, n_values, first_run, first_pos)."""
    entries = runs.select("run_no", F.posexplode("params").alias("pos", "name", "value"))
    value = F.coalesce("value", F.lit("null"))
    counts = entries.groupBy("name").agg(F.count_distinct(value).alias("n"), F.count_distinct("run_no").alias("n_runs"), F.bool_or(value == "null").alias("null"), F.min(F.struct("run_no", "pos")).alias("first"))
    whole = runs.agg(F.count_distinct("run_no").alias("whole"))
    absent = (F.col("n_runs") < F.col("whole")) & ~F.col("null")
    out = counts.join(F.broadcast(whole)).select("name", (F.col("n") + absent.cast("int")).alias("n_values"), F.col("first.run_no").alias("first_run"), F.col("first.pos").alias("first_pos"))
    return out.where("n_values > 1")


def experiment_tail(runs: DataFrame, where: Column, n: int) -> DataFrame:
    """The last n runs in log order among those that where holds for."""
    last = runs.where(where).orderBy(F.desc("run_no")).limit(n)
    return last.withColumn("line", F.row_number().over(Window.orderBy("run_no")))


def experiment_table(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Runs (run_no, params, metrics maps) side by side: run_no, a column for each parameter that differs (param_<name>, in order of first appearance) and for each metric.

    Parameters are columns, so their names come to the driver; they are those of a configuration.
    """
    names = [r["name"] for r in varying_params(runs).orderBy("first_run", "first_pos").collect()]
    return runs.select("run_no", *(F.col("params")[n].alias(f"param_{n}") for n in names), *(F.col("metrics")[m].alias(m) for m in metrics))


def scan_statistics(scans: DataFrame, by: list[str], counts: list[str], notes: str = "notes", shown: int = 5) -> DataFrame:
    """Counters of scans (by, pos, counts, notes array) added up, and the first notes in order of pos: a monoid, so parts may be added in any grouping."""
    total = scans.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts), F.count("*").alias("n_scans"))
    notes_of = scans.select(*by, "pos", F.posexplode(notes).alias("no", "note"))
    first = notes_of.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "no"))).where(F.col("__n") <= shown)
    first = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "note"))), lambda x: x["note"]).alias(notes))
    return total.join(first, by, "left")
