"""Resumable bounded ingest and event-time windows on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators.logs import last_write_wins


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 8):
    """Streams JSON-line files into a Parquet table batch by batch and ends when the input does.

    The checkpoint resumes after the last committed batch. A batch is written under its number, so
    a repeated batch replaces itself, and keys that earlier batches completed are left out.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        try:
            done = spark.read.parquet(target).where(F.col("batch") < number).select(key).distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        rows = rows if done is None else rows.join(done, key, "left_anti")
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def completed(uploads: DataFrame, key: str = "paper_id") -> DataFrame:
    """Keys all of whose rows (key, status) went up; rows that were skipped for want of a vector don't block."""
    return uploads.groupBy(key).agg(F.bool_and(F.col("status").isin("ok", "embed_skipped")).alias("whole")).where("whole").select(key)


def retry_pass(log: DataFrame, key: str, most: int) -> DataFrame:
    """Keys whose last row failed and that were tried fewer than most times."""
    tries = log.groupBy(key).agg(F.count("*").alias("tries"))
    return last_write_wins(log, [key]).where("status = 'failed'").join(tries, key).where(F.col("tries") < most).select(key, "tries")


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Per window and type: count and sum; with late also a watermark, for streams."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Per user the sessions that gaps of at least gap part: start, end of the last event's gap, number of events."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(events: DataFrame, key: str, pos: str) -> DataFrame:
    """Last write wins on a stream: of each key the row of the largest pos so far, whenever it changes (update mode).

    The state of a key is one row; earlier rows that come late change nothing.
    """
    columns = events.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        at, changed = columns.index(pos), False
        for df in frames:
            row = tuple(x.item() if hasattr(x, "item") else x for x in df.loc[df[pos].idxmax(), columns])
            if best is None or row[at] > best[at]:
                best, changed = row, True
        if changed:
            state.update(best)
            yield pd.DataFrame([best], columns=columns)

    return events.groupBy(key).applyInPandasWithState(step, kinds, kinds, "update", GroupStateTimeout.NoTimeout)
