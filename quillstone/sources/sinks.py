"""Sinks. Writers commit through Spark's output protocol, so readers see whole results or none."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode(mode).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only; compacted when read, by last write."""
    df.write.mode("append").parquet(path)


def concatenate(df: DataFrame, path: str, order: list[str]) -> int:
    """Non-blank lines (column value) in order; returns how many, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = df.where(F.length(F.trim("value")) > 0).orderBy(*order).select("value")
    # observed above the sort, whose sampling reads its input twice
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").text(path)
    return int(seen.get["n"])


def write_per_paper(df: DataFrame, path: str, key: str = "paper_id") -> None:
    """Replaces only the partitions of the papers that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_keys(df: DataFrame, path: str, key: str) -> None:
    df.select(F.col(key).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table of at most most rows: nulls as -, floats with three decimals, nested values as JSON."""

    def show(x) -> str:
        if x is None:
            return "-"
        if isinstance(x, float):
            return f"{x:.3f}"
        return json.dumps(x.asDict(True) if hasattr(x, "asDict") else x, default=str) if not isinstance(x, (str, int)) else str(x).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in df.limit(most).collect())])


def index_rows(chunks: DataFrame, schema: dict[str, str], live: list[str] | None = None) -> DataFrame:
    """Index documents: the schema's columns, cast, text never null; columns that the live index lacks are left out."""
    columns = [F.coalesce(F.col(c), F.lit("")).cast(t).alias(c) if t == "string" and c != "award" else F.col(c).cast(t).alias(c) for c, t in schema.items() if c in chunks.columns]
    out = chunks.select(*columns)
    return out.drop(*[c for c in out.columns if live is not None and c not in live])
