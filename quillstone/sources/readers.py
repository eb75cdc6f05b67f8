"""Scans: JSON lines in three strictnesses, documents, id lists, archives, PDFs, options, configuration."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import strip

CORRUPT = "_corrupt"


def jsonl_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Blank lines are skipped, a line that is no object of the schema fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_lenient(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Lines that don't parse, such as a torn last one, are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_counted(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All lines; those that don't parse have their text in _corrupt."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType, required: str | None = None) -> DataFrame:
    """One JSON value per file, arrays giving a row for each element; rows without the required key are dropped."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.where(F.col(required).isNotNull()) if required else rows


def blocks_or_nothing(papers: DataFrame, blocks: DataFrame) -> DataFrame:
    """papers with their blocks; a paper whose blocks are absent or corrupt keeps one row without any."""
    return papers.join(blocks, "paper_id", "left")


def directory(spark: SparkSession, path: str, schema: str | T.StructType, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """JSON-line files of a directory, chosen by file stem before they are opened; hidden files are left out by the reader."""
    rows = spark.read.schema(schema).json(f"{path}/*.jsonl").withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.jsonl$", ""))
    if include:
        rows = rows.where(F.col("stem").isin(*include))
    return rows.where(~F.col("stem").isin(*exclude)) if exclude else rows


def id_list(spark: SparkSession, path: str, grammar: str = "lines") -> DataFrame:
    """Ids of a text file: lines (# begins a comment line), trailing (# begins a comment anywhere), first_field (of tab or comma separated lines)."""
    line = F.col("value")
    if grammar == "trailing":
        line = F.substring_index(line, "#", 1)
    elif grammar == "first_field":
        line = F.get(F.split(line, "[\t,]"), F.lit(0))
    elif grammar != "lines":
        raise ValueError(f"unknown grammar: {grammar}")
    rows = spark.read.text(path).select(strip(line).alias("id")).where("id <> ''")
    return rows.where(~F.col("id").startswith("#")) if grammar == "lines" else rows


def options(record: DataFrame) -> DataFrame:
    """(query_id, options): top-level options, else those nested in the answer; nothing else of the answer is read."""
    return record.select("query_id", F.coalesce("options", "answer.multiple_choice.options").alias("options")).where("options is not null")


def queries(record: DataFrame, known_options: DataFrame | None = None, production: bool = False) -> DataFrame:
    """Queries with options filled in from known_options; in production only id, question, answer_types and table_schema are read."""
    if production:
        record = record.select("query_id", "question", "answer_types", "table_schema").withColumn("options", F.lit(None).cast("map<string,string>"))
    if known_options is None:
        return record
    joined = record.join(known_options.withColumnRenamed("options", "known"), "query_id", "left")
    return joined.withColumn("options", F.coalesce("options", "known")).drop("known")


def guarded_options(samples: DataFrame, known: DataFrame) -> DataFrame:
    """samples (query_id, question, options): inline options win; joined ones count only if the questions agree, case and blanks aside."""
    norm = lambda c: F.regexp_replace(F.lower(strip(c)), r"\s+", " ")
    other = known.select("query_id", F.col("question").alias("q2"), F.col("options").alias("o2"))
    joined = samples.join(other, "query_id", "left")
    return joined.withColumn("options", F.coalesce("options", F.when(norm(F.col("question")) == norm(F.col("q2")), F.col("o2")))).drop("q2", "o2")


def valid_metadata(papers: DataFrame) -> DataFrame:
    return papers.where("coalesce(pdf_url, '') <> '' and coalesce(paper_id, '') <> ''")


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(strip(F.col(column)).alias(column)).where(F.col(column) != "").distinct()


def archive_members(spark: SparkSession, path: str, suffix: str = ".pdf", most_bytes: int = 200 << 20) -> DataFrame:
    """(archive, member, status, bytes, sha256, content) of the zip archives below path whose members end in suffix.

    A member that is too large, or no PDF by its first bytes, has a status and no content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    yield row(name, None, "bad_archive", None, None)
                    continue
                for info in sorted(archive.infolist(), key=lambda i: i.filename):
                    if info.is_dir() or not info.filename.lower().endswith(suffix):
                        continue
                    if info.file_size > most_bytes:
                        yield row(name, info.filename, "too_large", info.file_size, None)
                        continue
                    data = archive.read(info)
                    good = suffix != ".pdf" or b"%PDF-" in data[:1024]
                    yield row(name, info.filename, "ok" if good else "not_pdf", len(data), data if good else None)

    def row(name, member, status, size, data) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member], pa.string()), pa.array([status]), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["archive", "member", "status", "bytes", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    rows = files.mapInArrow(run, "archive string, member string, status string, bytes long, content binary")
    return rows.withColumn("sha256", F.when(F.col("content").isNotNull(), F.sha2("content", 256)))


def pdf_verdict(content: Column, least_bytes: int = 1024) -> Column:
    """The first reason against a PDF's bytes, or ok: too_small, no_header (in the first KiB), no_trailer (in the last 2 KiB)."""
    size = F.octet_length(content)
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    tail = F.decode(F.substring(content, -2048, 2048), "ISO-8859-1")
    return F.when(content.isNull() | (size < least_bytes), "too_small").when(F.instr(head, "%PDF-") == 0, "no_header").when(F.instr(tail, "%%EOF") == 0, "no_trailer").otherwise("ok")


def configuration(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def prompt_template(text: str, needed: str = "{question}") -> str:
    """Template text without its # lines; needs the placeholder."""
    body = "\n".join(line for line in text.splitlines() if not line.startswith("#")).strip()
    if needed not in body:
        raise ValueError(f"template lacks {needed}")
    return body
