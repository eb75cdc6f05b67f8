"""Session plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A local folder is set up only where the session names none and runs in one JVM, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    folder = tempfile.mkdtemp(prefix="quillstone-")
    context.setCheckpointDir(folder)
    return f"file://{folder}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillstone/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the table that cut_table() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file in a file system of the cluster."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def cut_table(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is forgotten, columns stay prunable and its size is known to the planner."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run of an operator, in a folder of their own that goes when the run's result is written.

    with Scratch(spark, "op") as s: ... return cut_table(result, "result")
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, label), 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove_path(self.spark, self.root)
