"""Tables of a run's rounds: written to the folder that driver and executors share, so plans stay short and lost executors repeat one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where the session names none and runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Rounds:
    """keep() writes a table of a round, finish() the results; the rounds' own tables go then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, part: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{part}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df, "steps")

    def finish(self, *results: DataFrame) -> tuple[DataFrame, ...]:
        out = tuple(self.write(df, "results") for df in results)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/steps")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return out
