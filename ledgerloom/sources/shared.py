"""The folder that all executors share, for streams' checkpoints and what they write."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder; a local session without one gets its own."""
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir"):
        return base
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Stages:
    """Tables that several later steps read, written once to the shared folder: what follows starts from
    a scan of them, with a short plan, and a lost executor costs a task and not the steps before. They go
    when the session ends, or by drop()."""

    def __init__(self, spark: SparkSession, on_table: Callable[[str, int], None] | None = None):
        """on_table(name, rows) is called as each table is written; the rows are observed as they pass."""
        self.spark, self.on_table = spark, on_table
        self.base = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
        self._files, path = self._folder()
        self._files.mkdirs(path)
        self._files.deleteOnExit(path)

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        passed = Observation(f"stage {name}") if self.on_table else None
        (df if passed is None else df.observe(passed, F.count(F.lit(1)).alias("rows"))).write.parquet(f"{self.base}/{name}")
        if passed is not None:
            self.on_table(name, passed.get["rows"])
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str = "") -> None:
        files, path = self._folder(name)
        files.delete(path, True)
