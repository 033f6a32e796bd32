"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local session without that setting gets a temporary one, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_FOLDER:
            _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="strandline-"))
        base = _LOCAL_FOLDER[0]
    return f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"


class Workspace:
    """Tables written on the way to a result; all but those that are taken out go when it closes.

    >>> with Workspace(spark) as work:
    ...     params = work.keep(params)      # written once, read from there on
    ...     result = work.result(params)    # stays
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for path in self._paths:
            remove(self.spark, path)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        self._paths.append(shared_folder(self.spark))
        return self._written(df, self._paths[-1])

    def keep_and_count(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """Also how many rows ``condition`` holds for, counted as they are written."""
        seen = Observation()
        kept = self.keep(df.observe(seen, F.count_if(condition).alias("n")))
        return kept, seen.get["n"]

    def result(self, df: DataFrame) -> DataFrame:
        """Written too, but left when the others go: a result may be read at any time."""
        return self._written(df, shared_folder(self.spark))


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
