"""Reading tables and cutting lineage through the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: list[str] = []
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a
    temporary folder; a cluster without it is an error, as executors could not
    see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_FOLDER:
            _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="strandline-"))
        base = _LOCAL_FOLDER[0]
    return f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What follows no longer depends on the executors that made the rows, and
    the work above is done once however often the result is used.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote for these, once nothing that isn't written itself needs them; else does nothing.

    The driver's JVM collects its garbage too: only then does Spark drop the
    shuffle files of plans that are done with.
    """
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path:
            spark = df.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    if tables:
        release(tables[0])


def release(table: DataFrame) -> None:
    """Lets Spark drop the shuffle files of plans that are done with, as ``discard`` does."""
    table.sparkSession._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``written``, and what the driver kept for the plan goes at once.

    Its memory then follows the largest of many steps, not what they leave
    behind between them.
    """
    out = written(df)
    release(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
