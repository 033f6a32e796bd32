"""Dealing one long series to many tasks.

Windows over a whole series put it into one task. Instead a series is cut into
chunks of frames; a chunk also gets copies of the rows that a row frame
reaches into its neighbours for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_of(size: int) -> Column:
    return F.floor(F.col("frame") / size)


def with_halo(df: DataFrame, size: int, preceding: int, following: int) -> DataFrame:
    """Adds ``chunk``; a row that a neighbouring chunk's windows reach is there once more for it.

    Frames are contiguous, so rows and frames count alike.
    """
    if max(preceding, following) > size:
        raise ValueError("a window may not be longer than a chunk")
    own, before, after = (F.floor((F.col("frame") + d) / size) for d in (0, -following, preceding))
    return df.withColumn("chunk", F.explode(F.array_distinct(F.array(before, own, after))))


def numbered(df: DataFrame, order: str, size: int, name: str, first: int = 1) -> DataFrame:
    """Adds ``name``: a series' rows counted from ``first`` in the order of a whole number.

    Rows are counted by stretches of the order and then numbered within each, so
    no task has a whole series; only the counts of its stretches meet.
    """
    parted = df.withColumn("__part", F.floor(F.col(order) / size))
    counts = parted.groupBy("series_id", "__part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("series_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("series_id", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("series_id", "__part").orderBy(order)) + (first - 1)
    joined = parted.withColumn("__within", within).join(starts, ["series_id", "__part"])
    return joined.withColumn(name, F.col("__start") + F.col("__within")).drop("__part", "__start", "__within")


def largest_before(df: DataFrame, order: str, value: str, size: int, name: str) -> DataFrame:
    """Adds ``name``: the largest ``value`` of a series' rows before each, null for its first; dealt like ``numbered``."""
    parted = df.withColumn("__part", F.floor(F.col(order) / size))
    tops = parted.groupBy("series_id", "__part").agg(F.max(value).alias("top"))
    earlier = Window.partitionBy("series_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("series_id", "__part", F.max("top").over(earlier).alias("__carried"))
    within = F.max(value).over(Window.partitionBy("series_id", "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = parted.withColumn("__within", within).join(carried, ["series_id", "__part"])
    return joined.withColumn(name, F.greatest("__within", "__carried")).drop("__part", "__within", "__carried")


def own_rows(df: DataFrame, size: int) -> DataFrame:
    """Without the copies."""
    return df.where(F.col("chunk") == chunk_of(size)).drop("chunk")
