"""Frame rates from frame times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.chunks import chunk_of
from strandline.operators.quantile import exact_quantiles


def time_steps(scores: DataFrame, chunk: int = 1 << 18) -> DataFrame:
    """``series_id, step``: the positive differences between one positive time and the next.

    A chunk's first time needs the last time of a chunk before it, which is
    looked up among one row for each chunk.
    """
    timed = scores.where("time_sec > 0").select("series_id", "frame", "time_sec", chunk_of(chunk).alias("chunk"))
    order = Window.partitionBy("series_id", "chunk").orderBy("frame")
    inside = timed.select("series_id", (F.col("time_sec") - F.lag("time_sec").over(order)).alias("step"))
    ends = timed.groupBy("series_id", "chunk").agg(F.min_by("time_sec", "frame").alias("first"), F.max_by("time_sec", "frame").alias("last"))
    before = F.lag("last").over(Window.partitionBy("series_id").orderBy("chunk"))
    between = ends.select("series_id", (F.col("first") - before).alias("step"))
    return inside.unionByName(between).where("step > 0")


def estimate_fps(scores: DataFrame, default: float = 30.0, chunk: int = 1 << 18) -> DataFrame:
    """``series_id, fps``: one over the median step, exactly; the default where there is no step."""
    steps = time_steps(scores, chunk).withColumnRenamed("step", "x")
    median = exact_quantiles(steps, [0.5]).select("series_id", F.col("q")[0].alias("step"))
    every = scores.select("series_id").distinct()
    return every.join(median, "series_id", "left").select("series_id", F.coalesce(1 / F.col("step"), F.lit(default)).alias("fps"))
