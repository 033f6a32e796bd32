"""Segments: stretches of low frames with short gaps bridged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import WindowFrames
from strandline.operators.chunks import chunk_of, numbered


def below(smoothed: DataFrame, threshold: Column) -> DataFrame:
    """The frames whose smoothed score is under the threshold; null and NaN are not."""
    return smoothed.where((F.col("smoothed") < threshold) & ~F.isnan("smoothed"))


def _groups(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """``keys, start_frame, end_frame``: rows with start and end, joined while at most ``gap`` frames lie between."""
    order = Window.partitionBy(*keys).orderBy("start_frame")
    gone = F.col("start_frame") - F.lag("end_frame").over(order) - 1
    marked = rows.withColumn("breaks", F.when(gone.isNull() | (gone > gap), 1).otherwise(0))
    number = F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("island")
    return (
        marked.select("*", number)
        .groupBy(*keys, "island")
        .agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
        .drop("island")
    )


def islands(low: DataFrame, gap: int, chunk: int) -> DataFrame:
    """``series_id, start_frame, end_frame`` from the low frames (``series_id, frame``).

    Each chunk is done by itself; only a chunk's first and last island can go on
    in another chunk, so only those meet again.
    """
    rows = low.select("series_id", chunk_of(chunk).alias("chunk"), F.col("frame").alias("start_frame"), F.col("frame").alias("end_frame"))
    inside = _groups(rows, ["series_id", "chunk"], gap)
    ends = Window.partitionBy("series_id", "chunk")
    edge = (F.col("start_frame") == F.min("start_frame").over(ends)) | (F.col("end_frame") == F.max("end_frame").over(ends))
    marked = inside.withColumn("edge", edge)
    joined = _groups(marked.where("edge").select("series_id", "start_frame", "end_frame"), ["series_id"], gap)
    return marked.where("NOT edge").select("series_id", "start_frame", "end_frame").unionByName(joined)


def segments(smoothed: DataFrame, threshold: Column, frames: WindowFrames, least: bool = True) -> DataFrame:
    """``series_id, seg_index, start_frame, end_frame`` from smoothed scores.

    A segment that is open at the end of its series, by its last low frame being
    at most the gap away, ends with the series. Lengths are differences of
    frames. ``seg_index`` counts from 1 within a series.
    """
    found = islands(below(smoothed, threshold).select("series_id", "frame"), frames.merge_gap, frames.chunk)
    last = smoothed.groupBy("series_id").agg(F.max("frame").alias("last_frame"))
    open_ = F.col("last_frame") - F.col("end_frame") <= frames.merge_gap
    closed = found.join(last, "series_id").withColumn("end_frame", F.when(open_, F.col("last_frame")).otherwise(F.col("end_frame")))
    if least:
        closed = closed.where(F.col("end_frame") - F.col("start_frame") >= frames.min_length)
    return numbered(closed, "start_frame", frames.chunk, "seg_index").select("series_id", "seg_index", "start_frame", "end_frame")
