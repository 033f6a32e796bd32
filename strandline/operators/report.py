"""Tables about segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import clock_label, percent, seconds
from strandline.operators.chunks import numbered


def renumbered(segments: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``seg_index`` from 1 again, after some were dropped."""
    return numbered(segments.drop("seg_index"), "start_frame", chunk, "seg_index").select(segments.columns)


def segment_rows(segments: DataFrame, fps: DataFrame) -> DataFrame:
    """The rows of a segment table: frames, seconds to 4 digits, and labels. ``fps`` has a row for each series."""
    joined = segments.join(fps.select("series_id", "fps"), "series_id")
    start, end = seconds(F.col("start_frame"), F.col("fps")), seconds(F.col("end_frame"), F.col("fps"))
    return joined.select(
        "series_id",
        F.col("seg_index").alias("index"),
        "start_frame",
        "end_frame",
        F.round(start, 4).alias("start_sec"),
        F.round(end, 4).alias("end_sec"),
        F.round(seconds(F.col("end_frame") - F.col("start_frame"), F.col("fps")), 4).alias("duration_sec"),
        clock_label(start).alias("start_label"),
        clock_label(end).alias("end_label"),
    )


def coverage(segments: DataFrame, scores: DataFrame, fps: DataFrame) -> DataFrame:
    """``segments, frames, inclusive_frames, seconds, percent`` for each series, zeros where it has none."""
    totals = scores.groupBy("series_id").agg(F.count("*").alias("total"))
    length = F.col("end_frame") - F.col("start_frame")
    sums = segments.groupBy("series_id").agg(F.count("*").alias("segments"), F.sum(length).alias("frames"), F.sum(length + 1).alias("inclusive_frames"))
    joined = totals.join(sums, "series_id", "left").join(fps.select("series_id", "fps"), "series_id")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("segments", "frames", "inclusive_frames")}
    frames = F.coalesce("frames", F.lit(0))
    return joined.select("series_id", *zero.values(), seconds(frames, F.col("fps")).alias("seconds"), percent(frames, F.col("total")).alias("percent"))
