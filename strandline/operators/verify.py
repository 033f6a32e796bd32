"""Keeping the segments that look like the longest ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import middle_frame, pearson


def middle_frames(segments: DataFrame) -> DataFrame:
    """``series_id, frame``: the frames that stand for segments, each once."""
    return segments.select("series_id", middle_frame(F.col("start_frame"), F.col("end_frame")).alias("frame")).distinct()


def with_features(segments: DataFrame, features: DataFrame) -> DataFrame:
    """Adds ``hist``, that of the segment's middle frame; null where the frame has none."""
    middle = segments.withColumn("frame", middle_frame(F.col("start_frame"), F.col("end_frame")))
    return middle.join(features.select("series_id", "frame", "hist"), ["series_id", "frame"], "left").drop("frame")


def anchors(segments: DataFrame, count: int = 5) -> DataFrame:
    """The longest segments of each series; of equal ones the later."""
    order = Window.partitionBy("series_id").orderBy(F.desc(F.col("end_frame") - F.col("start_frame")), F.desc("start_frame"))
    return segments.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def mean_vector(rows: DataFrame, keys: list[str], vector: str = "hist") -> DataFrame:
    """``keys, mean``: the mean at each place of the vectors that are not null."""
    places = rows.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("at", "v"))
    means = places.groupBy(*keys, "at").agg(F.avg("v").alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "v")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda p: p["v"]).alias("mean"))


def verified(segments: DataFrame, features: DataFrame, similarity: float = 0.7, count: int = 5) -> DataFrame:
    """The segments whose feature correlates with the mean of the anchors' by ``similarity`` at least.

    A threshold of 0 or less keeps all. So does a series none of whose anchors
    has a feature; in others a segment without a feature is dropped. Adds
    ``similarity`` and keeps ``seg_index``.
    """
    if similarity <= 0:
        return segments.withColumn("similarity", F.lit(None).cast("double"))
    featured = with_features(segments, features)
    centre = mean_vector(anchors(featured, count), ["series_id"])
    # One row for each series that has a centre.
    compared = featured.join(centre, "series_id", "left").withColumn("similarity", pearson(F.col("mean"), F.col("hist")))
    kept = compared.where(F.col("mean").isNull() | (F.col("similarity") >= similarity))
    return kept.select(*segments.columns, "similarity")
