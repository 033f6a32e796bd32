"""From scores to verified segments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import SegmentConfig, WindowFrames
from strandline.operators import fps as rates
from strandline.operators import islands, mixture, report, smooth, verify
from strandline.operators.chunks import numbered
from strandline.storage import Workspace


def dense_frames(df: DataFrame, series: Column, order: Column, chunk: int = 1 << 18) -> DataFrame:
    """Adds ``series_id`` and ``frame``, which counts a series' rows from 0 in the order of a whole number."""
    keyed = df.withColumns({"series_id": series.cast("string"), "__order": order.cast("long")})
    return numbered(keyed, "__order", chunk, "frame", first=0).drop("__order")


def thresholds(scores: DataFrame, config: SegmentConfig) -> DataFrame:
    """``series_id, threshold``: the manual one, or each series' own; an error where a series has none."""
    if config.manual_threshold is not None:
        return scores.select("series_id").distinct().withColumn("threshold", F.lit(float(config.manual_threshold)))
    logs = mixture.log_scores(scores)
    found = mixture.threshold(mixture.fit(logs), config.boundary)
    said = F.concat(F.lit("no threshold between the two kinds of frames in series "), "series_id")
    return found.select("series_id", F.when(F.col("threshold").isNull(), F.raise_error(said)).otherwise(F.col("threshold")).alias("threshold"))


def segments_with(scores: DataFrame, threshold: DataFrame | float, frames: WindowFrames) -> DataFrame:
    """Segments under a threshold for all series, or one for each in ``series_id, threshold``."""
    smoothed = smooth.rolling_median(scores, frames)
    if isinstance(threshold, DataFrame):
        smoothed = smoothed.join(threshold, "series_id")
        return islands.segments(smoothed, F.col("threshold"), frames)
    return islands.segments(smoothed, F.lit(float(threshold)), frames)


@dataclass(frozen=True)
class Segmentation:
    fps: DataFrame
    thresholds: DataFrame
    segments: DataFrame
    rows: DataFrame
    coverage: DataFrame


#: From the frames that are wanted (``series_id, frame``) to their features (``series_id, frame, hist``).
Features = Callable[[DataFrame], DataFrame]


def segment(scores: DataFrame, config: SegmentConfig = SegmentConfig(), features: DataFrame | Features | None = None, container_fps: DataFrame | None = None) -> Segmentation:
    """Everything from ``series_id, frame, time_sec, score``.

    Windows are whole numbers of frames, which each rate makes anew: series of
    one set of windows are done together; the driver holds the sets, of which
    there are as many as whole rates. Segment rows use the rate of the
    container where given; the windows that of the times. Features, where they
    are made on demand, are made of the middle frames of segments only.
    """
    spark = scores.sparkSession
    with Workspace(spark) as work:
        fps = work.result(rates.estimate_fps(scores, chunk=config.chunk_frames))
        limits = work.result(thresholds(scores, config))
        windows = work.keep(fps.select("series_id", *config.frame_columns(F.col("fps"))))
        found = None
        for row in windows.select("smooth", "merge_gap", "min_length").distinct().collect():
            own = windows.where(" AND ".join(f"{k} = {v}" for k, v in row.asDict().items())).select("series_id")
            part = segments_with(scores.join(own, "series_id", "left_semi"), limits, WindowFrames(**row.asDict(), chunk=config.chunk_frames))
            found = part if found is None else found.unionByName(part)
        if found is None:
            raise ValueError("there are no scores")
        found = work.keep(found)
        if features is not None and config.similarity > 0:
            if callable(features):
                features = work.keep(features(verify.middle_frames(found)).select("series_id", "frame", "hist"))
            found = verify.verified(found, features, config.similarity, config.anchors).drop("similarity")
        found = work.result(report.renumbered(found))
    rate = container_fps if container_fps is not None else fps
    return Segmentation(fps, limits, found, report.segment_rows(found, rate), report.coverage(found, scores, fps))


def with_manual(config: SegmentConfig, threshold: float) -> SegmentConfig:
    return replace(config, manual_threshold=threshold)
