"""Difference scores of neighbouring frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.chunks import own_rows, with_halo


def l1_distance(a: Column, b: Column) -> Column:
    """The sum of absolute differences of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, d: acc + d)


def array_differences(rows: DataFrame, values: str = "values", chunk: int = 1 << 12) -> DataFrame:
    """Adds ``score``: how much each frame's array differs from the one before; 0 for the first."""
    halo = with_halo(rows, chunk, 1, 0)
    before = F.lag(values).over(Window.partitionBy("series_id", "chunk").orderBy("frame"))
    score = F.when(before.isNull(), 0.0).otherwise(l1_distance(F.col(values), before))
    return own_rows(halo.withColumn("score", score), chunk)


def frame_scores(frames: DataFrame, metadata: DataFrame, chunk: int = 512) -> DataFrame:
    """A score series from gray frames: whole-number sums of absolute differences, times rounded to 3 digits.

    The frame before is paired by a window; the bytes are compared in batches.
    """
    halo = with_halo(frames, chunk, 1, 0)
    before = F.lag("gray").over(Window.partitionBy("series_id", "chunk").orderBy("frame"))
    pairs = own_rows(halo.withColumn("before", before), chunk).select("series_id", "frame", "gray", "before")

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sums = [
                0 if b is None else int(np.abs(np.frombuffer(a, np.uint8).astype(np.int16) - np.frombuffer(b, np.uint8)).sum(dtype=np.int64))
                for a, b in zip(part["gray"], part["before"], strict=True)
            ]
            yield pd.DataFrame({"series_id": part["series_id"], "frame": part["frame"], "score": sums})

    scored = pairs.mapInPandas(score, "series_id string, frame long, score double")
    time = F.round(F.try_divide(F.col("frame").cast("double"), F.col("fps")), 3).alias("time_sec")
    return scored.join(metadata.select("series_id", "fps"), "series_id").select("series_id", "frame", time, "score")


def top_scores(scores: DataFrame, count: int = 10) -> DataFrame:
    """The frames with the largest scores; of equal ones the first."""
    return scores.orderBy(F.desc_nulls_last("score"), "series_id", "frame").limit(count)
