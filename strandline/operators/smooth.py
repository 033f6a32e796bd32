"""Centred rolling medians."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import WindowFrames
from strandline.operators.chunks import own_rows, with_halo

#: From this many rows on, pandas' rolling median, which updates, beats a framed percentile, which starts over.
LONG_WINDOW = 101


def rolling_median(scores: DataFrame, frames: WindowFrames) -> DataFrame:
    """Adds ``smoothed``, the median of the scores around each frame; fewer at the ends of a series.

    Null scores are skipped; where a window has none but nulls, the result is null.
    """
    halo = with_halo(scores, frames.chunk, frames.preceding, frames.following)
    if frames.smooth <= LONG_WINDOW:
        around = Window.partitionBy("series_id", "chunk").orderBy("frame").rowsBetween(-frames.preceding, frames.following)
        done = halo.withColumn("smoothed", F.percentile("score", F.lit(0.5)).over(around))
    else:
        window = frames.smooth

        def roll(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("frame")
            return rows.assign(smoothed=rows["score"].rolling(window, center=True, min_periods=1).median())

        done = halo.groupBy("series_id", "chunk").applyInPandas(roll, halo.withColumn("smoothed", F.lit(0.0)).schema)
    return own_rows(done, frames.chunk)
