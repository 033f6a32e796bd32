"""Colour features of frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.colour import hue_saturation

HUE_BINS, SATURATION_BINS = 30, 32
HUE_RANGE, SATURATION_RANGE = 180, 256


def histogram_bins(pixels: DataFrame, keys: list[str], hue_bins: int = HUE_BINS, saturation_bins: int = SATURATION_BINS) -> DataFrame:
    """``keys, bin, n`` from pixels with ``hue`` in [0, 180) and ``saturation`` in [0, 256); others are left out."""
    inside = pixels.where(f"hue >= 0 AND hue < {HUE_RANGE} AND saturation >= 0 AND saturation < {SATURATION_RANGE}")
    hue = F.floor(F.col("hue") * hue_bins / HUE_RANGE)
    place = (hue * saturation_bins + F.floor(F.col("saturation") * saturation_bins / SATURATION_RANGE)).cast("int")
    return inside.select(*keys, place.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def colour_histograms(pixels: DataFrame, keys: list[str], hue_bins: int = HUE_BINS, saturation_bins: int = SATURATION_BINS) -> DataFrame:
    """``keys, hist``: a dense histogram of unit length for each key."""
    bins = histogram_bins(pixels, keys, hue_bins, saturation_bins)
    packed = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    every = F.sequence(F.lit(0), F.lit(hue_bins * saturation_bins - 1))
    hist = F.transform(every, lambda b: (F.coalesce(F.try_element_at("m", b), F.lit(0)) / F.col("length")).cast("float"))
    return packed.select(*keys, hist.alias("hist"))


def _counts(bgr: bytes, hue_bins: int, saturation_bins: int) -> np.ndarray:
    hue, saturation = hue_saturation(bgr)
    inside = hue < HUE_RANGE
    place = hue[inside] * hue_bins // HUE_RANGE * saturation_bins + saturation[inside] * saturation_bins // SATURATION_RANGE
    return np.bincount(place, minlength=hue_bins * saturation_bins)


def frame_histograms(frames: DataFrame, hue_bins: int = HUE_BINS, saturation_bins: int = SATURATION_BINS) -> DataFrame:
    """``series_id, frame, hist`` from frames with ``bgr`` bytes: histograms of unit length, counted a frame at a time.

    A frame that is null, as it couldn't be read, has a null histogram; one without pixels has zeros.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for frame in batch.column("bgr"):
                counts = None if not frame.is_valid else _counts(frame.as_py(), hue_bins, saturation_bins)
                # Whole numbers under the root, so any order of pixels gives the same.
                found.append(None if counts is None else (counts / max(1.0, float(counts @ counts) ** 0.5)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), batch.column("frame"), pa.array(found, pa.list_(pa.float32()))], ["series_id", "frame", "hist"])

    return frames.select("series_id", "frame", "bgr").mapInArrow(rows, "series_id string, frame long, hist array<float>")
