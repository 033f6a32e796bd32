"""Decoded frames and video metadata.

Decoding is not Spark's work: a decoder is passed in and runs in tasks, a file
at a time, yielding frames as they come, or a reader that gives a frame by its
number. Uncompressed video needs neither (``sources.y4m``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.colour import gray
from strandline.functions.columns import fps_or_default

FRAME_SCHEMA = "series_id string, frame long, width int, height int, gray binary"
METADATA_SCHEMA = "series_id string, fps double, frame_count long, width int, height int"

#: From a path to (width, height, gray bytes) for each frame.
Decoder = Callable[[str], Iterable[tuple[int, int, bytes]]]
#: From a path to (fps, frame count, width, height).
Prober = Callable[[str], tuple[float, int, int, int]]


def video_paths(spark: SparkSession, glob: str) -> DataFrame:
    """``path, series_id`` of files that match, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(glob).select("path")
    return files.withColumn("series_id", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))


def read_frames(paths: DataFrame, decode: Decoder, batch: int = 64) -> DataFrame:
    """Every frame of every file, numbered from 0; a batch of frames is held at once."""

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["series_id", "frame", "width", "height", "gray"]
        for part in parts:
            for path, series in zip(part["path"], part["series_id"], strict=True):
                rows = []
                for number, (width, height, gray) in enumerate(decode(path)):
                    rows.append((series, number, width, height, gray))
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return paths.select("path", "series_id").mapInPandas(frames, FRAME_SCHEMA)


#: From a path and the number of a frame to (width, height, blue-green-red bytes), or None where it can't be read.
Reader = Callable[[str, int], tuple[int, int, bytes] | None]
COLOUR_SCHEMA = "series_id string, frame long, width int, height int, bgr binary"


def read_colour(paths: DataFrame, wanted: DataFrame, read: Reader, batch: int = 16) -> DataFrame:
    """The frames that ``wanted`` (``series_id, frame``) names, in colour; ``bgr`` is null where one can't be read.

    Only these are read, each by its number and those of a task in order; a batch of them is held at once.
    """

    def frames(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, batch):
                own = part.slice(at, batch)
                found = [read(p, n) or (None, None, None) for p, n in zip(own.column("path").to_pylist(), own.column("frame").to_pylist(), strict=True)]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([own.column("series_id"), own.column("frame"), *columns], ["series_id", "frame", "width", "height", "bgr"])

    named = wanted.select("series_id", "frame").distinct().join(paths.select("series_id", "path"), "series_id")
    # Frames are few and large: dealt out by stretches, so that a task reads neighbours.
    dealt = named.withColumn("stretch", F.floor(F.col("frame") / 4096)).repartition("series_id", "stretch").sortWithinPartitions("series_id", "frame")
    return dealt.select("series_id", "frame", "path").mapInArrow(frames, COLOUR_SCHEMA)


def gray_frames(frames: DataFrame) -> DataFrame:
    """Frames with ``bgr`` bytes as frames with ``gray`` bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grays = pa.array([None if f is None else gray(f) for f in batch.column("bgr").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("series_id", "frame", "width", "height")), grays], ["series_id", "frame", "width", "height", "gray"])

    return frames.select("series_id", "frame", "width", "height", "bgr").mapInArrow(rows, FRAME_SCHEMA)


def read_metadata(paths: DataFrame, probe: Prober) -> DataFrame:
    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(s, *probe(p)) for p, s in zip(part["path"], part["series_id"], strict=True)]
            yield pd.DataFrame(found, columns=["series_id", "fps", "frame_count", "width", "height"])

    return paths.select("path", "series_id").mapInPandas(rows, METADATA_SCHEMA)


def pick_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The frames that ``wanted`` (``series_id, frame``) names."""
    return frames.join(wanted.select("series_id", "frame").distinct(), ["series_id", "frame"], "left_semi")


def durations(metadata: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``series_id, fps, duration_sec``: frame count over rate; without a count, the last time of the scores, else 0."""
    fps = fps_or_default(F.col("fps"))
    known = metadata.select("series_id", fps.alias("fps"), F.coalesce(F.try_divide(F.col("frame_count"), fps), F.lit(0.0)).alias("duration_sec"))
    if scores is None:
        return known
    last = scores.groupBy("series_id").agg(F.max_by("time_sec", "frame").alias("last_sec"))
    chosen = F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(F.coalesce("last_sec", F.lit(0.0)))
    return known.join(last, "series_id", "left").select("series_id", "fps", chosen.alias("duration_sec"))
