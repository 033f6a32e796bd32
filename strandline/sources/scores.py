"""Score series: one row for each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.columns import clean

SCORE_SCHEMA = "Frame long, Time_Sec double, Difference_Score double"


def read_scores(spark: SparkSession, path: str, series: Column | None = None) -> DataFrame:
    """``series_id, frame, time_sec, score`` from score CSV or Parquet files.

    Each file is a series named after it, unless ``series`` says otherwise.
    """
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.schema(SCORE_SCHEMA).option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1) if series is None else series
    return as_scores(raw, name, F.col("Frame"), F.col("Time_Sec"), F.col("Difference_Score"))


def as_scores(df: DataFrame, series: Column, frame: Column, time_sec: Column, score: Column) -> DataFrame:
    """Any table as a score series; NaN scores become null."""
    return df.select(
        series.cast("string").alias("series_id"),
        frame.cast("long").alias("frame"),
        time_sec.cast("double").alias("time_sec"),
        clean(score).alias("score"),
    )


def check_contiguous(scores: DataFrame) -> DataFrame:
    """``scores``, or an error if some series' frames are not 0, 1, 2, ... each once."""
    per = scores.groupBy("series_id").agg(F.min("frame").alias("low"), F.max("frame").alias("high"), F.count("*").alias("n"))
    twice = scores.groupBy("series_id", "frame").count().where("count > 1 OR frame IS NULL").limit(1)
    bad = per.where("low <> 0 OR high + 1 <> n").limit(5).collect()
    if bad or twice.count():
        raise ValueError(f"frames must be contiguous from 0 in each series: {[r.asDict() for r in bad] or 'a frame is repeated'}")
    return scores
