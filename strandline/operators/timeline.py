"""Looking up and drawing segments on a time line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import block_colour, block_left, block_width, two_digits
from strandline.operators.chunks import largest_before


def first_covers(rows: DataFrame) -> DataFrame:
    """``series_id, index, at, late, end``: when each segment is the first that holds a time, from ``at`` (not itself if ``late``) to ``end``.

    Segments are numbered by their starts, so one is the first from its start,
    or from where the last of those before it has ended. These stretches don't overlap.
    """
    reached = largest_before(rows.select("series_id", "index", "start_sec", "end_sec"), "index", "end_sec", 1 << 16, "before")
    late = F.coalesce(F.col("before") >= F.col("start_sec"), F.lit(False))
    open_ = reached.where("before IS NULL OR end_sec > before")
    return open_.select("series_id", "index", F.greatest("start_sec", "before").alias("at"), late.alias("late"), F.col("end_sec").alias("end"))


def active_segment(points: DataFrame, rows: DataFrame, bucket_sec: float = 600.0) -> DataFrame:
    """Adds ``active``: the first segment of the series that holds ``at_sec``, both ends included; null if none does.

    A sweep: points and the starts of segments meet once, by stretches of time,
    and each point takes the last start before it. What is open at the start of
    a stretch comes from the stretches before, of which there is a row each. A
    segment is there once, however long.
    """
    columns = points.columns
    covers = first_covers(rows)
    # At one time: segments that begin then, points, segments that begin just after.
    point = points.select(F.struct("*").alias("__p"), "series_id", F.col("at_sec").cast("double").alias("__at"), F.lit(1).alias("__rank"), F.lit(None).cast("struct<index: long, end: double>").alias("__open"))
    opened = F.struct(F.col("index").cast("long").alias("index"), F.col("end").cast("double").alias("end"))
    begun = covers.select(F.lit(None).cast(point.schema["__p"].dataType).alias("__p"), "series_id", F.col("at").cast("double").alias("__at"), F.when(F.col("late"), 2).otherwise(0).alias("__rank"), opened.alias("__open"))
    events = point.union(begun).withColumn("__bucket", F.floor(F.col("__at") / bucket_sec))
    order = Window.partitionBy("series_id", "__bucket").orderBy("__at", "__rank").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("__last", F.last("__open", ignorenulls=True).over(order)).where("__p IS NOT NULL")
    ends = begun.withColumn("__bucket", F.floor(F.col("__at") / bucket_sec)).groupBy("series_id", "__bucket").agg(F.max_by("__open", F.struct("__at", "__rank")).alias("__open"))
    carried = _carried(ends, points, bucket_sec)
    at = F.col("__p.at_sec")
    found = F.coalesce("__last", "__before")
    done = swept.join(carried, ["series_id", "__bucket"], "left").withColumn("active", F.when(at <= found["end"], found["index"]))
    return done.select(*[F.col("__p")[c].alias(c) for c in columns], "active")


def _carried(ends: DataFrame, points: DataFrame, bucket_sec: float) -> DataFrame:
    """``series_id, __bucket, __before``: the last start before each stretch that has points."""
    wanted = points.select("series_id", F.floor(F.col("at_sec").cast("double") / bucket_sec).alias("__bucket")).distinct()
    every = wanted.withColumn("__open", F.lit(None).cast(ends.schema["__open"].dataType)).union(ends.select("series_id", "__bucket", "__open"))
    merged = every.groupBy("series_id", "__bucket").agg(F.any_value("__open", F.lit(True)).alias("__open"))
    earlier = Window.partitionBy("series_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return merged.select("series_id", "__bucket", F.last("__open", ignorenulls=True).over(earlier).alias("__before"))


def blocks(rows: DataFrame, total_sec: Column) -> DataFrame:
    """How each segment is drawn: left edge and width in percent, colour number, title."""
    return rows.select(
        "series_id",
        "index",
        block_left(F.col("start_sec"), total_sec).alias("left_pct"),
        block_width(F.col("duration_sec"), total_sec).alias("width_pct"),
        block_colour(F.col("index")).alias("colour"),
        F.format_string("#%d %s - %s (%ss)", "index", "start_label", "end_label", two_digits(F.col("duration_sec"))).alias("title"),
    )
