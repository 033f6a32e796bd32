"""Exact quantiles of many series at once, in memory that the longest series' root bounds.

A sketch of each series, merged from tasks, gives two values that surely lie
around a quantile, at ranks not far apart. Only values between them are counted
and ranked. With an accuracy of a, a sketch has about a entries and 4 n / a of n
values lie between; neither has to be whole in one place otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(values: DataFrame, fractions: Sequence[float], accuracy: int = 100_000) -> DataFrame:
    """``series_id, n, q``: for each series of ``series_id, x`` its quantiles, interpolated between ranks as ``percentile`` does.

    Null values have no part, NaN is greater than all numbers; a series without
    values has no row.
    """
    # The sketch's ranks are off by n / accuracy at most, and by one for each rounding. Bounds at twice that are surely
    # past; short series need wider ones.
    apart = [2.0 / accuracy * 4**k for k in range(40) if 2.0 / accuracy * 4**k < 1]
    bounds = [[max(0.0, p - d) for d in apart] + [min(1.0, p + d) for d in apart] for p in fractions]
    sketch = F.percentile_approx("x", F.array(*[F.lit(b) for own in bounds for b in own]), F.lit(accuracy))
    known = values.where("x IS NOT NULL")
    around = known.groupBy("series_id").agg(F.count("x").alias("n"), sketch.alias("b"))

    def wanted(k: int, p: float):
        place = (F.col("n") - 1) * F.lit(float(p))
        low = high = F.lit(None).cast("double")
        for i, d in reversed(list(enumerate(apart))):
            enough = F.lit(d) * F.col("n") >= F.col("n") / accuracy + 3
            at = 2 * len(apart) * k + i
            low = F.when(enough, F.col("b")[at] if p > d else F.lit(None)).otherwise(low)
            high = F.when(enough, F.col("b")[at + len(apart)] if p + d < 1 else F.lit(None)).otherwise(high)
        return F.struct(F.lit(k).alias("k"), place.alias("place"), low.alias("low"), high.alias("high"))

    targets = around.select("series_id", "n", F.explode(F.array(*[wanted(k, p) for k, p in enumerate(fractions)])).alias("t")).select("series_id", "n", "t.*")
    # Values below are one row a task and target, those between a row for each different one.
    joined = known.join(targets, "series_id").where("high IS NULL OR x <= high")
    between = F.col("low").isNull() | (F.col("x") >= F.col("low"))
    counts = joined.groupBy("series_id", "k", "n", "place", F.when(between, F.col("x")).alias("x")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy("series_id", "k").orderBy(F.col("x").asc_nulls_first())
    ranked = counts.withColumn("upto", F.sum("c").over(upto.rowsBetween(Window.unboundedPreceding, 0))).where("x IS NOT NULL")

    def at(rank):
        return F.min(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("x")))

    ends = ranked.groupBy("series_id", "k", "n", "place").agg(at(F.floor("place")).alias("a"), at(F.ceil("place")).alias("b"))
    lost = F.raise_error(F.lit("a sketch was off by more than it may be"))
    a, b, place = F.col("a"), F.col("b"), F.col("place")
    value = F.when(a.isNull() | b.isNull(), lost).when((F.floor(place) == F.ceil(place)) | (a == b), a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b)
    quantiles = F.transform(F.sort_array(F.collect_list(F.struct("k", value.alias("v")))), lambda t: t["v"])
    return ends.groupBy("series_id").agg(F.first("n").alias("n"), quantiles.alias("q"))
