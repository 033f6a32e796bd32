"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times. The mean is its source's
target rate; the draw inverts the Poisson distribution at a uniform number that
a hash of the document's id and a seed gives, so a rerun, on any cluster,
repeats the same documents as often.

Defined results: documents without a source share one source of their own. A
null text has size 1 like an empty one; of texts only the size is read, however long. Rows with the same id are drawn alike;
a null id is drawn as the empty text. Sources without a target weight, or with
weight zero, are left out. An empty table gives an empty result. Extra columns
are kept; ``copy`` and ``shuffle_key`` are added, and take the place of columns
so named.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.storage import written


@dataclass(frozen=True)
class MixingConfig:
    #: Relative weights by source; None gives each source the same weight.
    weights: Mapping[str, float] | None = None
    #: Size of the mixture as a share of the input's size.
    budget: float = 1.0
    seed: str = "mix-1"
    #: How documents are weighed, in SQL: by characters plus one, so empty ones count.
    size: str = "coalesce(length(text), 0) + 1"


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and the keys, the same in any engine with md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, config: MixingConfig = MixingConfig()) -> DataFrame:
    """``source, rate``: how often a document of each source is repeated on average.

    A source's share of the mixture's size is its share of the weights; the
    rate is that over the size it has. One row for each source.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.expr(config.size)).cast("double").alias("size"))
    if config.weights is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = [(k, float(w)) for k, w in config.weights.items()]
        targets = docs.sparkSession.createDataFrame(given, "name string, weight double")
        weighted = sizes.join(targets, sizes["source"].eqNullSafe(targets["name"])).drop("name")
    # One row for each source, which partial sums have made: few rows even where documents are many.
    every = weighted.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))
    rate = F.col("weight") / F.col("weights") * F.col("sizes") * config.budget / F.col("size")
    return weighted.crossJoin(every).select("source", rate.alias("rate"))


def _distribution(rate: float) -> tuple[int, np.ndarray]:
    """A first number of repeats and the chances of at most that many, one more, ...

    What is left out on either side is less likely than the smallest step of ``uniform``.
    """
    if not rate > 0:
        return 0, np.ones(1)
    reach = 12 * math.sqrt(rate) + 40
    k = np.arange(max(0, math.floor(rate - reach)), math.ceil(rate + reach) + 1)
    # In logs, as exp(-rate) may be too small for a number.
    return int(k[0]), np.cumsum(np.exp(-rate + k * math.log(rate) - np.array([math.lgamma(i + 1) for i in k.tolist()])))


def with_distribution(rates_of: DataFrame) -> DataFrame:
    """Adds ``first`` and ``cdf``: the chance of at most ``first``, ``first + 1``, ... repeats."""

    def udf(rates: pa.Array) -> pa.Array:
        found = [_distribution(r) for r in rates.to_pylist()]
        return pa.array([{"first": f, "cdf": c.tolist()} for f, c in found], pa.struct([("first", pa.int32()), ("cdf", pa.list_(pa.float64()))]))

    found = F.arrow_udf(udf, "first int, cdf array<double>")(F.col("rate"))
    return rates_of.select("source", "rate", found.alias("found")).select("source", "rate", "found.*")


def replicate(docs: DataFrame, config: MixingConfig = MixingConfig()) -> DataFrame:
    """Each row of ``docs`` as often as its draw says, with ``copy`` from 0 and ``shuffle_key``."""
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    table = written(with_distribution(rates(docs, config).where("rate > 0")).select(F.struct("*").alias("of_source")))
    docs = docs.select(F.struct(*columns).alias("doc"))
    # One row for each source, of a size Spark knows now: it goes to all tasks if that is under Spark's
    # broadcast threshold; else both sides are dealt by source and a hot one is split.
    joined = docs.join(table, F.col("doc.source").eqNullSafe(F.col("of_source.source")))
    draw = uniform(config.seed, F.col("doc.doc_id"))
    times = F.col("of_source.first") + F.size(F.filter("of_source.cdf", lambda c: c <= draw))
    copies = joined.withColumn("times", times).where("times > 0").select("doc", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(config.seed), F.lit("order"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")), F.col("copy")).cast("binary"))
    return copies.select("doc.*", "copy", key.alias("shuffle_key"))


def mix(docs: DataFrame, config: MixingConfig = MixingConfig()) -> DataFrame:
    """The replicated documents in a random order that the seed fixes: by ``shuffle_key``, dealt out by ranges of it."""
    copies = replicate(docs, config)
    # The key is uniform, so even ranges are known beforehand and nothing need be sampled.
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / float(1 << 32) * partitions).cast("int")
    return copies.repartitionById(partitions, place).sortWithinPartitions("shuffle_key")


def realised_weights(mixed: DataFrame, config: MixingConfig = MixingConfig()) -> DataFrame:
    """``source, share``: what part of the mixture's size each source has."""
    sizes = mixed.groupBy("source").agg(F.sum(F.expr(config.size)).alias("size"))
    return sizes.select("source", (F.col("size") / F.sum("size").over(Window.partitionBy())).alias("share"))
