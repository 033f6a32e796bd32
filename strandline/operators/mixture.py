"""A threshold between two kinds of frames: a mixture of two normals over log scores.

Each step of expectation-maximisation is one aggregation, for all series at
once. Parameters are a table, written after each step; series that have settled
are in no later step. The driver learns only whether any is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import from_log, log_score
from strandline.operators.quantile import exact_quantiles
from strandline.storage import Workspace

REGULAR = 1e-6


def log_scores(scores: DataFrame) -> DataFrame:
    """``series_id, x``; null scores have no part."""
    return scores.where("score IS NOT NULL").select("series_id", log_score(F.col("score")).alias("x"))


def quartile_start(logs: DataFrame) -> DataFrame:
    """Means at the quartiles, a quarter of the overall variance and equal weights."""
    start = exact_quantiles(logs, [0.25, 0.75]).join(logs.groupBy("series_id").agg(F.var_pop("x").alias("v")), "series_id")
    v = F.col("v") / 4 + REGULAR
    return start.select("series_id", F.col("q")[0].alias("m1"), F.col("q")[1].alias("m2"), v.alias("v1"), v.alias("v2"), F.lit(0.5).alias("w1"), F.lit(0.5).alias("w2"))


def two_means_start(logs: DataFrame, rounds: int = 10) -> DataFrame:
    """The moments of two clusters around centres that begin at the least and the largest value, and move until they stay or ``rounds`` are over."""
    with Workspace(logs.sparkSession) as work:
        centres = logs.groupBy("series_id").agg(F.min("x").alias("c1"), F.max("x").alias("c2"))
        done, moments = None, None
        for _ in range(rounds + 1):
            found = _clusters(logs, centres if moments is None else centres.where("NOT settled"))
            found = found.withColumn("settled", (F.col("m1") == F.col("c1")) & (F.col("m2") == F.col("c2"))).drop("c1", "c2")
            moments, left = work.keep_and_count(found if done is None else found.union(done), ~F.col("settled"))
            if not left:
                break
            done = moments.where("settled")
            centres = moments.select("series_id", F.col("m1").alias("c1"), F.col("m2").alias("c2"), "settled")
        return work.result(moments.drop("settled"))


def _clusters(logs: DataFrame, centres: DataFrame) -> DataFrame:
    first = F.abs(F.col("x") - F.col("c1")) <= F.abs(F.col("x") - F.col("c2"))
    x1, x2 = F.when(first, F.col("x")), F.when(~first, F.col("x"))
    sums = logs.join(centres, "series_id").groupBy("series_id")
    done = sums.agg(F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2"), F.count(x1).alias("n1"), F.count("x").alias("n"), F.any_value("c1").alias("c1"), F.any_value("c2").alias("c2"))
    weight = F.col("n1") / F.col("n")
    m2, v2 = F.coalesce("m2", "m1"), F.coalesce("v2", "v1")
    return done.select("series_id", "m1", m2.alias("m2"), (F.col("v1") + REGULAR).alias("v1"), (v2 + REGULAR).alias("v2"), weight.alias("w1"), (1 - weight).alias("w2"), "c1", "c2")


def _density(m: str, v: str, w: str) -> Column:
    x, m, v, w = (F.col(c) for c in ("x", m, v, w))
    return w / F.sqrt(2 * math.pi * v) * F.exp(-(x - m) * (x - m) / (2 * v))


def em_step(logs: DataFrame, params: DataFrame) -> DataFrame:
    """The next parameters, and ``mean_log_likelihood`` under the present ones; a component without any share stays where it is."""
    joined = logs.join(params, "series_id")
    p1, p2 = _density("m1", "v1", "w1"), _density("m2", "v2", "w2")
    shares = joined.select("series_id", "x", "m1", "m2", "v1", "v2", p1.alias("p1"), (p1 + p2).alias("p")).withColumn("g", F.try_divide("p1", "p"))
    g, h, x = F.col("g"), 1 - F.col("g"), F.col("x")
    sums = shares.groupBy("series_id").agg(
        F.sum(g).alias("g0"),
        F.sum(g * x).alias("g1"),
        F.sum(g * x * x).alias("g2"),
        F.sum(h).alias("h0"),
        F.sum(h * x).alias("h1"),
        F.sum(h * x * x).alias("h2"),
        F.count("x").alias("n"),
        F.avg(F.ln("p")).alias("mean_log_likelihood"),
        *[F.any_value(c).alias(c) for c in ("m1", "m2", "v1", "v2")],
    )
    m1, m2 = F.coalesce(F.try_divide("g1", "g0"), "m1"), F.coalesce(F.try_divide("h1", "h0"), "m2")
    return sums.select(
        "series_id",
        m1.alias("m1"),
        m2.alias("m2"),
        F.coalesce(F.try_divide("g2", "g0") - m1 * m1 + REGULAR, "v1").alias("v1"),
        F.coalesce(F.try_divide("h2", "h0") - m2 * m2 + REGULAR, "v2").alias("v2"),
        (F.col("g0") / F.col("n")).alias("w1"),
        (F.col("h0") / F.col("n")).alias("w2"),
        "mean_log_likelihood",
    )


def fit_steps(logs: DataFrame, steps: int) -> DataFrame:
    """Parameters after a fixed number of steps from the quartile start."""
    params = quartile_start(logs)
    for _ in range(steps):
        params = em_step(logs, params).drop("mean_log_likelihood")
    return params


def fit(logs: DataFrame, tolerance: float = 1e-3, most_steps: int = 100) -> DataFrame:
    """Parameters of each series where its mean log likelihood changes by less than ``tolerance``; starts from two means.

    A step reads the values of series that haven't settled, and writes a row a series.
    """
    columns = ["series_id", "m1", "m2", "v1", "v2", "w1", "w2"]
    with Workspace(logs.sparkSession) as work:
        values = work.keep(logs)
        none = F.lit(None).cast("double").alias("likelihood")
        params = work.keep(two_means_start(values).select(*columns, none, F.lit(False).alias("settled")))
        for _ in range(most_steps):
            going = params.where("NOT settled")
            stepped = em_step(values, going.select(*columns)).join(going.select("series_id", "likelihood"), "series_id")
            now, before = F.col("mean_log_likelihood"), F.col("likelihood")
            settled = F.coalesce(F.abs(now - before) < tolerance, F.lit(False))
            stepped = stepped.select(*columns, now.alias("likelihood"), settled.alias("settled"))
            params, left = work.keep_and_count(stepped.union(params.where("settled")), ~F.col("settled"))
            if not left:
                break
        return work.result(params.select(*columns))


def fit_ml(logs: DataFrame, tolerance: float = 1e-3, most_steps: int = 100, seed: int = 0) -> DataFrame:
    """The same by Spark ML's GaussianMixture, for one series."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    name = logs.select("series_id").distinct().limit(2).collect()
    if len(name) != 1:
        raise ValueError("one series at a time")
    points = VectorAssembler(inputCols=["x"], outputCol="features").transform(logs)
    model = GaussianMixture(k=2, tol=tolerance, maxIter=most_steps, seed=seed).fit(points)
    (a, wa), (b, wb) = sorted(((g, w) for g, w in zip(model.gaussians, model.weights, strict=True)), key=lambda p: p[0].mean[0])
    row = (name[0]["series_id"], float(a.mean[0]), float(b.mean[0]), float(a.cov.toArray()[0, 0]), float(b.cov.toArray()[0, 0]), wa, wb)
    return logs.sparkSession.createDataFrame([row], "series_id string, m1 double, m2 double, v1 double, v2 double, w1 double, w2 double")


def ordered(params: DataFrame) -> DataFrame:
    """The component with the smaller mean first."""
    swap = F.col("m1") > F.col("m2")
    pairs = [(a, b) for a, b in (("m1", "m2"), ("m2", "m1"), ("v1", "v2"), ("v2", "v1"), ("w1", "w2"), ("w2", "w1"))]
    return params.select("series_id", *[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in pairs])


def threshold(params: DataFrame, boundary: str = "compat") -> DataFrame:
    """``series_id, log_threshold, threshold``: where the densities meet between the means.

    The root of a quadratic. ``equal_density`` has the logarithm of the weights
    and deviations with the sign that makes the densities equal; ``compat`` has
    it the other way round, which results of earlier tools depend on. Equal
    variances leave a straight line. Null where no root lies between the means.
    """
    sign = {"compat": 1.0, "equal_density": -1.0}[boundary]
    m1, m2, v1, v2, w1, w2 = (F.col(c) for c in ("m1", "m2", "v1", "v2", "w1", "w2"))
    lines = ordered(params).select(
        "series_id",
        "m1",
        "m2",
        (1 / (2 * v1) - 1 / (2 * v2)).alias("a"),
        (m2 / v2 - m1 / v1).alias("b"),
        (m1 * m1 / (2 * v1) - m2 * m2 / (2 * v2) + sign * F.ln(F.sqrt(v2) * w1 / (F.sqrt(v1) * w2))).alias("c"),
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    root = F.sqrt(F.when(b * b - 4 * a * c >= 0, b * b - 4 * a * c))
    roots = F.when(a == 0, F.array(F.try_divide(-c, b))).otherwise(F.array(F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)))
    between = F.filter(roots, lambda x: (x > F.col("m1")) & (x < F.col("m2")))
    found = lines.select("series_id", F.get(between, F.lit(0)).alias("log_threshold"))
    return found.withColumn("threshold", from_log(F.col("log_threshold")))
