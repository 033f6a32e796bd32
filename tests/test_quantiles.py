"""Exact quantiles, and the fit of many series at once."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.config import SegmentConfig, WindowFrames
from strandline.operators import mixture
from strandline.operators.quantile import exact_quantiles
from strandline.plans.segment import segment

FRACTIONS = [0.0, 0.1, 0.5, 0.95, 1.0]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.none(), st.sampled_from([1.0, 2.0, -3.0]), st.floats(allow_nan=False)), max_size=60), min_size=1, max_size=8), st.sampled_from([10, 100, 100_000]))
def test_quantiles_equal_percentile(spark, series, accuracy):
    rows = [(f"s{i}", v) for i, values in enumerate(series) for v in values]
    df = spark.createDataFrame(rows, "series_id string, x double")
    got = {r["series_id"]: (r["n"], r["q"]) for r in exact_quantiles(df, FRACTIONS, accuracy).collect()}
    want = df.where("x IS NOT NULL").groupBy("series_id").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, FRACTIONS))).alias("q"))
    assert str(sorted(got.items())) == str(sorted((r["series_id"], (r["n"], r["q"])) for r in want.collect()))


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quantiles_of_a_long_series(spark, accuracy):
    """Skewed and tied values; only few of them are ranked."""
    df = spark.range(200_000).selectExpr("'s' AS series_id", "CASE WHEN id % 3 = 0 THEN 7.5 ELSE exp(randn(5) * 4) END AS x").cache()
    want = df.agg(F.percentile("x", F.array(*map(F.lit, FRACTIONS)))).first()[0]
    assert exact_quantiles(df, FRACTIONS, accuracy).first()["q"] == want


def plain_fit(x, tolerance=1e-3):
    """The same fit by numpy."""
    c = np.array([x.min(), x.max()])
    for _ in range(10):
        low = abs(x - c[0]) <= abs(x - c[1])
        c = np.array([x[low].mean(), x[~low].mean() if (~low).any() else x[low].mean()])
    low = abs(x - c[0]) <= abs(x - c[1])
    parts = [x[low], x[~low] if (~low).any() else x[low]]
    m, v, w = np.array([p.mean() for p in parts]), np.array([p.var() for p in parts]) + 1e-6, np.array([low.mean(), 1 - low.mean()])
    before = None
    for _ in range(100):
        p = w / np.sqrt(2 * np.pi * v) * np.exp(-((x[:, None] - m) ** 2) / (2 * v))
        likelihood = np.log(p.sum(axis=1)).mean()
        g = p / p.sum(axis=1, keepdims=True)
        n = g.sum(axis=0)
        m = (g * x[:, None]).sum(axis=0) / n
        v = (g * x[:, None] ** 2).sum(axis=0) / n - m * m + 1e-6
        w = n / len(x)
        if before is not None and abs(likelihood - before) < tolerance:
            break
        before = likelihood
    return [*m, *v, *w]


def test_ten_thousand_series_settle_each_for_itself(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = {f"s{i}": np.r_[rng.normal(4, 0.3, 6), rng.normal(6 + i % 3, 0.4, 6)].round(3) for i in range(10_000)}
    df = spark.createDataFrame([(k, float(v)) for k, values in data.items() for v in values], "series_id string, x double").repartition(4)

    def no_rows(*_):
        raise AssertionError("the driver may not hold the parameters")

    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", no_rows)
        m.setattr(type(df), "toPandas", no_rows)
        found = mixture.fit(df)
    got = {r["series_id"]: tuple(r)[1:] for r in found.collect()}
    assert len(got) == 10_000
    for k in [f"s{i}" for i in range(0, 10_000, 97)]:
        assert got[k] == pytest.approx(plain_fit(data[k]), rel=1e-6, abs=1e-9)


def test_fit_of_odd_series(spark):
    rows = [("same", 2.0)] * 5 + [("one", 3.0)] + [("two", 1.0), ("two", 9.0)]
    got = {r["series_id"]: r for r in mixture.fit(spark.createDataFrame(rows, "series_id string, x double")).collect()}
    assert got["same"]["m1"] == got["same"]["m2"] == 2.0 and got["one"]["m1"] == 3.0 and (got["two"]["m1"], got["two"]["m2"]) == (1.0, 9.0)
    assert mixture.fit(spark.createDataFrame([], "series_id string, x double")).count() == 0


def test_window_columns_equal_the_settings(spark):
    config = SegmentConfig()
    rates = [0.5, 23.809524, 24.0, 29.97, 30.303030303030305, 60.0]
    got = spark.createDataFrame([(r,) for r in rates], "fps double").select(*config.frame_columns(F.col("fps"))).collect()
    for r, row in zip(rates, got, strict=True):
        assert WindowFrames(**row.asDict(), chunk=config.chunk_frames) == config.frames(r)


def test_series_of_different_rates_are_segmented_together(spark):
    rows = []
    for name, rate in (("slow", 10), ("fast", 50), ("also fast", 50)):
        low = [100 <= i < 100 + 4 * rate for i in range(int(10 * rate))]
        rows += [(name, i, round(i / rate, 3), 1e3 if x else 1e7 + i) for i, x in enumerate(low)]
    scores = spark.createDataFrame(rows, "series_id string, frame long, time_sec double, score double")
    done = segment(scores, SegmentConfig(manual_threshold=1e5))
    got = {r["series_id"]: (r["start_frame"], r["end_frame"]) for r in done.segments.collect()}
    assert done.fps.count() == 3 and set(got) == {"fast", "also fast"}
    assert got["fast"] == got["also fast"] and abs(got["fast"][0] - 100) <= 13 and abs(got["fast"][1] - 299) <= 13
