import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.config import SegmentConfig, WindowFrames
from strandline.operators import fps, islands, mixture, smooth
from strandline.plans.segment import dense_frames, segment
from strandline.streaming.segments import OnlineSegmenter

CASES = [
    ("1110011", [(0, 6)]),
    ("11110001111", [(0, 3), (7, 10)]),
    ("111100", [(0, 5)]),
    ("1111000", [(0, 3)]),
    ("0000", []),
    ("111000", []),
    ("11100", [(0, 4)]),
    ("1001001", [(0, 6)]),
    ("0111101111000", [(1, 9)]),
]


def by_scan(flags, gap, least):
    """Segments by one pass over the flags, written from the rules alone."""
    found, start, last = [], None, None
    for i, low in enumerate(flags):
        if low:
            start = i if start is None else start
            last = i
        elif start is not None and i - last > gap:
            found.append((start, last))
            start = None
    if start is not None:
        found.append((start, len(flags) - 1))
    return [(a, b) for a, b in found if b - a >= least]


def smoothed(spark, series):
    data = [(name, i, 0.0 if f else 10.0) for name, flags in series.items() for i, f in enumerate(flags)]
    return spark.createDataFrame(data, "series_id string, frame long, smoothed double")


def found_in(segments):
    out = {}
    for r in segments.orderBy("series_id", "seg_index").collect():
        out.setdefault(r["series_id"], []).append((r["start_frame"], r["end_frame"]))
    return out


@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_island_cases(spark, chunk):
    series = {flags: [c == "1" for c in flags] for flags, _ in CASES}
    got = found_in(islands.segments(smoothed(spark, series), F.lit(5.0), WindowFrames(1, 2, 3, chunk)))
    assert got == {flags: want for flags, want in CASES if want}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=60), min_size=1, max_size=12), st.integers(0, 4), st.integers(0, 5), st.integers(1, 20))
def test_islands_equal_a_scan(spark, flags, gap, least, chunk):
    series = {f"s{i:02}": f for i, f in enumerate(flags)}
    got = found_in(islands.segments(smoothed(spark, series), F.lit(5.0), WindowFrames(1, gap, least, chunk)))
    want = {k: found for k, v in series.items() if (found := by_scan(v, gap, least))}
    assert got == want


def test_empty_table_has_no_segments(spark):
    assert islands.segments(smoothed(spark, {}), F.lit(5.0), WindowFrames(1, 2, 3)).count() == 0


def scores(spark, values, name="s"):
    return spark.createDataFrame([(name, i, i / 30, v) for i, v in enumerate(values)], "series_id string, frame long, time_sec double, score double")


@pytest.mark.parametrize("window", [1, 4, 7, 12, 15, 121])
@pytest.mark.parametrize("chunk", [128, 1 << 18])
def test_rolling_median_equals_pandas(spark, window, chunk):
    values = [None if i % 17 == 3 else float((i * 7919) % 101) for i in range(400)]
    got = smooth.rolling_median(scores(spark, values), WindowFrames(window, 0, 0, chunk)).orderBy("frame").toPandas()["smoothed"]
    want = pd.Series(values, dtype=float).rolling(window, center=True, min_periods=1).median()
    assert np.allclose(got, want, equal_nan=True)


def test_window_reach():
    assert (WindowFrames(15, 0, 0).preceding, WindowFrames(15, 0, 0).following) == (7, 7)
    assert (WindowFrames(12, 0, 0).preceding, WindowFrames(12, 0, 0).following) == (6, 5)
    assert SegmentConfig().frames(30.30303).smooth == 15 and SegmentConfig().frames(1.0).smooth == 1


@pytest.mark.parametrize(("rate", "want"), [(30, 30.303030), (24, 23.809524), (60, 58.823529)])
@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_fps_from_rounded_times(spark, rate, want, chunk):
    times = spark.createDataFrame([("s", i, round(i / rate, 3)) for i in range(300)], "series_id string, frame long, time_sec double")
    assert fps.estimate_fps(times, chunk=chunk).first()["fps"] == pytest.approx(want, abs=1e-6)


def test_fps_default(spark):
    times = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 1.0)], "series_id string, frame long, time_sec double")
    assert {r["series_id"]: r["fps"] for r in fps.estimate_fps(times).collect()} == {"a": 30.0, "b": 30.0}


def test_boundaries(spark):
    params = spark.createDataFrame([("s", 6.5, 5.0, 0.3, 0.04, 0.65, 0.35)], "series_id string, m1 double, m2 double, v1 double, v2 double, w1 double, w2 double")
    assert mixture.threshold(params, "compat").first()["log_threshold"] == pytest.approx(5.372186, abs=1e-6)
    assert mixture.threshold(params, "equal_density").first()["log_threshold"] == pytest.approx(5.428974, abs=1e-6)


def test_equal_variances_leave_a_line(spark):
    params = spark.createDataFrame([("s", 1.0, 3.0, 0.5, 0.5, 0.5, 0.5)], "series_id string, m1 double, m2 double, v1 double, v2 double, w1 double, w2 double")
    assert mixture.threshold(params).first()["log_threshold"] == pytest.approx(2.0)


def planned(seed=7, frames=9000):
    rng = np.random.default_rng(seed)
    rallies = [(300, 1100), (1500, 2200), (2231, 2600), (3000, 3500), (3560, 4100), (5000, 5060), (8000, 8999)]
    low = np.zeros(frames, dtype=bool)
    for a, b in rallies:
        low[a : b + 1] = True
    values = np.exp(rng.normal(np.where(low, np.log(1e6), np.log(1e7)), 0.2))
    spikes = rng.choice(np.flatnonzero(low), 60, replace=False)
    values[spikes] = 3e7
    return values


WANT = [(300, 1100), (1500, 2600), (3000, 3500), (3560, 4100), (8000, 8999)]


@pytest.mark.parametrize("boundary", ["compat", "equal_density"])
def test_planned_series_end_to_end(spark, boundary):
    done = segment(scores(spark, [float(v) for v in planned()]), SegmentConfig(boundary=boundary, chunk_frames=1000))
    got = [(r["start_frame"], r["end_frame"]) for r in done.rows.orderBy("index").collect()]
    assert len(got) == len(WANT)
    for (a, b), (x, y) in zip(got, WANT, strict=True):
        assert abs(a - x) <= 8 and abs(b - y) <= 8
    cover = done.coverage.first()
    assert cover["segments"] == len(WANT) and 0 < cover["percent"] < 100


def test_spark_ml_mixture_agrees_on_two_clear_kinds(spark):
    logs = mixture.log_scores(scores(spark, [float(v) for v in planned()[:3000]]))
    ours, theirs = mixture.ordered(mixture.fit(logs)).first(), mixture.fit_ml(logs).first()
    assert ours["m1"] == pytest.approx(theirs["m1"], abs=0.1) and ours["m2"] == pytest.approx(theirs["m2"], abs=0.1)


def test_dense_frames(spark):
    df = spark.createDataFrame([("a", i * 3) for i in range(50)] + [("b", i) for i in range(20)], "k string, o long")
    got = dense_frames(df, F.col("k"), F.col("o"), chunk=7).toPandas()
    for name, part in got.groupby("series_id"):
        assert part.sort_values("o")["frame"].tolist() == list(range(len(part))), name


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0, 10)), min_size=1, max_size=80), st.integers(1, 9), st.integers(0, 4), st.integers(0, 6), st.integers(1, 30))
def test_online_equals_whole(values, window, gap, least, stop):
    frames = WindowFrames(window, gap, least)
    want = by_scan(list(pd.Series(values, dtype=float).rolling(window, center=True, min_periods=1).median() < 5), gap, least)
    # A segment that is closed by the gap at the very end is open by the tail rule only within the gap.
    first = OnlineSegmenter(5.0, frames)
    got = [s for v in values[:stop] for s in first.add(v)]
    second = OnlineSegmenter(5.0, frames, first.state())
    got += [s for v in values[stop:] for s in second.add(v)]
    assert got + second.finish() == want
