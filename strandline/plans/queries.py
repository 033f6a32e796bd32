"""The registered queries, each over a whole table, and the same in SQL.

``events`` is a score series: the event id is the frame, the value the score.
``embeddings`` are feature vectors, or frames of 64 pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import SegmentConfig, WindowFrames
from strandline.functions import columns
from strandline.operators import clips, features, fps, framediff, islands, mixture, quantile, report, smooth, timeline, verify
from strandline.plans import segment
from strandline.sinks import files
from strandline.sources import devices, frames
from strandline.sources.scores import as_scores
from strandline.storage import Workspace

FRAMES = WindowFrames(smooth=7, merge_gap=3, min_length=10, chunk=1 << 14)
EVEN = WindowFrames(smooth=12, merge_gap=3, min_length=10, chunk=1 << 14)
THRESHOLD = 25.0
FPS = 30.0
STEPS = 5
SIMILARITY = 0.05
QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return as_scores(events, F.lit("events"), F.col("event_id"), seconds, F.col("value"))


def _fps(of: DataFrame) -> DataFrame:
    return of.select("series_id").distinct().withColumn("fps", F.lit(FPS))


def _one_fps(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("events").alias("series_id"), F.lit(FPS).alias("fps"))


def _smoothed(spark: SparkSession, sf_dir: str, frames: WindowFrames = FRAMES) -> DataFrame:
    return smooth.rolling_median(_scores(spark, sf_dir), frames)


def _kept_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, for queries that read them several times."""
    return Workspace(spark).result(_segments(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.segments(_smoothed(spark, sf_dir), F.lit(THRESHOLD), FRAMES)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.segment_rows(_segments(spark, sf_dir), _one_fps(spark))


def frame_diff_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _table(spark, sf_dir, "embeddings").select(F.lit("e").alias("series_id"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("values"))
    return framediff.array_differences(frames).select("frame", F.round("score", 6).alias("score"))


def topk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framediff.top_scores(_scores(spark, sf_dir)).select("frame", "score")


def fps_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fps.estimate_fps(_scores(spark, sf_dir), chunk=FRAMES.chunk).select(F.round("fps", 9).alias("fps"))


def log_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("frame", F.round(columns.log_score(F.col("score")), 9).alias("log_score"))


def smooth_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir).select("frame", F.round("smoothed", 9).alias("smoothed"))


def smooth_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir, EVEN).select("frame", F.round("smoothed", 9).alias("smoothed"))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.ordered(mixture.fit_steps(mixture.log_scores(_scores(spark, sf_dir)), STEPS))


def mixture_em5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).select(*[F.round(c, 6).alias(c) for c in ("m1", "m2", "v1", "v2", "w1", "w2")])


def _per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score series for each type of event, timed at 30 frames a second as a score file has it."""
    events = segment.dense_frames(_table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id"), FRAMES.chunk)
    return as_scores(events, F.col("series_id"), F.col("frame"), columns.frame_time(F.col("frame"), F.lit(FPS)), F.col("value"))


def mixture_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture.ordered(mixture.fit(mixture.log_scores(_per_type(spark, sf_dir))))
    return found.select("series_id", *[F.round(c, 6).alias(c) for c in ("m1", "m2", "v1", "v2", "w1", "w2")])


def quantiles_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _per_type(spark, sf_dir).select("series_id", F.col("score").alias("x"))
    # So coarse a sketch leaves values to rank at any size.
    found = quantile.exact_quantiles(values, QUANTILES, accuracy=50)
    return found.select("series_id", "n", *[F.round(F.col("q")[k], 9).alias(f"q{k}") for k in range(len(QUANTILES))])


def segments_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = segment.segment(_per_type(spark, sf_dir), SegmentConfig(chunk_frames=FRAMES.chunk))
    return done.rows.select("series_id", F.col("index").alias("seg_index"), "start_frame", "end_frame", "start_sec", "end_sec", "duration_sec")


def threshold_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.threshold(_mixture(spark, sf_dir), "compat").select(F.round("threshold", 4).alias("threshold"))


def threshold_equal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.threshold(_mixture(spark, sf_dir), "equal_density").select(F.round("threshold", 4).alias("threshold"))


def below_threshold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir).select("frame", F.coalesce(F.col("smoothed") < THRESHOLD, F.lit(False)).alias("low"))


def islands_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.segments(_smoothed(spark, sf_dir), F.lit(THRESHOLD), FRAMES, least=False).select("seg_index", "start_frame", "end_frame")


def segments_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("seg_index", "start_frame", "end_frame")


def segments_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    # The threshold is worked out once: the plan of the segments would repeat the fit wherever it is used.
    threshold = mixture.threshold(_mixture(spark, sf_dir)).select("series_id", "threshold")
    threshold = spark.createDataFrame(threshold.collect(), threshold.schema)  # one row
    found = segment.segments_with(scores, threshold, FRAMES)
    rows = report.segment_rows(found, _one_fps(spark))
    return rows.select(F.col("index").alias("seg_index"), "start_frame", "end_frame", "start_sec", "end_sec", "duration_sec")


def segments_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = segment.dense_frames(_table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id"), FRAMES.chunk)
    scores = as_scores(events, F.col("series_id"), F.col("frame"), F.lit(None), F.col("value"))
    return segment.segments_with(scores, THRESHOLD, FRAMES)


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select(F.col("index").alias("seg_index"), "start_label", "end_label")


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir)
    found = report.coverage(_segments(spark, sf_dir), scores, _one_fps(spark))
    return found.select("segments", "frames", "inclusive_frames", F.round("seconds", 6).alias("seconds"), F.round("percent", 6).alias("percent"))


def clip_frame_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.clip_frames(_segments(spark, sf_dir)).select("seg_index", "frame")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 7 by 3 pixels: the first 63 entries of each vector as bytes of blue, green and red."""
    byte = lambda x: F.lpad(F.hex(F.pmod(F.floor((x.cast("double") + 1) * 128), F.lit(256))), 2, "0")
    bgr = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 63), byte), ""))
    vectors = _table(spark, sf_dir, "embeddings")
    return vectors.select(F.lit("e").alias("series_id"), F.col("vec_id").alias("frame"), F.lit(7).alias("width"), F.lit(3).alias("height"), bgr.alias("bgr"))


def frame_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = features.frame_histograms(_frames(spark, sf_dir)).select("frame", F.posexplode("hist").alias("bin", "weight"))
    return hist.where("weight > 0").select("frame", "bin", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = spark.range(1).select(F.lit("e").alias("series_id"), F.lit(24.0).alias("fps"))
    return framediff.frame_scores(frames.gray_frames(_frames(spark, sf_dir)), rate).select("frame", "time_sec", "score")


def color_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    pixels = events.select("event_type", (F.col("user_id") % 180).alias("hue"), F.least(F.floor("value"), F.lit(255)).alias("saturation"))
    hist = features.colour_histograms(pixels, ["event_type"]).select("event_type", F.posexplode("hist").alias("bin", "weight"))
    return hist.where("weight > 0").select("event_type", "bin", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def _features(spark: SparkSession, sf_dir: str, segments: DataFrame) -> DataFrame:
    middle = verify.middle_frames(segments)
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("hist"))
    count = vectors.agg(F.count("*").alias("vectors"))  # one row
    return middle.crossJoin(F.broadcast(count)).join(vectors, F.col("frame") % F.col("vectors") == F.col("vec_id")).select("series_id", "frame", "hist")


def anchor_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.anchors(_segments(spark, sf_dir)).select("seg_index", "start_frame", "end_frame")


def anchor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verify.anchors(_kept_segments(spark, sf_dir))
    mean = verify.mean_vector(verify.with_features(found, _features(spark, sf_dir, found)), ["series_id"])
    return mean.select(F.posexplode("mean").alias("pos", "v")).select("pos", F.round("v", 6).alias("v"))


def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    means = verify.mean_vector(vectors, ["label"], "embedding")
    similarity = columns.pearson(F.col("mean"), F.col("embedding"))
    return vectors.join(means, "label").select("vec_id", F.round(similarity, 6).alias("similarity"))


def segments_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _kept_segments(spark, sf_dir)
    kept = verify.verified(found, _features(spark, sf_dir, found), SIMILARITY)
    return kept.select("seg_index", "start_frame", "end_frame", F.round("similarity", 6).alias("similarity"))


def active_segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _scores(spark, sf_dir).select("series_id", "frame", (F.col("frame") / FPS).alias("at_sec"))
    rows = report.segment_rows(_kept_segments(spark, sf_dir), _one_fps(spark))
    found = timeline.active_segment(points, rows, bucket_sec=30.0)
    return found.select("frame", F.coalesce("active", F.lit(-1)).cast("long").alias("active"))


def timeline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _scores(spark, sf_dir).agg((F.count("*") / FPS).alias("total_sec"))
    rows = _rows(spark, sf_dir).crossJoin(F.broadcast(total))  # one row
    found = timeline.blocks(rows, F.col("total_sec"))
    return found.select(F.col("index").alias("seg_index"), F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct"), F.col("colour").cast("long").alias("colour"))


def block_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _scores(spark, sf_dir).agg((F.count("*") / FPS).alias("total_sec"))
    found = timeline.blocks(_rows(spark, sf_dir).crossJoin(F.broadcast(total)), F.col("total_sec"))  # one row
    return found.select(F.col("index").alias("seg_index"), "title", columns.zoom(F.col("index") * 10).cast("long").alias("zoom"))


def labels_at_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and a rounded time for every frame, at a rate where halves occur."""
    frame, rate = F.col("event_id"), F.lit(24.0)
    return _table(spark, sf_dir, "events").select(frame.alias("frame"), columns.clock_label(columns.seconds(frame, rate)).alias("label"), columns.frame_time(frame, rate).alias("time_sec"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and length of each type's series; some have no rate or no count of frames."""
    scores = _per_type(spark, sf_dir)
    every = scores.groupBy("series_id").agg(F.count("*").alias("n"))
    metadata = every.select("series_id", (F.col("n") % 3 * 12.5).alias("fps"), F.when(F.col("n") % 2 == 0, F.col("n")).alias("frame_count"))
    return frames.durations(metadata, scores).select("series_id", "fps", F.round("duration_sec", 6).alias("duration_sec"))


def device_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices from lines of text, some of them malformed."""
    key, free = F.col("s_suppkey"), F.col("s_acctbal")
    line = F.when(key % 7 == 0, "").when(key % 7 == 1, F.concat_ws(",", key, F.lit("NaN"))).when(key % 7 == 2, F.concat(F.lit("x"), key)).otherwise(F.concat(F.lit(" "), key, F.lit(" , "), free))
    lines = _table(spark, sf_dir, "supplier").select(line.alias("value"), key.cast("long").alias("place"))
    return devices.parse_devices(lines).select("device", "free_mb")


def _results(plan: DataFrame) -> DataFrame:
    """Every third clip failed."""
    return plan.select("series_id", "seg_index", "clip", (F.col("seg_index") % 3 != 0).alias("ok"))


def clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = clips.clip_plan(_segments(spark, sf_dir), _one_fps(spark))
    return clips.clip_index(plan, _results(plan)).drop("series_id")


def clip_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.outcome(_results(clips.clip_plan(_segments(spark, sf_dir), _one_fps(spark)))).select("cut", "failed")


def clip_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which device cuts which clip; nations stand for devices."""
    own = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("device"), (F.col("n_regionkey") * 300 + 100).alias("free_mb"))
    plan = clips.clip_plan(_segments(spark, sf_dir), _one_fps(spark))
    return clips.with_devices(plan, own, chunk=16).select("seg_index", "device")


def clip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.clip_plan(_segments(spark, sf_dir), _one_fps(spark)).drop("series_id")


def concat_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = clips.clip_plan(_segments(spark, sf_dir), _one_fps(spark))
    return clips.concat_list(plan).select("listing")


def best_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.first_best(_table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey").select("s_suppkey", "s_acctbal")


def best_device_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = devices.best_per_group(_table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey")
    return found.select("s_nationkey", "s_suppkey", "s_acctbal")


def segments_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.segments_json(_rows(spark, sf_dir)).select("payload")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        frame_diff_l1,
        topk_scores,
        fps_estimate,
        log_scores,
        smooth_odd,
        smooth_even,
        mixture_em5,
        mixture_fit,
        quantiles_per_series,
        segments_default,
        threshold_compat,
        threshold_equal_density,
        below_threshold_flags,
        islands_merged,
        segments_manual,
        segments_auto,
        segments_per_series,
        segment_labels,
        coverage_summary,
        clip_frame_list,
        color_histogram,
        frame_histograms,
        frame_scores,
        anchor_selection,
        anchor_mean,
        vector_similarity,
        segments_verified,
        active_segment_lookup,
        timeline_blocks,
        block_titles,
        labels_at_24,
        durations,
        device_inventory,
        clip_index,
        clip_outcome,
        clip_devices,
        clip_plan,
        concat_listing,
        best_device,
        best_device_per_group,
        segments_json,
    )
}


def _smooth_sql(frames: WindowFrames) -> str:
    return f"SELECT event_id AS frame, median(value) OVER (ORDER BY event_id ROWS BETWEEN {frames.preceding} PRECEDING AND {frames.following} FOLLOWING) AS m FROM events"


def _segments_sql(threshold: str, least: int | None = FRAMES.min_length) -> str:
    where = "" if least is None else f"WHERE e - s >= {least}"
    return f"""
sm AS ({_smooth_sql(FRAMES)}),
r AS (SELECT frame, lag(frame) OVER (ORDER BY frame) AS p FROM sm WHERE m < {threshold}),
g AS (SELECT frame, sum(CASE WHEN p IS NULL OR frame - p - 1 > {FRAMES.merge_gap} THEN 1 ELSE 0 END) OVER (ORDER BY frame ROWS UNBOUNDED PRECEDING) AS sid FROM r),
a AS (SELECT sid, min(frame) AS s, max(frame) AS e FROM g GROUP BY sid),
b AS (SELECT s, CASE WHEN mx - e <= {FRAMES.merge_gap} THEN mx ELSE e END AS e FROM a, (SELECT max(frame) AS mx FROM sm)),
seg AS (SELECT row_number() OVER (ORDER BY s) AS seg_index, s AS start_frame, e AS end_frame FROM b {where})"""


def _em_sql() -> str:
    parts = [
        "p0 AS (SELECT quantile_cont(x, 0.25) AS m1, quantile_cont(x, 0.75) AS m2, var_pop(x) / 4 + 1e-6 AS v1, var_pop(x) / 4 + 1e-6 AS v2, 0.5::double AS w1, 0.5::double AS w2 FROM x)"
    ]
    for i in range(STEPS):
        parts.append(
            f"""d{i} AS (SELECT x, w1 / sqrt(2 * pi() * v1) * exp(-(x - m1) * (x - m1) / (2 * v1)) AS a, w2 / sqrt(2 * pi() * v2) * exp(-(x - m2) * (x - m2) / (2 * v2)) AS b FROM x, p{i}),
g{i} AS (SELECT x, a / (a + b) AS g FROM d{i}),
p{i + 1} AS (SELECT sum(g * x) / sum(g) AS m1, sum((1 - g) * x) / sum(1 - g) AS m2,
  sum(g * x * x) / sum(g) - (sum(g * x) / sum(g)) ** 2 + 1e-6 AS v1,
  sum((1 - g) * x * x) / sum(1 - g) - (sum((1 - g) * x) / sum(1 - g)) ** 2 + 1e-6 AS v2,
  sum(g) / count(*) AS w1, sum(1 - g) / count(*) AS w2 FROM g{i})"""
        )
    ordered = ", ".join(f"CASE WHEN m1 > m2 THEN {b} ELSE {a} END AS {a}" for a, b in (("m1", "m2"), ("m2", "m1"), ("v1", "v2"), ("v2", "v1"), ("w1", "w2"), ("w2", "w1")))
    parts.append(f"em AS (SELECT {ordered} FROM p{STEPS})")
    return "x AS (SELECT log10(greatest(value, 1)) AS x FROM events WHERE value IS NOT NULL),\n" + ",\n".join(parts)


def _threshold_sql(sign: str) -> str:
    return f"""{_em_sql()},
q AS (SELECT m1, m2, 1 / (2 * v1) - 1 / (2 * v2) AS a, m2 / v2 - m1 / v1 AS b,
  m1 * m1 / (2 * v1) - m2 * m2 / (2 * v2) {sign} ln(sqrt(v2) * w1 / (sqrt(v1) * w2)) AS c FROM em),
roots AS (SELECT m1, m2, unnest([(-b - sqrt(b * b - 4 * a * c)) / (2 * a), (-b + sqrt(b * b - 4 * a * c)) / (2 * a)]) AS r FROM q),
th AS (SELECT min(10 ** r) AS threshold FROM roots WHERE r > m1 AND r < m2)"""


#: To a fixed point: two means, then expectation-maximisation, for each series until it has settled.
_FIT = """x AS (SELECT series_id, log10(greatest(value, 1)) AS x FROM typed WHERE value IS NOT NULL),
centres AS (
  SELECT series_id, 0 AS i, min(x) AS c1, max(x) AS c2 FROM x GROUP BY series_id
  UNION ALL
  SELECT series_id, i + 1, avg(x) FILTER (abs(x - c1) <= abs(x - c2)), coalesce(avg(x) FILTER (abs(x - c1) > abs(x - c2)), avg(x) FILTER (abs(x - c1) <= abs(x - c2)))
  FROM centres JOIN x USING (series_id) WHERE i < 10 GROUP BY series_id, i),
near AS (SELECT series_id, x, abs(x - c1) <= abs(x - c2) AS low FROM centres JOIN x USING (series_id) WHERE i = 10),
begun AS (
  SELECT series_id, avg(x) FILTER (low) AS m1, coalesce(avg(x) FILTER (NOT low), avg(x) FILTER (low)) AS m2,
    var_pop(x) FILTER (low) + 1e-6 AS v1, coalesce(var_pop(x) FILTER (NOT low), var_pop(x) FILTER (low)) + 1e-6 AS v2,
    count(*) FILTER (low) / count(*) AS w1 FROM near GROUP BY series_id),
em AS (
  SELECT series_id, 0 AS i, m1, m2, v1, v2, w1, 1 - w1 AS w2, NULL::double AS l, false AS settled FROM begun
  UNION ALL
  SELECT series_id, i + 1, sum(g * x) / sum(g), sum((1 - g) * x) / sum(1 - g),
    sum(g * x * x) / sum(g) - (sum(g * x) / sum(g)) ** 2 + 1e-6, sum((1 - g) * x * x) / sum(1 - g) - (sum((1 - g) * x) / sum(1 - g)) ** 2 + 1e-6,
    sum(g) / count(*), sum(1 - g) / count(*), avg(ln(p)), coalesce(abs(avg(ln(p)) - any_value(l)) < 0.001, false)
  FROM (SELECT *, a / (a + b) AS g, a + b AS p FROM (
    SELECT series_id, i, x, l, w1 / sqrt(2 * pi() * v1) * exp(-(x - m1) * (x - m1) / (2 * v1)) AS a, w2 / sqrt(2 * pi() * v2) * exp(-(x - m2) * (x - m2) / (2 * v2)) AS b
    FROM em JOIN x USING (series_id) WHERE NOT settled AND i < 100))
  GROUP BY series_id, i),
last_ AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY i DESC) = 1),
fitted AS (SELECT series_id, CASE WHEN m1 > m2 THEN m2 ELSE m1 END AS m1, CASE WHEN m1 > m2 THEN m1 ELSE m2 END AS m2,
  CASE WHEN m1 > m2 THEN v2 ELSE v1 END AS v1, CASE WHEN m1 > m2 THEN v1 ELSE v2 END AS v2,
  CASE WHEN m1 > m2 THEN w2 ELSE w1 END AS w1, CASE WHEN m1 > m2 THEN w1 ELSE w2 END AS w2 FROM last_)"""
_TYPED = "typed AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame, value FROM events)"
_DEFAULT = SegmentConfig().frames(1 / 0.033)

#: The bytes of each vector's 21 pixels.
_PIXELS = """bytes AS (SELECT vec_id, list_transform(embedding[1:63], lambda x: floor((x::double + 1) * 128)::bigint % 256) AS v FROM embeddings),
px AS (SELECT vec_id, k, v[3 * k + 1] AS b, v[3 * k + 2] AS g, v[3 * k + 3] AS r FROM (SELECT *, unnest(range(21)) AS k FROM bytes))"""

_MANUAL = _segments_sql(str(THRESHOLD))
_ROWS = f"""{_MANUAL},
rows_ AS (SELECT seg_index, start_frame, end_frame, round(start_frame / {FPS}, 4) AS start_sec, round(end_frame / {FPS}, 4) AS end_sec,
  round((end_frame - start_frame) / {FPS}, 4) AS duration_sec, start_frame / {FPS} AS a, end_frame / {FPS} AS b FROM seg)"""
_LABEL = "printf('%02d:%05.2f', floor({0} / 60)::bigint, {0} - floor({0} / 60) * 60)"
_ANCHORS = f"{_MANUAL}, anchor AS (SELECT * FROM seg ORDER BY end_frame - start_frame DESC, start_frame DESC LIMIT 5)"
_ANCHOR_MEAN = f"""{_ANCHORS},
mean_ AS (SELECT pos, avg(v) AS v FROM (
  SELECT unnest(range(0, len(embedding))) AS pos, unnest(embedding)::double AS v
  FROM anchor JOIN embeddings ON vec_id = ((start_frame + end_frame) // 2) % (SELECT count(*) FROM embeddings)) GROUP BY pos)"""

ORACLES: dict[str, str] = {
    "frame_diff_l1": """
WITH p AS (SELECT vec_id, embedding::double[] AS v, lag(embedding::double[]) OVER (ORDER BY vec_id) AS w FROM embeddings)
SELECT vec_id AS frame, round(coalesce(list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))), 0), 6) AS score FROM p""",
    "topk_scores": "SELECT event_id AS frame, value AS score FROM events ORDER BY value DESC, event_id LIMIT 10",
    "fps_estimate": """
WITH t AS (SELECT event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE epoch_us(ts) > 0),
d AS (SELECT t - lag(t) OVER (ORDER BY event_id) AS d FROM t)
SELECT round(1 / median(d), 9) AS fps FROM d WHERE d > 0""",
    "log_scores": "SELECT event_id AS frame, round(log10(greatest(value, 1)), 9) AS log_score FROM events",
    "smooth_odd": f"SELECT frame, round(m, 9) AS smoothed FROM ({_smooth_sql(FRAMES)})",
    "smooth_even": f"SELECT frame, round(m, 9) AS smoothed FROM ({_smooth_sql(EVEN)})",
    "mixture_em5": f"WITH {_em_sql()} SELECT round(m1, 6) AS m1, round(m2, 6) AS m2, round(v1, 6) AS v1, round(v2, 6) AS v2, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM em",
    "mixture_fit": f"WITH RECURSIVE {_TYPED}, {_FIT} SELECT series_id, round(m1, 6) AS m1, round(m2, 6) AS m2, round(v1, 6) AS v1, round(v2, 6) AS v2, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM fitted",
    "quantiles_per_series": f"SELECT event_type AS series_id, count(*) AS n, {', '.join(f'round(quantile_cont(value, {p}), 9) AS q{k}' for k, p in enumerate(QUANTILES))} FROM events GROUP BY event_type",
    "segments_default": f"""WITH RECURSIVE {_TYPED}, {_FIT},
q AS (SELECT *, 1 / (2 * v1) - 1 / (2 * v2) AS a, m2 / v2 - m1 / v1 AS b,
  m1 * m1 / (2 * v1) - m2 * m2 / (2 * v2) + ln(sqrt(v2) * w1 / (sqrt(v1) * w2)) AS c FROM fitted),
roots AS (SELECT series_id, m1, m2, unnest([(-b - sqrt(b * b - 4 * a * c)) / (2 * a), (-b + sqrt(b * b - 4 * a * c)) / (2 * a)]) AS r FROM q),
th AS (SELECT series_id, min(10 ** r) AS threshold FROM roots WHERE r > m1 AND r < m2 GROUP BY series_id),
step AS (SELECT series_id, t - lag(t) OVER (PARTITION BY series_id ORDER BY frame) AS step FROM (SELECT series_id, frame, round(frame / {FPS}, 3) AS t FROM typed) WHERE t > 0),
rate AS (SELECT series_id, 1 / median(step) AS fps FROM step WHERE step > 0 GROUP BY series_id),
sm AS (SELECT series_id, frame, median(value) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN {_DEFAULT.preceding} PRECEDING AND {_DEFAULT.following} FOLLOWING) AS m FROM typed),
r AS (SELECT series_id, frame, lag(frame) OVER (PARTITION BY series_id ORDER BY frame) AS p FROM sm JOIN th USING (series_id) WHERE m < threshold),
g AS (SELECT series_id, frame, sum(CASE WHEN p IS NULL OR frame - p - 1 > {_DEFAULT.merge_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS sid FROM r),
a AS (SELECT series_id, sid, min(frame) AS s, max(frame) AS e FROM g GROUP BY ALL),
b AS (SELECT a.series_id, s, CASE WHEN mx - e <= {_DEFAULT.merge_gap} THEN mx ELSE e END AS e FROM a JOIN (SELECT series_id, max(frame) AS mx FROM sm GROUP BY ALL) USING (series_id))
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY s) AS seg_index, s AS start_frame, e AS end_frame,
  round(s / fps, 4) AS start_sec, round(e / fps, 4) AS end_sec, round((e - s) / fps, 4) AS duration_sec
FROM b JOIN rate USING (series_id) WHERE e - s >= {_DEFAULT.min_length}""",
    "threshold_compat": f"WITH {_threshold_sql('+')} SELECT round(threshold, 4) AS threshold FROM th",
    "threshold_equal_density": f"WITH {_threshold_sql('-')} SELECT round(threshold, 4) AS threshold FROM th",
    "below_threshold_flags": f"SELECT frame, coalesce(m < {THRESHOLD}, false) AS low FROM ({_smooth_sql(FRAMES)})",
    "islands_merged": f"WITH {_segments_sql(str(THRESHOLD), None)} SELECT * FROM seg",
    "segments_manual": f"WITH {_MANUAL} SELECT * FROM seg",
    "segments_auto": f"""WITH {_threshold_sql('+')}, {_segments_sql('(SELECT threshold FROM th)')}
SELECT seg_index, start_frame, end_frame, round(start_frame / {FPS}, 4) AS start_sec, round(end_frame / {FPS}, 4) AS end_sec, round((end_frame - start_frame) / {FPS}, 4) AS duration_sec FROM seg""",
    "segments_per_series": f"""
WITH n AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame, value FROM events),
sm AS (SELECT series_id, frame, median(value) OVER (PARTITION BY series_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM n),
r AS (SELECT series_id, frame, lag(frame) OVER (PARTITION BY series_id ORDER BY frame) AS p FROM sm WHERE m < {THRESHOLD}),
g AS (SELECT series_id, frame, sum(CASE WHEN p IS NULL OR frame - p - 1 > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS sid FROM r),
a AS (SELECT series_id, sid, min(frame) AS s, max(frame) AS e FROM g GROUP BY ALL),
b AS (SELECT a.series_id, s, CASE WHEN mx - e <= 3 THEN mx ELSE e END AS e FROM a JOIN (SELECT series_id, max(frame) AS mx FROM sm GROUP BY ALL) USING (series_id))
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY s) AS seg_index, s AS start_frame, e AS end_frame FROM b WHERE e - s >= 10""",
    "segment_labels": f"WITH {_ROWS} SELECT seg_index, {_LABEL.format('a')} AS start_label, {_LABEL.format('b')} AS end_label FROM rows_",
    "coverage_summary": f"""WITH {_MANUAL}
SELECT count(*) AS segments, coalesce(sum(end_frame - start_frame), 0)::bigint AS frames, coalesce(sum(end_frame - start_frame + 1), 0)::bigint AS inclusive_frames,
  round(coalesce(sum(end_frame - start_frame), 0)::bigint / {FPS}, 6) AS seconds,
  round(coalesce(sum(end_frame - start_frame), 0)::bigint * 100.0::double / (SELECT count(*) FROM events), 6) AS percent FROM seg""",
    "clip_frame_list": f"WITH {_MANUAL} SELECT seg_index, unnest(range(start_frame, end_frame + 1)) AS frame FROM seg",
    "color_histogram": """
WITH b AS (SELECT event_type, (user_id % 180) * 30 // 180 * 32 + least(floor(value), 255)::bigint * 32 // 256 AS bin FROM events WHERE value >= 0),
c AS (SELECT event_type, bin::int AS bin, count(*) AS n FROM b GROUP BY ALL)
SELECT event_type, bin, round((n / sqrt(sum(n * n) OVER (PARTITION BY event_type)))::float::double, 5) AS weight FROM c""",
    "frame_histograms": f"""WITH {_PIXELS},
h AS (SELECT vec_id, mx, mx - mn AS d, CASE WHEN mx = r THEN g - b WHEN mx = g THEN b - r + 2 * (mx - mn) ELSE r - g + 4 * (mx - mn) END AS sixths
  FROM (SELECT *, greatest(b, g, r) AS mx, least(b, g, r) AS mn FROM px)),
hs AS (SELECT vec_id, floor((sixths * CASE WHEN d = 0 THEN 0 ELSE round_even(122880.0::double / d, 0)::bigint END + 2048) / 4096.0::double)::bigint AS hue,
  floor((d * CASE WHEN mx = 0 THEN 0 ELSE round_even(1044480.0::double / mx, 0)::bigint END + 2048) / 4096.0::double)::bigint AS sat FROM h),
c AS (SELECT vec_id, bin, count(*) AS n FROM (SELECT vec_id, (CASE WHEN hue < 0 THEN hue + 180 ELSE hue END) // 6 * 32 + sat // 8 AS bin, CASE WHEN hue < 0 THEN hue + 180 ELSE hue END AS hue FROM hs) WHERE hue < 180 GROUP BY ALL)
SELECT vec_id AS frame, bin::int AS bin, round((n / sqrt(sum(n * n) OVER (PARTITION BY vec_id)))::float::double, 5) AS weight FROM c""",
    "frame_scores": f"""WITH {_PIXELS},
gray AS (SELECT vec_id, k, (b * 3735 + g * 19235 + r * 9798 + 16384) // 32768 AS y FROM px),
d AS (SELECT vec_id, abs(y - lag(y) OVER (PARTITION BY k ORDER BY vec_id)) AS d FROM gray)
SELECT vec_id AS frame, round(vec_id / 24.0::double, 3) AS time_sec, coalesce(sum(d), 0)::double AS score FROM d GROUP BY vec_id""",
    "anchor_selection": f"WITH {_ANCHORS} SELECT seg_index, start_frame, end_frame FROM anchor",
    "anchor_mean": f"WITH {_ANCHOR_MEAN} SELECT pos::int AS pos, round(v, 6) AS v FROM mean_",
    "vector_similarity": """
WITH u AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::double AS v FROM embeddings),
m AS (SELECT label, pos, avg(v) AS m FROM u GROUP BY ALL)
SELECT vec_id, round(corr(m, v), 6) AS similarity FROM u JOIN m USING (label, pos) GROUP BY vec_id""",
    "segments_verified": f"""WITH {_ANCHOR_MEAN},
u AS (SELECT seg_index, start_frame, end_frame, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::double AS v
  FROM seg JOIN embeddings ON vec_id = ((start_frame + end_frame) // 2) % (SELECT count(*) FROM embeddings)),
s AS (SELECT seg_index, start_frame, end_frame, corr(mean_.v, u.v) AS similarity FROM u JOIN mean_ USING (pos) GROUP BY ALL)
SELECT seg_index, start_frame, end_frame, round(similarity, 6) AS similarity FROM s WHERE similarity >= {SIMILARITY}""",
    "active_segment_lookup": f"""WITH {_ROWS}
SELECT event_id AS frame, coalesce(min(seg_index), -1)::bigint AS active
FROM events LEFT JOIN rows_ ON event_id / {FPS} BETWEEN start_sec AND end_sec GROUP BY event_id""",
    "timeline_blocks": f"""WITH {_ROWS}, t AS (SELECT count(*) / {FPS} AS total FROM events)
SELECT seg_index, round(start_sec / total * 100, 6) AS left_pct, round(greatest(duration_sec / total * 100, 0.3), 6) AS width_pct, (seg_index - 1) % 6 AS colour FROM rows_, t""",
    "clip_plan": f"WITH {_ROWS} SELECT seg_index, printf('clip_%04d.mp4', seg_index) AS clip, start_frame, end_frame, start_sec, end_sec, duration_sec FROM rows_",
    "block_titles": f"""WITH {_ROWS}
SELECT seg_index, printf('#%d ', seg_index) || {_LABEL.format('a')} || ' - ' || {_LABEL.format('b')} || printf(' (%.2fs)', duration_sec) AS title,
  least(greatest(seg_index * 10, 50), 300)::bigint AS zoom FROM rows_""",
    "labels_at_24": f"SELECT event_id AS frame, {_LABEL.format('(event_id / 24.0::double)')} AS label, round(event_id / 24.0::double, 3) AS time_sec FROM events",
    "durations": f"""WITH {_TYPED},
n AS (SELECT series_id, count(*) AS n, max(round(frame / {FPS}, 3)) AS last FROM typed GROUP BY series_id),
m AS (SELECT series_id, last, CASE WHEN n % 2 = 0 THEN n END AS n, CASE WHEN n % 3 > 0 THEN n % 3 * 12.5::double ELSE 30 END AS fps FROM n)
SELECT series_id, fps, round(CASE WHEN n > 0 THEN n / fps ELSE last END, 6) AS duration_sec FROM m""",
    "device_inventory": "SELECT s_suppkey::int AS device, trunc(s_acctbal)::int AS free_mb FROM supplier WHERE s_suppkey % 7 > 2",
    "clip_index": f"WITH {_ROWS} SELECT printf('clip_%04d.mp4', seg_index) AS clip, start_frame, end_frame, start_sec, end_sec, duration_sec FROM rows_ WHERE seg_index % 3 <> 0",
    "clip_outcome": f"WITH {_ROWS} SELECT count(*) FILTER (seg_index % 3 <> 0) AS cut, count(*) FILTER (seg_index % 3 = 0) AS failed FROM rows_",
    "clip_devices": f"""WITH {_ROWS},
at_ AS (SELECT seg_index, (sum(duration_sec) OVER (ORDER BY seg_index ROWS UNBOUNDED PRECEDING) - duration_sec / 2) / sum(duration_sec) OVER () AS spot FROM rows_),
w AS (SELECT n_nationkey, n_regionkey * 300 + 100 AS w FROM nation),
d AS (SELECT n_nationkey, sum(w) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING)::double / sum(w) OVER ()::double AS high, w::double / sum(w) OVER ()::double AS own FROM w)
SELECT seg_index, n_nationkey::int AS device FROM at_ JOIN d ON spot >= high - own AND spot < high""",
    "concat_listing": f"WITH {_MANUAL} SELECT string_agg(printf('file ''clip_%04d.mp4''', seg_index), chr(10) ORDER BY seg_index) AS listing FROM seg",
    "segments_json": f"""WITH {_ROWS}
SELECT to_json(list({{'index': seg_index, 'start_frame': start_frame, 'end_frame': end_frame, 'start_sec': start_sec, 'end_sec': end_sec,
  'duration_sec': duration_sec, 'start_label': {_LABEL.format('a')}, 'end_label': {_LABEL.format('b')}}} ORDER BY seg_index))::varchar AS payload FROM rows_""",
    "best_device": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1",
    "best_device_per_group": "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1",
}
ORACLES = {k: v.replace(f"/ {FPS}", f"/ {FPS}::double") for k, v in ORACLES.items()}
