"""Command line: ``python -m strandline.cli segment scores.csv --video match.y4m --out folder``.

``scores`` makes the score file of a video. ``segment``, ``clips`` and
``export`` take the rate from the video's container where it says so, and verify
segments by the colours of the video's frames where these can be read: those of
a Y4M file, or of any by ``--reader package.module:function``.
"""

from __future__ import annotations

import argparse
import glob
import importlib
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import SegmentConfig
from strandline.operators import clips
from strandline.operators.features import frame_histograms
from strandline.operators.framediff import frame_scores, top_scores
from strandline.plans.segment import Features, segment
from strandline.session import local_session
from strandline.sinks import files
from strandline.sources import containers, frames, y4m
from strandline.sources.devices import LIST_DEVICES, SOFTWARE_ENCODERS, choose_encoder, device_lines, find_program, parse_devices, run_text
from strandline.sources.scores import check_contiguous, read_scores


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strandline")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("segment", "segments, coverage and a viewer"), ("top", "the largest scores"), ("clips", "a clip for each segment"), ("export", "a clip for each segment, and all joined")):
        part = sub.add_parser(name, help=text)
        part.add_argument("scores", nargs="?", help="score CSV; without it, the first *.csv by name")
        part.add_argument("--video", default="")
        part.add_argument("--out", default=".")
        part.add_argument("--threshold", type=float)
        part.add_argument("--boundary", choices=("compat", "equal_density"), default="compat")
        part.add_argument("--workers", type=int, default=os.cpu_count() or 4)
        part.add_argument("--reader", help="package.module:function, from a path and a frame's number to (width, height, bytes) or None")
        part.add_argument("--similarity", type=float, default=SegmentConfig().similarity, help="0 keeps segments whatever they look like")
    part = sub.add_parser("scores", help="the score file of an uncompressed video")
    part.add_argument("video")
    part.add_argument("--out", help="the score file; without it, named after the video")
    return parser


def first_scores(folder: str = ".") -> str:
    found = sorted(glob.glob(os.path.join(folder, "*.csv")))
    if not found:
        raise SystemExit("no score CSV here")
    return found[0]


def video_path(spark: SparkSession, series: DataFrame, video: str) -> DataFrame:
    return series.select("series_id").distinct().withColumn("path", F.lit(os.path.abspath(video)))


def features_of(spark: SparkSession, paths: DataFrame, video: str, reader: str | None) -> Features | None:
    """Histograms of the frames that are asked for, read from the video; none where nothing can read it."""
    if reader:
        module, _, name = reader.partition(":")
        found = importlib.import_module(module)
        if "." not in module:  # a file of the user's, which tasks need too; packages are installed
            spark.sparkContext.addPyFile(found.__file__)
        read = getattr(found, name)
    elif os.path.exists(video) and y4m.read_frame(video, 0):
        read = y4m.read_frame
    else:
        return None
    return lambda wanted: frame_histograms(frames.read_colour(paths, wanted, read))


def write_video_scores(spark: SparkSession, video: str, out: str | None) -> int:
    name = os.path.splitext(os.path.basename(video))[0]
    paths = spark.createDataFrame([(name, os.path.abspath(video))], "series_id string, path string")
    rate = frames.durations(frames.read_metadata(paths, containers.probe))
    scores = frame_scores(frames.gray_frames(y4m.read_y4m(paths)), rate)
    named = scores.select(F.col("frame").alias("Frame"), F.col("time_sec").alias("Time_Sec"), F.col("score").cast("long").alias("Difference_Score"))
    return files.write_report(named, out or f"{name}.csv", ("Frame", "Time_Sec", "Difference_Score"), "Frame")


def rate_of(video: str) -> float:
    return containers.probe(video)[0]


def main(args: Sequence[str] | None = None) -> int:
    given = _parser().parse_args(args)
    spark = local_session()
    if given.command == "scores":
        print(f"{write_video_scores(spark, given.video, given.out)} frames")
        return 0
    path = given.scores or first_scores()
    scores = check_contiguous(read_scores(spark, os.path.abspath(path) if os.path.exists(path) else path))
    if given.command == "top":
        top_scores(scores).show(truncate=False)
        return 0
    sources = video_path(spark, scores, given.video)
    known = frames.read_metadata(sources, containers.probe)
    stated = known.where("fps > 0").select("series_id", "fps").collect()  # the one video's
    config = SegmentConfig(manual_threshold=given.threshold, boundary=given.boundary, similarity=given.similarity)
    container_fps = spark.createDataFrame(stated, "series_id string, fps double") if stated else None
    done = segment(scores, config, features_of(spark, sources, given.video, given.reader), container_fps)
    rate = container_fps if stated else done.fps
    done.coverage.show(truncate=False)
    os.makedirs(given.out, exist_ok=True)
    if given.command == "segment":
        count = files.write_segments(done.rows, os.path.join(given.out, "segments.csv"))
        total = frames.durations(known, scores).first()["duration_sec"]
        files.write_viewer(done.rows, os.path.join(given.out, "viewer.html"), total, given.video)
        print(f"{count} segments")
        return 0
    plan = clips.clip_plan(done.segments, rate)
    frame_by_frame = clips.FrameCutter(y4m.raw_frame, y4m.write_raw, rate=rate_of)
    uncompressed = bool(y4m.raw_frame(given.video, 0))
    if given.command == "export" and uncompressed and not find_program("ffmpeg"):
        joined = clips.join_frames(done.segments, sources, given.out, frame_by_frame, "joined.y4m").collect()  # the one video's
        print("\n".join(f"{r['series_id']}: {r['frames']} frames" for r in joined))
        return 0 if any(r["joined"] for r in joined) else 1
    cutter = clips.FirstThatWorks((clips.FfmpegCutter(), *[frame_by_frame] * uncompressed))
    if given.command == "export":
        said = run_text([clips.FfmpegCutter().program, "-hide_banner", "-encoders"])
        encoders = [choose_encoder(said), *SOFTWARE_ENCODERS]
        devices = parse_devices(device_lines(spark, run_text(LIST_DEVICES)))
        shared = None if devices.isEmpty() else devices
        exported = clips.export(plan, sources, given.out, cutter, list(dict.fromkeys(encoders)), tasks=given.workers, devices=shared).collect()
        for r in exported:
            print(f"{r['series_id']}: {r['cut']} cut, {r['failed']} failed, {'joined' if r['joined'] else r['error']}")
        return 0 if any(r["joined"] for r in exported) else 1
    results = clips.cut_clips(plan, sources, given.out, cutter, SOFTWARE_ENCODERS, given.workers).persist()
    count = files.write_clip_index(clips.clip_index(plan, results), os.path.join(given.out, "clips.csv"))
    clips.outcome(results).show()
    return 0 if count else 1


if __name__ == "__main__":
    raise SystemExit(main())
