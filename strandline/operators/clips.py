"""Plans for cutting clips, and carrying them out.

Cutting is a side effect in tasks. A task may run twice, so a cutter writes to
a name of its own and renames; names depend on the series and segment only, and
each series has a folder of its own. A series is done once its manifest is
there, which is renamed to its place after the joined file; clips are removed
only then. What runs again after that finds the manifest and does nothing.
"""

from __future__ import annotations

import json
import os
import subprocess
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import groupby
from typing import Any
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import clip_name, seconds
from strandline.sources.devices import ENCODER_OPTIONS, find_program

RESULT = "series_id string, seg_index long, clip string, ok boolean, error string"

#: From (source, start, duration, target, encoder) to whether it worked and what was said.
Cutter = Callable[[str, float, float, str, str], tuple[bool, str]]


def clip_plan(segments: DataFrame, fps: DataFrame, first_number: int = 1) -> DataFrame:
    """``series_id, seg_index, clip, start_frame, end_frame, start_sec, end_sec, duration_sec``, one row for each clip."""
    rate = F.col("fps")
    number = F.col("seg_index") - 1 + first_number
    return segments.join(fps.select("series_id", "fps"), "series_id").select(
        "series_id",
        "seg_index",
        clip_name(number).alias("clip"),
        "start_frame",
        "end_frame",
        F.round(seconds(F.col("start_frame"), rate), 4).alias("start_sec"),
        F.round(seconds(F.col("end_frame"), rate), 4).alias("end_sec"),
        F.round(seconds(F.col("end_frame") - F.col("start_frame"), rate), 4).alias("duration_sec"),
    )


def with_devices(plan: DataFrame, devices: DataFrame, chunk: int = 4096) -> DataFrame:
    """Adds ``device``: each of ``devices`` (``device, free_mb``) gets clips of a total length in proportion to its free memory.

    Clips lie end to end on a line that the devices share out, and a clip goes
    to the device its middle lies in: no device is off its share by more than
    its two outermost clips' halves. Lengths are summed by chunks of clips first; only a
    row for each chunk is summed in one task. Without devices, ``device`` is null.
    """
    length = F.greatest("duration_sec", F.lit(0.0))
    dealt = plan.withColumn("__chunk", F.floor(F.col("seg_index") / chunk))
    sums = dealt.groupBy("series_id", "__chunk").agg(F.sum(length).alias("s"))
    order = Window.orderBy("series_id", "__chunk")
    starts = sums.select("series_id", "__chunk", (F.sum("s").over(order) - F.col("s")).alias("__start"), F.sum("s").over(Window.partitionBy()).alias("__total"))
    within = F.sum(length).over(Window.partitionBy("series_id", "__chunk").orderBy("seg_index").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("__within", within - length / 2).join(starts, ["series_id", "__chunk"])
    placed = placed.withColumn("__at", F.coalesce(F.try_divide(F.col("__start") + F.col("__within"), "__total"), F.lit(0.0)))
    weight, line = F.greatest("free_mb", F.lit(1)), Window.orderBy("device")
    upto = F.sum(weight).over(line) / F.sum(weight).over(Window.partitionBy())
    shares = devices.select("device", upto.alias("high"))
    shares = shares.select("device", F.coalesce(F.lag("high").over(line), F.lit(-1.0)).alias("low"), F.when(F.lead("high").over(line).isNull(), 2.0).otherwise(F.col("high")).alias("high"))
    # A row for each device of the machines.
    joined = placed.join(F.broadcast(shares), (F.col("__at") >= F.col("low")) & (F.col("__at") < F.col("high")), "left")
    return joined.select(*plan.columns, "device")


def clip_frames(segments: DataFrame) -> DataFrame:
    """``series_id, seg_index, frame`` for every frame of every segment, both ends included."""
    return segments.select("series_id", "seg_index", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))


@dataclass(frozen=True)
class FfmpegCutter:
    """Cuts by the ffmpeg program; a time-out or failure is a result, not an error."""

    program: str = field(default_factory=lambda: find_program("ffmpeg") or "ffmpeg")
    timeout: float = 300.0
    said: int = 300
    #: The graphics device that the program sees; all if it is None.
    device: int | None = None

    def on(self, device: int | None) -> FfmpegCutter:
        return replace(self, device=device)

    def command(self, source: str, start: float, duration: float, target: str, encoder: str) -> list[str]:
        options = ENCODER_OPTIONS.get(encoder, ())
        return [self.program, "-y", "-i", source, "-ss", f"{start:.6f}", "-t", f"{duration:.6f}", "-c:v", encoder, *options, "-c:a", "aac", target]

    def __call__(self, source: str, start: float, duration: float, target: str, encoder: str) -> tuple[bool, str]:
        part = part_of(target)
        seen = {} if self.device is None else {"CUDA_VISIBLE_DEVICES": str(self.device)}
        try:
            done = subprocess.run(self.command(source, start, duration, part, encoder), capture_output=True, text=True, timeout=self.timeout, check=False, env=os.environ | seen)
            if done.returncode == 0:
                os.replace(part, target)
            return done.returncode == 0, done.stderr[-self.said :]
        except (OSError, subprocess.SubprocessError) as error:
            return False, str(error)[-self.said :]
        finally:
            if os.path.exists(part):
                os.remove(part)


def part_of(target: str) -> str:
    """A name beside ``target`` that no other attempt, on any host, writes to."""
    folder, name = os.path.split(target)
    return os.path.join(folder, f".{uuid.uuid4().hex}-{name}")


@dataclass(frozen=True)
class FrameCutter:
    """Cuts frame by frame with a decoder and a writer that are passed in, where there is no ffmpeg.

    ``read`` gives a source's frame by number, or None where reading fails,
    which ends the clip; ``write`` gets a target, frames and their rate. Both
    end frames belong to the clip. It worked if any frame was written. ``rate``
    gives a source's rate, and ``fps`` is that of sources it knows none of.
    """

    read: Callable[[str, int], Any]
    write: Callable[[str, Iterable[Any], float], None]
    fps: float = 30.0
    rate: Callable[[str], float] | None = None

    def rate_of(self, source: str) -> float:
        return (self.rate(source) if self.rate else 0.0) or self.fps

    def __call__(self, source: str, start: float, duration: float, target: str, encoder: str) -> tuple[bool, str]:
        fps = self.rate_of(source)
        first = round(start * fps)
        written = 0

        def frames() -> Iterator[Any]:
            nonlocal written
            for n in range(first, first + round(duration * fps) + 1):
                frame = self.read(source, n)
                if frame is None:
                    return
                written += 1
                yield frame

        part = part_of(target)
        self.write(part, frames(), fps)
        if written:
            os.replace(part, target)
        elif os.path.exists(part):
            os.remove(part)
        return written > 0, "" if written else "no frame could be read"


@dataclass(frozen=True)
class FirstThatWorks:
    """Tries cutters in turn, such as ffmpeg and then frame by frame."""

    cutters: tuple[Cutter, ...]

    def on(self, device: int | None) -> FirstThatWorks:
        return FirstThatWorks(tuple(on_device(c, device) for c in self.cutters))

    def __call__(self, source: str, start: float, duration: float, target: str, encoder: str) -> tuple[bool, str]:
        said = []
        for cut in self.cutters:
            ok, words = cut(source, start, duration, target, encoder)
            if ok:
                return True, words
            said.append(words)
        return False, "; ".join(said)


def on_device(cut: Cutter, device: int | None) -> Cutter:
    """The same cutter for a device, if it has a choice of them."""
    return cut.on(device) if device is not None and hasattr(cut, "on") else cut


def write_whole(path: str, text: str) -> None:
    """A file that is there as a whole or not at all."""
    part = part_of(path)
    with open(part, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(part, path)


def manifest_path(folder: str, series_id: str | None) -> str:
    return os.path.join(folder, ".done", f"{os.path.basename(series_folder(folder, series_id))}.json")


def read_manifest(path: str, plan: int | None) -> dict | None:
    """What was done for a series, if it was done by this plan."""
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError):
        return None
    return found if plan is not None and found.get("plan") == plan else None


def series_folder(folder: str, series_id: str | None) -> str:
    """Where a series has its clips."""
    return os.path.join(folder, quote(series_id or "", safe=" ").replace(".", "%2E") or "%")


def cut_clips(plan: DataFrame, sources: DataFrame, folder: str, cut: Cutter, encoders: Sequence[str], tasks: int = 8) -> DataFrame:
    """``series_id, seg_index, clip, ok, error``: each planned clip cut by the first encoder that works, into its series' folder.

    ``sources`` has ``series_id, path``. A ``device`` of the plan is given to
    the cutter; a device's clips are dealt to tasks of its own, longest first.
    Clips of a series that is done by this plan (column ``plan``) aren't cut again.
    """
    has_device, has_plan = "device" in plan.columns, "plan" in plan.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                ok, said = False, "no encoder"
                target = series_folder(folder, r.series_id)
                done = read_manifest(manifest_path(folder, r.series_id), r.plan if has_plan else None)
                if done is not None:
                    said = done["errors"].get(r.clip)
                    rows.append((r.series_id, r.seg_index, r.clip, said is None, said))
                    continue
                os.makedirs(target, exist_ok=True)
                own = on_device(cut, int(r.device)) if has_device and pd.notna(r.device) else cut
                for encoder in encoders:
                    ok, said = own(r.path, r.start_sec, r.duration_sec, os.path.join(target, r.clip), encoder)
                    if ok:
                        break
                rows.append((r.series_id, r.seg_index, r.clip, ok, None if ok else said))
            yield pd.DataFrame(rows, columns=["series_id", "seg_index", "clip", "ok", "error"])

    more = [c for c in ("device", "plan") if c in plan.columns]
    planned = plan.join(sources, "series_id").select("series_id", "seg_index", "clip", "path", "start_sec", "duration_sec", *more)
    dealt = planned.repartition(tasks, *["device"] * has_device, "series_id", "seg_index").sortWithinPartitions(F.desc("duration_sec"))
    return dealt.mapInPandas(run, RESULT)


def clip_index(plan: DataFrame, results: DataFrame) -> DataFrame:
    """The plan's rows of clips that were cut, in order."""
    done = results.where("ok").select("series_id", "seg_index")
    kept = plan.join(done, ["series_id", "seg_index"], "left_semi")
    return kept.orderBy("series_id", "seg_index").select("series_id", "clip", "start_frame", "end_frame", "start_sec", "end_sec", "duration_sec")


def outcome(results: DataFrame) -> DataFrame:
    return results.groupBy("series_id").agg(F.count_if("ok").alias("cut"), F.count_if(~F.col("ok")).alias("failed"))


def concat_list(index: DataFrame) -> DataFrame:
    """``series_id, listing``: a line ``file '<clip>'`` for each clip, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("start_frame", "clip")))
    lines = F.transform(ordered, lambda c: F.concat(F.lit("file '"), F.replace(c["clip"], F.lit("'"), F.lit("'\\''")), F.lit("'")))
    return index.groupBy("series_id").agg(F.concat_ws("\n", lines).alias("listing"))


def join_clips(listing_path: str, target: str, program: str | None = None, timeout: float | None = None) -> tuple[bool, str]:
    """Joins listed clips without encoding again; ``target`` is there only once it is whole."""
    part = part_of(target)
    command = [program or find_program("ffmpeg") or "ffmpeg", "-y", "-f", "concat", "-safe", "0", "-i", listing_path, "-c", "copy", part]
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=False)
        if done.returncode == 0:
            os.replace(part, target)
        return done.returncode == 0, done.stderr[-300:]
    except (OSError, subprocess.SubprocessError) as error:
        return False, str(error)
    finally:
        if os.path.exists(part):
            os.remove(part)


#: From (listing, target) to whether joining worked and what was said.
Joiner = Callable[[str, str], tuple[bool, str]]


def _finish(series_id: str, part: pd.DataFrame, folder: str, join: Joiner, keep_clips: bool, name: str) -> tuple[int, int, bool, str | None]:
    """Joins a series' clips: how many were cut and failed, whether they were joined, and what was said otherwise."""
    target, manifest, plan = series_folder(folder, series_id), manifest_path(folder, series_id), int(part["plan"].iloc[0])
    done = read_manifest(manifest, plan)
    if done is None:
        cut = part[part["ok"]].sort_values("seg_index")
        failed = part[~part["ok"].astype(bool)]
        if not len(cut):
            return 0, len(failed), False, "no clip was cut"
        listing = os.path.join(target, "clips.txt")
        write_whole(listing, "".join("file '" + clip.replace("'", "'\\''") + "'\n" for clip in cut["clip"]))
        joined, said = join(listing, os.path.join(target, name))
        if not joined:
            return len(cut), len(failed), False, said
        done = {"plan": plan, "clips": cut["clip"].tolist(), "errors": dict(zip(failed["clip"], failed["error"].fillna(""), strict=True))}
        os.makedirs(os.path.dirname(manifest), exist_ok=True)
        write_whole(manifest, json.dumps(done))
    if not keep_clips:
        for path in ["clips.txt", *done["clips"]]:
            if os.path.exists(os.path.join(target, path)):
                os.remove(os.path.join(target, path))
    return len(done["clips"]), len(done["errors"]), True, None


def export(
    plan: DataFrame,
    sources: DataFrame,
    folder: str,
    cut: Cutter,
    encoders: Sequence[str],
    join: Joiner = join_clips,
    tasks: int = 8,
    keep_clips: bool = True,
    name: str = "joined.mp4",
    devices: DataFrame | None = None,
) -> DataFrame:
    """Cuts all clips, writes each series' listing, and joins its clips: ``series_id, cut, failed, joined, error``.

    The encoders are tried in turn for each clip. ``folder`` is one that all
    executors share. Clips that were joined are removed unless ``keep_clips``;
    those of a series that couldn't be joined stay. Tasks that run again, and
    the result read again, give the same rows and cut nothing again.
    """
    each = F.xxhash64("clip", "start_frame", "end_frame", "start_sec", "duration_sec")
    whole = plan.groupBy("series_id").agg(F.xxhash64(F.bit_xor(each), F.count("*")).alias("plan"))
    marked = plan.join(whole, "series_id")
    if devices is not None:
        marked = with_devices(marked, devices)
    results = cut_clips(marked, sources, folder, cut, encoders, tasks).join(whole, "series_id")

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        series_id = part["series_id"].iloc[0]
        return pd.DataFrame([(series_id, *_finish(series_id, part, folder, join, keep_clips, name))], columns=["series_id", "cut", "failed", "joined", "error"])

    return results.groupBy("series_id").applyInPandas(finish, "series_id string, cut long, failed long, joined boolean, error string")


def join_frames(segments: DataFrame, sources: DataFrame, folder: str, cutter: FrameCutter, name: str = "joined.mp4") -> DataFrame:
    """One file for each series with the frames of all its segments, in order: ``series_id, frames, joined``.

    Both end frames of a segment count. A frame that can't be read ends its
    segment; the next one goes on. Segments come in sorted batches and frames one by one, so
    neither is held as a whole. A series none of whose frames can be read has no file.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for part in parts for r in part.itertuples())
        for series_id, own in groupby(each, key=lambda r: r.series_id):
            written, first = 0, next(own)

            def frames(first=first, own=own) -> Iterator[Any]:
                nonlocal written
                r = first
                while r is not None:
                    for n in range(r.start_frame, r.end_frame + 1):
                        frame = cutter.read(r.path, n)
                        if frame is None:
                            break
                        written += 1
                        yield frame
                    r = next(own, None)

            target = series_folder(folder, series_id)
            os.makedirs(target, exist_ok=True)
            part = part_of(os.path.join(target, name))
            cutter.write(part, frames(), cutter.rate_of(first.path))
            if written:
                os.replace(part, os.path.join(target, name))
            elif os.path.exists(part):
                os.remove(part)
            yield pd.DataFrame([(series_id, written, written > 0)], columns=["series_id", "frames", "joined"])

    planned = segments.join(sources, "series_id").select("series_id", "path", "start_frame", "end_frame")
    dealt = planned.repartition("series_id").sortWithinPartitions("series_id", "start_frame")
    return dealt.mapInPandas(rows, "series_id string, frames long, joined boolean")
