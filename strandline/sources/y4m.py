"""Uncompressed video (Y4M) as a Spark source: a long file is read by many tasks, each a stretch of frames.

>>> spark.dataSource.register(Y4mSource)
>>> spark.read.format("y4m").option("paths", json.dumps([["match", "/videos/match.y4m"]])).load()

All frames of a file have one size, so a frame's place follows from its number.
A frame that is cut short at the end of a file isn't there.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strandline.functions.colour import bgr_of_yuv
from strandline.sources.containers import file_size, opened
from strandline.sources.frames import COLOUR_SCHEMA

MAGIC = b"YUV4MPEG2"
MARK = b"FRAME\n"
#: For each kind of chroma how many pixels one value spans, across and down.
CHROMA = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "mono": None}


@dataclass(frozen=True)
class Y4m:
    """The header of a file: sizes, rate, chroma, and where frames begin."""

    width: int
    height: int
    fps: float
    chroma: str
    start: int
    size: int

    @classmethod
    def of(cls, file: BinaryIO) -> Y4m:
        line = file.read(4096).partition(b"\n")[0]
        words = line.decode("ascii", "replace").split(" ")
        if not line.startswith(MAGIC):
            raise ValueError("no Y4M file")
        told = {w[0]: w[1:] for w in words[1:] if w}
        rate, _, per = told.get("F", "0:1").partition(":")
        chroma = next((c for c in CHROMA if told.get("C", "420").startswith(c)), None)
        if chroma is None or not told.get("W") or not told.get("H") or "p1" in told.get("C", ""):
            raise ValueError(f"can't read {line!r}")
        return cls(int(told["W"]), int(told["H"]), int(rate) / int(per) if int(per or 0) else 0.0, chroma, len(line) + 1, file_size(file))

    @property
    def planes(self) -> list[tuple[int, int]]:
        """Width and height of each plane."""
        spans = CHROMA[self.chroma]
        small = [] if spans is None else [(-(-self.width // spans[0]), -(-self.height // spans[1]))] * 2
        return [(self.width, self.height), *small]

    @property
    def frame_bytes(self) -> int:
        return len(MARK) + sum(w * h for w, h in self.planes)

    @property
    def count(self) -> int:
        return max(0, (self.size - self.start) // self.frame_bytes)

    def frame(self, file: BinaryIO, number: int) -> bytes | None:
        """The pixels of a frame as blue, green and red; None if there is no such frame."""
        if not 0 <= number < self.count:
            return None
        file.seek(self.start + number * self.frame_bytes)
        data = file.read(self.frame_bytes)
        if not data.startswith(MARK):
            raise ValueError("frames with parameters of their own can't be read")
        at, planes = len(MARK), []
        for w, h in self.planes:
            planes.append(np.frombuffer(data, np.uint8, w * h, at).reshape(h, w))
            at += w * h
        if len(planes) == 1:
            planes += [np.full_like(planes[0], 128)] * 2
        else:
            across, down = CHROMA[self.chroma]
            planes[1:] = [p.repeat(down, axis=0).repeat(across, axis=1)[: self.height, : self.width] for p in planes[1:]]
        return bgr_of_yuv(*planes)


def read_frame(path: str, number: int) -> tuple[int, int, bytes] | None:
    """A ``Reader`` for ``sources.frames.read_colour``; a file that can't be read has no frames."""
    try:
        with opened(path) as file:
            video = Y4m.of(file)
            found = video.frame(file, number)
    except (OSError, ValueError):
        return None
    return None if found is None else (video.width, video.height, found)


def raw_frame(path: str, number: int) -> tuple[str, bytes] | None:
    """A frame as it lies in its file, with the header that belongs to it, for ``write_raw``; None if there is none."""
    try:
        with opened(path) as file:
            video = Y4m.of(file)
            if not 0 <= number < video.count:
                return None
            file.seek(0)
            header = file.read(video.start).decode("ascii")
            file.seek(video.start + number * video.frame_bytes)
            return header, file.read(video.frame_bytes)
    except (OSError, ValueError):
        return None


def write_raw(target: str, frames: Iterable[tuple[str, bytes]], fps: float) -> None:
    """Frames of ``raw_frame`` as a file, nothing lost; the first one's header holds for all."""
    with open(target, "wb") as out:
        for number, (header, frame) in enumerate(frames):
            if not number:
                out.write(header.encode("ascii"))
            out.write(frame)


@dataclass
class Stretch(InputPartition):
    series_id: str
    path: str
    first: int
    end: int


class Y4mReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["paths"])
        self.stretch_bytes = int(options.get("stretchBytes", 1 << 26))
        self.batch = int(options.get("batch", 16))

    def partitions(self) -> list[Stretch]:
        """Only headers are read here."""
        out = []
        for series_id, path in self.files:
            with opened(path) as file:
                video = Y4m.of(file)
            step = max(1, self.stretch_bytes // video.frame_bytes)
            out += [Stretch(series_id, path, a, min(a + step, video.count)) for a in range(0, video.count, step)]
        return out or [Stretch("", "", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.end:
            return
        with opened(partition.path) as file:
            video = Y4m.of(file)
            for a in range(partition.first, partition.end, self.batch):
                numbers = range(a, min(a + self.batch, partition.end))
                n = len(numbers)
                columns = [
                    pa.array([partition.series_id] * n, pa.string()),
                    pa.array(numbers, pa.int64()),
                    pa.array([video.width] * n, pa.int32()),
                    pa.array([video.height] * n, pa.int32()),
                    pa.array([video.frame(file, k) for k in numbers], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["series_id", "frame", "width", "height", "bgr"])


class Y4mSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return COLOUR_SCHEMA

    def reader(self, schema: StructType) -> Y4mReader:
        return Y4mReader(self.options)


def read_y4m(paths: DataFrame, stretch_bytes: int = 1 << 26) -> DataFrame:
    """Every frame of the files of ``paths`` (``series_id, path``), in colour; the driver plans by their headers."""
    spark = paths.sparkSession
    spark.dataSource.register(Y4mSource)
    files = [[r["series_id"], r["path"]] for r in paths.select("series_id", "path").toLocalIterator()]
    return spark.read.format("y4m").option("paths", json.dumps(files)).option("stretchBytes", str(stretch_bytes)).load()
