"""Segments from streams of scores.

Frames of a series come in order, as a decoder makes them. The state of a
series is its last scores, as many as a smoothing window has, and the segment
that is open; it does not grow with the series. Smoothing looks ahead, so
segments come out late by half a window and the longest gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.config import WindowFrames

OUTPUT = "series_id string, start_frame long, end_frame long"
STATE = "scores array<double>, next_frame long, start long, last_low long"


class OnlineSegmenter:
    """Takes the scores of one series in order and gives segments once they are closed."""

    def __init__(self, threshold: float, frames: WindowFrames, state: tuple | None = None):
        self.threshold, self.frames = threshold, frames
        scores, self.next_frame, start, last = state or ([], 0, -1, -1)
        self.scores = list(scores)
        self.start, self.last_low = start, last

    def state(self) -> tuple:
        return self.scores, self.next_frame, self.start, self.last_low

    def _close(self, end: int) -> list[tuple[int, int]]:
        found = [(self.start, end)] if end - self.start >= self.frames.min_length else []
        self.start = -1
        return found

    def _smoothed(self, frame: int, value: float | None) -> list[tuple[int, int]]:
        if value is not None and value < self.threshold:
            self.start = frame if self.start < 0 else self.start
            self.last_low = frame
        elif self.start >= 0 and frame - self.last_low > self.frames.merge_gap:
            return self._close(self.last_low)
        return []

    def _median(self, frame: int) -> float | None:
        first = self.next_frame - len(self.scores)
        low, high = max(first, frame - self.frames.preceding), frame + self.frames.following + 1
        some = [s for s in self.scores[low - first : high - first] if s is not None and s == s]
        return median(some) if some else None

    def add(self, score: float | None) -> list[tuple[int, int]]:
        self.scores.append(score)
        self.next_frame += 1
        frame = self.next_frame - 1 - self.frames.following
        found = self._smoothed(frame, self._median(frame)) if frame >= 0 else []
        del self.scores[: max(0, len(self.scores) - self.frames.smooth)]
        return found

    def finish(self) -> list[tuple[int, int]]:
        """What the end of the series closes; an open segment then ends with the series."""
        found = []
        for frame in range(max(0, self.next_frame - self.frames.following), self.next_frame):
            found += self._smoothed(frame, self._median(frame))
        last = self.next_frame - 1
        return found + (self._close(last if last - self.last_low <= self.frames.merge_gap else self.last_low) if self.start >= 0 else [])


def stream_segments(scores: DataFrame, threshold: float, frames: WindowFrames, idle: str | None = None) -> DataFrame:
    """``series_id, start_frame, end_frame`` of closed segments, from a stream of ``series_id, frame, score``.

    A frame that was there already is skipped; a frame that was left out is an
    error. A series without new frames for ``idle`` (such as ``"10 minutes"``)
    is at its end.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = OnlineSegmenter(threshold, frames, state.get if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            found = own.finish()
        else:
            found = []
            rows = pd.concat(list(parts)).sort_values("frame")
            for frame, score in zip(rows["frame"], rows["score"], strict=True):
                if frame > own.next_frame:
                    raise ValueError(f"series {key[0]} has no frame {own.next_frame}")
                if frame == own.next_frame:
                    found += own.add(None if pd.isna(score) else float(score))
            state.update(own.state())
            if idle:
                state.setTimeoutDuration(idle)
        if found:
            yield pd.DataFrame([(key[0], a, b) for a, b in found], columns=["series_id", "start_frame", "end_frame"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return scores.select("series_id", "frame", "score").groupBy("series_id").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)


def windowed_activity(scores: DataFrame, threshold: float, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``series_id, window, frames, low_frames`` by event time (column ``ts``), for a stream or a table.

    Rows later than ``late`` are left out of a stream.
    """
    timed = scores.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy("series_id", F.window("ts", length))
    return counts.agg(F.count("*").alias("frames"), F.count_if(F.col("score") < threshold).alias("low_frames"))
