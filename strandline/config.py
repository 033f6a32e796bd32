"""Settings of a segmentation, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SegmentConfig:
    """Lengths in seconds; ``frames`` turns them into frames at a rate, cut off to whole ones."""

    smooth_sec: float = 0.5
    merge_gap_sec: float = 1.5
    min_length_sec: float = 2.5
    #: Segments less similar to the anchors are dropped; 0 or less keeps all.
    similarity: float = 0.7
    anchors: int = 5
    #: A threshold in score units; None finds one by the mixture.
    manual_threshold: float | None = None
    #: "compat" or "equal_density", see ``operators.mixture``.
    boundary: str = "compat"
    #: Frames that one task smooths at once; long series are dealt out in chunks of it.
    chunk_frames: int = 1 << 18

    def frames(self, fps: float) -> WindowFrames:
        return WindowFrames(
            smooth=max(1, int(fps * self.smooth_sec)),
            merge_gap=int(fps * self.merge_gap_sec),
            min_length=int(fps * self.min_length_sec),
            chunk=self.chunk_frames,
        )

    def frame_columns(self, fps: Column) -> list[Column]:
        """``smooth, merge_gap, min_length`` of ``frames``, for a column of rates."""
        whole = {"smooth": self.smooth_sec, "merge_gap": self.merge_gap_sec, "min_length": self.min_length_sec}
        return [F.greatest((fps * F.lit(float(sec))).cast("int"), F.lit(1 if name == "smooth" else 0)).alias(name) for name, sec in whole.items()]


@dataclass(frozen=True)
class WindowFrames:
    """The same lengths in frames."""

    smooth: int
    merge_gap: int
    min_length: int
    chunk: int = 1 << 18

    @property
    def preceding(self) -> int:
        return self.smooth - 1 - self.following

    @property
    def following(self) -> int:
        """A centred window of an even length reaches one row further back than ahead."""
        return (self.smooth - 1) // 2
