"""Audio features of byte payloads kept as 8-bit PCM.

A text's bytes, padded with spaces, are the samples of a mono WAV file. The
file is read back, resampled by a polyphase filter, cut into overlapping frames
of log-mel energies, and segmented by energy with hysteresis. Frames are stored
as fixed-shape Arrow tensors with the time span of each.

Defined results: a null text is an empty one; it gives one unit of padding.
Repeated rows are processed alike and all kept. Equal texts give equal bytes
and digests, as each is computed on its own: filters, spectra, mel bands and
energies are sums of whole numbers below 2^53, which any processor and any
order of adding work out alike. Long texts are processed in blocks of frames. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD_UNIT = 192
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 8000
    #: The resampled rate is ``rate * up / down``.
    up: int = 3
    down: int = 4
    #: Taps of the filter on each side, in samples of the lower rate.
    reach: int = 8
    frame: int = 150
    hop: int = 60
    fft: int = 256
    mels: int = 40
    #: Frames of a tensor.
    tensor_frames: int = 32
    #: Ten-thousandths of the median energy at which a segment begins (1 dB above it), and below which it ends.
    enter: int = 12_589
    leave: int = 10_000
    #: Frames computed at once.
    block_frames: int = 4096

    @property
    def new_rate(self) -> float:
        return self.rate * self.up / self.down

    @cached_property
    def phases(self) -> np.ndarray:
        """The low-pass filter by phase: a windowed sinc in 1024ths, each row reversed for a dot product with samples."""
        cut = 1.0 / max(self.up, self.down)
        half = self.reach * max(self.up, self.down)
        half += -half % self.up
        t = np.arange(-half, half + self.up)
        taps = np.sinc(cut * t) * cut * self.up * np.where(np.abs(t) <= half, 0.5 + 0.5 * np.cos(np.pi * t / (half + 1)), 0)
        return np.ascontiguousarray(np.rint(taps.reshape(-1, self.up).T[:, ::-1] * 1024))

    @property
    def lead(self) -> int:
        """Samples before an output's base sample that its filter reads."""
        half = self.reach * max(self.up, self.down)
        return self.phases.shape[1] - 1 - (half + -half % self.up) // self.up

    @cached_property
    def filterbank(self) -> np.ndarray:
        """Triangles evenly spaced in mel, each overlapping its neighbours by half, in 256ths."""
        top = 2595 * np.log10(1 + self.new_rate / 2 / 700)
        edges = 700 * (10 ** (np.linspace(0, top, self.mels + 2) / 2595) - 1)
        f = np.linspace(0, self.new_rate / 2, self.fft // 2 + 1)[:, None]
        rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
        fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
        return np.rint(256 * np.maximum(0, np.minimum(rise, fall)))

    @cached_property
    def waves(self) -> np.ndarray:
        """Cosines of each frequency, then sines, under a Hann window, in 4096ths."""
        angle = 2 * np.pi * np.outer(np.arange(self.frame), np.arange(self.fft // 2 + 1)) / self.fft
        return np.rint(4096 * np.hanning(self.frame)[:, None] * np.concatenate([np.cos(angle), np.sin(angle)], axis=1))

    @cached_property
    def sixteenths(self) -> np.ndarray:
        """Where the logarithm to base 2 passes the next sixteenth, from a half to one."""
        return np.exp2(np.arange(1, 16) / 16 - 1)


def payload_of_text(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % PAD_UNIT or (0 if raw else PAD_UNIT))


def wav(payload: bytes, rate: int) -> bytes:
    """A mono WAV file of unsigned 8-bit samples, one for each byte."""
    header = HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return header + payload


def payload_of_wav(media: bytes) -> bytes:
    """The samples of a WAV file, found through its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def resampled(samples: np.ndarray, a: int, b: int, config: AudioConfig) -> np.ndarray:
    """Outputs ``a`` to ``b`` of the polyphase resampler, times 16; samples beyond the ends are zero."""
    out = np.zeros(b - a)
    width = config.phases.shape[1]
    for phase in range(config.up):
        # Output m stands at sample m * down / up; those with one phase are ``up`` apart and share a filter.
        first = next(m for m in range(a, a + config.up) if m * config.down % config.up == phase)
        if first >= b:
            continue
        count = -(-(b - first) // config.up)
        base = first * config.down // config.up - config.lead
        end = base + (count - 1) * config.down + width
        part = samples[max(0, base) : max(0, min(end, len(samples)))]
        part = np.pad(part, (min(max(0, -base), end - base - len(part)), 0))
        part = np.pad(part, (0, end - base - len(part)))
        out[first - a :: config.up] = sliding_window_view(part, width)[:: config.down] @ config.phases[phase]
    return np.floor((out + 32) / 64)


def log_mel(payload: bytes, config: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame the log-mel energies, in sixteenths of powers of two, and the energy; whole numbers.

    Numbers are doubles for the sake of fast products. Samples have 8 bits, so
    resampled ones have 13, spectra 20 after the shift, and powers of all bands
    together less than 2^50.
    """
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.float64) - 128
    total = -(-len(samples) * config.up // config.down)
    frames = 1 + max(0, -(-(total - config.frame) // config.hop))
    mel = np.empty((frames, config.mels), dtype=np.int16)
    energy = np.empty(frames, dtype=np.int64)
    half = config.waves.shape[1] // 2
    for a in range(0, frames, config.block_frames):
        b = min(frames, a + config.block_frames)
        start, end = a * config.hop, (b - 1) * config.hop + config.frame
        sound = np.pad(resampled(samples, start, min(end, total), config), (0, max(0, end - total)))
        cut = np.ascontiguousarray(sliding_window_view(sound, config.frame)[:: config.hop])
        energy[a:b] = np.einsum("ij,ij->i", cut, cut)
        both = np.floor((cut @ config.waves + 2048) / 4096)
        power = np.floor((both[:, :half] ** 2 + both[:, half:] ** 2) / 64)
        part, exponent = np.frexp(power @ config.filterbank + 1)
        mel[a:b] = 16 * (exponent - 1) + np.searchsorted(config.sixteenths, part, side="right")
    return mel, energy


def active_frames(energy: np.ndarray, enter: float, leave: float) -> np.ndarray:
    """Where a segment is on: from a frame at ``enter`` or more until one below ``leave``."""
    sign = np.where(energy >= enter, 1, np.where(energy < leave, -1, 0))
    last = np.maximum.accumulate(np.where(sign != 0, np.arange(len(sign)), -1))
    return (last >= 0) & (sign[last] > 0)


def borders(active: np.ndarray) -> np.ndarray:
    """First and last frame of each segment."""
    edge = np.diff(np.r_[0, active.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1], axis=1)


def segments(active: np.ndarray, config: AudioConfig) -> list[tuple[float, float]]:
    step, length = config.hop / config.new_rate, config.frame / config.new_rate
    return [(round(a * step, 4), round(b * step + length, 4)) for a, b in borders(active).tolist()]


def tensors(mel: np.ndarray, config: AudioConfig) -> pa.RecordBatch:
    """The frames as tensors of one shape, the last filled up with silence; with time spans and frame counts."""
    size, step = config.tensor_frames, config.hop / config.new_rate
    count = -(-len(mel) // size)
    full = np.zeros((count * size, config.mels), dtype=np.float32)
    full[: len(mel)] = mel / np.float32(16)
    cube = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(count, size, config.mels))
    first = np.arange(count) * size
    frames = np.minimum(size, len(mel) - first)
    spans = [first * step, (first + frames - 1) * step + config.frame / config.new_rate]
    return pa.RecordBatch.from_arrays([cube, *[pa.array(np.round(s, 6)) for s in spans], pa.array(frames, pa.int32())], ["log_mel", "start_s", "end_s", "frames"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(stored: bytes) -> pa.Table:
    """What ``to_ipc`` stored; column ``log_mel`` is a fixed-shape tensor array again."""
    return pa.ipc.open_stream(stored).read_all()


MEDIA = (
    "doc_id long, n_bytes long, media binary, tensors binary, frames long, mels int, "
    "segments array<struct<start_s: double, end_s: double>>, tensors_sha256 string, feature string"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("media", pa.binary()),
        ("tensors", pa.binary()),
        ("frames", pa.int64()),
        ("mels", pa.int32()),
        ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
        ("tensors_sha256", pa.string()),
        ("feature", pa.string()),
    ]
)
#: Bytes of results that are handed on at once.
AT_ONCE = 8_000_000


def features_of(text: str | None, config: AudioConfig) -> tuple:
    """The columns of ``MEDIA`` but the id, for one text."""
    media = wav(payload_of_text(text), config.rate)
    payload = payload_of_wav(media)
    mel, energy = log_mel(payload, config)
    # The lower median, and thresholds in ten-thousandths: whole numbers throughout.
    middle = int(np.partition(energy, (len(energy) - 1) // 2)[(len(energy) - 1) // 2])
    on = active_frames(energy * 10_000, middle * config.enter, middle * config.leave)
    spans = [{"start_s": a, "end_s": b} for a, b in segments(on, config)]
    digest = hashlib.sha256(mel.astype("<i2").tobytes() + borders(on).astype("<i8").tobytes()).hexdigest()
    feature = f"{len(mel)}:{config.mels}:{digest}"
    stored = to_ipc(tensors(mel, config))
    return len((text or "").encode()), media, stored, len(mel), config.mels, spans, hashlib.sha256(stored).hexdigest(), feature


def audio_features(docs: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """For each row of ``docs`` the WAV bytes, the feature tensors as an Arrow stream, and the active segments."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = features_of(text.as_py(), config)
                rows.append((doc_id.as_py(), *found))
                held += len(found[1]) + len(found[2])
                if held > AT_ONCE:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, MEDIA)
