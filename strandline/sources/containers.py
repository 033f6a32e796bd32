"""Rate, number of frames and size of a video from its container's header, without a decoder.

Knows MP4 and QuickTime (boxes), AVI (chunks) and Y4M (a line of text). Only
headers are read, whatever the length of the file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

#: (rate, number of frames, width, height); zeros where nothing is known.
Metadata = tuple[float, int, int, int]
UNKNOWN: Metadata = (0.0, 0, 0, 0)


def opened(path: str) -> BinaryIO:
    """A file that can be sought in: a local one, or one of any store that Arrow knows by its address."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        path = "/" + rest.lstrip("/")
    elif rest.startswith("//"):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return open(path, "rb")


def file_size(file: BinaryIO) -> int:
    at = file.tell()
    size = file.seek(0, os.SEEK_END)
    file.seek(at)
    return size


def _boxes(file: BinaryIO, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of what each box holds, from here to ``end``; damaged sizes end it."""
    while (at := file.tell()) + 8 <= end:
        head = file.read(8)
        if len(head) < 8:
            return
        size, kind = struct.unpack(">I4s", head)
        begin = at + 8
        if size == 1:
            size = struct.unpack(">Q", file.read(8))[0]
            begin += 8
        stop = end if size == 0 else at + size
        if stop < begin or stop > end:
            return
        yield kind, begin, stop
        file.seek(stop)


def _inside(file: BinaryIO, begin: int, stop: int, path: tuple[bytes, ...]) -> Iterator[tuple[int, int]]:
    """Where boxes lie that are reached by the kinds of ``path``."""
    file.seek(begin)
    for kind, a, b in _boxes(file, stop):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from _inside(file, a, b, path[1:])


def _read(file: BinaryIO, span: tuple[int, int], most: int = 1 << 26) -> bytes:
    file.seek(span[0])
    return file.read(min(span[1] - span[0], most))


def _mp4(file: BinaryIO) -> Metadata:
    end = file_size(file)
    for track in _inside(file, 0, end, (b"moov", b"trak")):
        first = lambda *path, t=track: next(_inside(file, *t, path), None)
        handler, times = first(b"mdia", b"hdlr"), first(b"mdia", b"minf", b"stbl", b"stts")
        header, kinds = first(b"mdia", b"mdhd"), first(b"mdia", b"minf", b"stbl", b"stsd")
        if not (handler and times and header and kinds) or _read(file, handler)[8:12] != b"vide":
            continue
        head = _read(file, header)
        scale = struct.unpack_from(">I", head, 20 if head[0] == 1 else 12)[0]
        table = _read(file, times)
        runs = list(struct.iter_unpack(">II", table[8 : 8 + 8 * struct.unpack_from(">I", table, 4)[0]]))
        frames, ticks = sum(n for n, _ in runs), sum(n * d for n, d in runs)
        entry = _read(file, kinds)
        width, height = struct.unpack_from(">HH", entry, 8 + 32) if len(entry) >= 44 else (0, 0)
        return (frames * scale / ticks if ticks else 0.0), frames, width, height
    return UNKNOWN


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        yield kind, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def _avi(file: BinaryIO) -> Metadata:
    data = _read(file, (0, file_size(file)), 1 << 16)
    rate = frames = width = height = 0
    for kind, a, b in _chunks(data, 12, len(data)):
        if kind != b"LIST" or data[a : a + 4] != b"hdrl":
            continue
        for inner, c, d in _chunks(data, a + 4, b):
            if inner == b"avih" and d - c >= 40:
                micros, frames = struct.unpack_from("<I", data, c)[0], struct.unpack_from("<I", data, c + 16)[0]
                width, height = struct.unpack_from("<II", data, c + 32)
                rate = rate or (1e6 / micros if micros else 0)
            elif inner == b"LIST" and data[c : c + 4] == b"strl":
                for kind2, e, f in _chunks(data, c + 4, d):
                    if kind2 == b"strh" and data[e : e + 4] == b"vids" and f - e >= 36:
                        scale, per = struct.unpack_from("<II", data, e + 20)
                        rate = per / scale if scale else rate
                        frames = struct.unpack_from("<I", data, e + 32)[0] or frames
    return float(rate), frames, width, height


def probe(path: str) -> Metadata:
    """What a container says of its video; zeros for other files and damaged ones."""
    from strandline.sources.y4m import MAGIC, Y4m

    try:
        with opened(path) as file:
            start = file.read(12)
            file.seek(0)
            if start.startswith(MAGIC):
                video = Y4m.of(file)
                return video.fps, video.count, video.width, video.height
            if start[:4] == b"RIFF" and start[8:] == b"AVI ":
                return _avi(file)
            return _mp4(file)
    except (OSError, ValueError, struct.error):
        return UNKNOWN
