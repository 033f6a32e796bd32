"""Frames, their colours, containers and the command line, from files made by hand."""

import colorsys
import csv
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.functions import colour
from strandline.operators import features
from strandline.sources import containers, frames, y4m


def test_colours_pixel_by_pixel():
    """Whole-number colours against the same sums done one pixel at a time, and against real-valued ones."""
    rng = np.random.default_rng(5)
    bgr = np.r_[rng.integers(0, 256, (3000, 3)), np.repeat(np.arange(0, 256, 5)[:, None], 3, axis=1), [[0, 0, 1], [255, 0, 254], [1, 0, 255]]].astype(np.uint8)
    hue, saturation = colour.hue_saturation(bgr.tobytes())
    grays = np.frombuffer(colour.gray(bgr.tobytes()), np.uint8)
    for (b, g, r), h, s, y in zip(bgr.tolist(), hue.tolist(), saturation.tolist(), grays.tolist(), strict=True):
        most, least = max(b, g, r), min(b, g, r)
        d = most - least
        sixths = g - b if most == r else b - r + 2 * d if most == g else r - g + 4 * d
        h2 = (sixths * (round(122880 / d) if d else 0) + 2048) >> 12
        assert (h, s) == (h2 + 180 * (h2 < 0), (d * (round(1044480 / most) if most else 0) + 2048) >> 12)
        true_h, true_s, _ = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
        assert min(abs(h - true_h * 180), 180 - abs(h - true_h * 180)) <= 1 and abs(s - true_s * 255) <= 1
        assert y == (3735 * b + 19235 * g + 9798 * r + 16384) // 32768


def test_histograms_equal_pixel_counts(spark):
    rng = np.random.default_rng(6)
    shots = [rng.integers(0, 256, (h * w, 3), dtype=np.uint8) // scale for h, w, scale in ((4, 5, 1), (9, 9, 7), (1, 1, 255))]
    rows = [("v", i, 1, len(s), s.tobytes()) for i, s in enumerate(shots)] + [("v", 3, 0, 0, b""), ("v", 4, None, None, None)]
    got = features.frame_histograms(spark.createDataFrame(rows, frames.COLOUR_SCHEMA)).orderBy("frame").collect()
    for shot, r in zip(shots, got, strict=False):
        counts = np.zeros(960)
        for h, s in zip(*colour.hue_saturation(shot.tobytes()), strict=True):
            if h < 180:
                counts[h // 6 * 32 + s // 8] += 1
        assert r["hist"] == pytest.approx(counts / np.sqrt((counts**2).sum()), abs=1e-6)
    assert sum(got[3]["hist"]) == 0 and got[4]["hist"] is None


def write_y4m(path, shots, chroma="420jpeg", rate="30:1", cut=0):
    """``shots``: for each frame its planes."""
    h, w = shots[0][0].shape
    data = f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 C{chroma}\n".encode()
    data += b"".join(b"FRAME\n" + b"".join(p.astype(np.uint8).tobytes() for p in planes) for planes in shots)
    path.write_bytes(data[: len(data) - cut])


def planes(w, h, across, down, seed):
    rng = np.random.default_rng(seed)
    small = (-(-h // down), -(-w // across)) if across else None
    return [rng.integers(0, 256, (h, w)), *([rng.integers(0, 256, small) for _ in range(2)] if across else [])]


def plain_bgr(planes, across, down):
    """One pixel at a time."""
    out = []
    for i, row in enumerate(planes[0].tolist()):
        for j, y in enumerate(row):
            u, v = (int(p[i // down][j // across]) - 128 for p in planes[1:]) if across else (0, 0)
            y = max(y - 16, 0) * 1220542
            for x in (y + 2116026 * u, y - 852492 * v - 409993 * u, y + 1673527 * v):
                out.append(min(255, max(0, (x + (1 << 19)) >> 20)))
    return bytes(out)


@pytest.mark.parametrize(("chroma", "across", "down"), [("420mpeg2", 2, 2), ("422", 2, 1), ("444", 1, 1), ("mono", 0, 0)])
def test_y4m_by_many_tasks_equals_one_pass(spark, tmp_path, chroma, across, down):
    shots = [planes(7, 5, across, down, i) for i in range(23)]
    write_y4m(tmp_path / "a.y4m", shots, chroma, cut=3)  # the last frame is cut short
    write_y4m(tmp_path / "b.y4m", shots[:2], chroma)
    paths = spark.createDataFrame([(n, str(tmp_path / f"{n}.y4m")) for n in "ab"], "series_id string, path string")
    df = y4m.read_y4m(paths, stretch_bytes=400)
    assert df.rdd.getNumPartitions() > 3
    got = {(r["series_id"], r["frame"]): bytes(r["bgr"]) for r in df.collect()}
    assert got == {**{("a", i): plain_bgr(s, across, down) for i, s in enumerate(shots[:22])}, **{("b", i): plain_bgr(s, across, down) for i, s in enumerate(shots[:2])}}
    path = str(tmp_path / "a.y4m")
    assert y4m.read_frame(path, 21)[2] == got["a", 21] and y4m.read_frame(path, 22) is None and y4m.read_frame(path, -1) is None
    assert y4m.read_frame("/no/such/file", 0) is None
    assert containers.probe(path) == (30.0, 22, 7, 5)


def test_only_wanted_frames_are_read(spark, tmp_path):
    write_y4m(tmp_path / "a.y4m", [planes(4, 2, 2, 2, i) for i in range(9)])
    paths = spark.createDataFrame([("a", f"file:{tmp_path}/a.y4m")], "series_id string, path string")
    wanted = spark.createDataFrame([("a", 3), ("a", 3), ("a", 99), ("b", 1)], "series_id string, frame long")
    got = {r["frame"]: r["bgr"] for r in frames.read_colour(paths, wanted, y4m.read_frame).collect()}
    assert set(got) == {3, 99} and got[99] is None and len(got[3]) == 24


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def track(handler, scale, runs, w, h, version=0):
    mdhd = struct.pack(">B3xQQIQ", 1, 0, 0, scale, 9) if version else struct.pack(">B3xIIII", 0, 0, 0, scale, 9)
    entry = box(b"avc1", bytes(24), struct.pack(">HH", w, h), bytes(50))
    stts = struct.pack(">II", 0, len(runs)) + b"".join(struct.pack(">II", *r) for r in runs)
    table = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), box(b"stts", stts))
    return box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", box(b"mdhd", mdhd), box(b"hdlr", bytes(8), handler, bytes(12)), box(b"minf", table)))


@pytest.mark.parametrize("version", [0, 1])
def test_mp4_header(tmp_path, version):
    moov = box(b"moov", box(b"mvhd", bytes(100)), track(b"soun", 48000, [(100, 1024)], 0, 0), track(b"vide", 90000, [(299, 3003), (1, 3003)], 1920, 1080, version))
    large = struct.pack(">I4sQ", 1, b"mdat", 16 + 500) + bytes(500)
    for i, data in enumerate((box(b"ftyp", b"isom") + moov + box(b"mdat", bytes(99)), box(b"ftyp", b"isom") + large + moov)):
        path = tmp_path / f"{i}.mp4"
        path.write_bytes(data)
        assert containers.probe(str(path)) == (pytest.approx(29.97, abs=1e-3), 300, 1920, 1080)
        for cut in range(0, len(data), 37):  # damaged files say nothing, and break nothing
            path.write_bytes(data[:cut])
            assert len(containers.probe(str(path))) == 4


def chunk(kind, *parts):
    data = b"".join(parts)
    return struct.pack("<4sI", kind, len(data)) + data + b"\0" * (len(data) % 2)


def test_avi_header(tmp_path):
    avih = struct.pack("<14I", 40000, 0, 0, 0, 77, 0, 2, 0, 640, 480, 0, 0, 0, 0)
    strh = b"vids" + b"XVID" + struct.pack("<10I", 0, 0, 0, 1001, 24000, 0, 75, 0, 0, 0)
    sound = b"auds" + bytes(44)
    header = chunk(b"LIST", b"hdrl", chunk(b"avih", avih), chunk(b"LIST", b"strl", chunk(b"strh", sound)), chunk(b"LIST", b"strl", chunk(b"strh", strh)))
    path = tmp_path / "v.avi"
    path.write_bytes(chunk(b"RIFF", b"AVI ", header, chunk(b"LIST", b"movi", bytes(1000))))
    assert containers.probe(str(path)) == (pytest.approx(24000 / 1001), 75, 640, 480)
    path.write_bytes(b"nothing of the kind")
    assert containers.probe(str(path)) == containers.UNKNOWN == containers.probe("/no/such/file")


def test_command_line_from_a_video(spark, tmp_path, monkeypatch):
    """Scores, rate and the frames' colours come from the video; a quiet stretch of another colour is no segment."""
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    rng = np.random.default_rng(8)
    shots = []
    for i in range(1200):
        quiet = 100 <= i < 300 or 400 <= i < 700 or 850 <= i < 1000
        chroma = 200 if 850 <= i < 1000 else 90  # the last quiet stretch looks otherwise
        noise = rng.integers(100, 103, (8, 8)) if quiet else rng.integers(16, 235, (8, 8))
        shots.append([noise, np.full((4, 4), chroma), np.full((4, 4), 255 - chroma)])
    write_y4m(tmp_path / "match.y4m", shots, rate="25:1")
    assert cli.main(["scores", "match.y4m"]) == 0
    with open("match.csv", encoding="utf-8-sig") as f:
        rows = list(csv.DictReader(f))
    assert len(rows) == 1200 and rows[0]["Difference_Score"] == "0" and rows[3]["Time_Sec"] == "0.12"

    def found(*more):
        assert cli.main(["segment", "match.csv", "--video", "match.y4m", "--out", "out", "--threshold", "500", *more]) == 0
        with open("out/segments.csv", encoding="utf-8-sig") as f:
            return [(int(r["start_frame"]), int(r["end_frame"]), float(r["start_sec"])) for r in csv.DictReader(f)]

    every = found("--similarity", "0")
    assert len(every) == 3 and [abs(a - b) < 15 for (a, *_), b in zip(every, (100, 400, 850), strict=True)] == [True] * 3
    assert [s[2] for s in every] == [round(s[0] / 25, 4) for s in every]  # the container's rate
    assert found() == every[:2]
    page = (tmp_path / "out" / "viewer.html").read_text()
    assert "total = 48.000000" in page and len(json.loads(page.split("segments = ")[1].split(", total = ")[0])) == 2
    (tmp_path / "own_reader.py").write_text("def read(path, number):\n    return None\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert found("--reader", "own_reader:read") == every  # no frame can be read, so all stay


def test_rates_and_lengths_of_tables_of_videos(spark, tmp_path):
    write_y4m(tmp_path / "a.y4m", [planes(4, 2, 2, 2, i) for i in range(50)], rate="25:1")
    (tmp_path / "b.y4m").write_bytes(b"broken")
    paths = frames.video_paths(spark, str(tmp_path / "*.y4m"))
    got = {r["series_id"]: (r["fps"], r["duration_sec"]) for r in frames.durations(frames.read_metadata(paths, containers.probe)).collect()}
    assert got == {"a": (25.0, 2.0), "b": (30.0, 0.0)}
    assert paths.where(F.col("series_id") == "a").count() == 1
