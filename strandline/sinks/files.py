"""Score, segment and clip tables as files.

Tables of segments are small reports, and tools read them as one named file
with a byte order mark; scores are written by tasks.
"""

from __future__ import annotations

import csv
import os
from html import escape
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_COLUMNS = ("index", "start_frame", "end_frame", "start_sec", "end_sec", "duration_sec", "start_label", "end_label")
CLIP_COLUMNS = ("clip", "start_frame", "end_frame", "start_sec", "end_sec", "duration_sec")


def write_scores(scores: DataFrame, path: str) -> None:
    """Score CSV files, a folder for each series, in order of frames."""
    named = scores.select("series_id", F.col("frame").alias("Frame"), F.col("time_sec").alias("Time_Sec"), F.col("score").alias("Difference_Score"))
    ordered = named.repartitionByRange("series_id", "Frame").sortWithinPartitions("series_id", "Frame")
    ordered.write.partitionBy("series_id").option("header", True).mode("overwrite").csv(path)


def write_report(rows: DataFrame, path: str, columns: tuple[str, ...], order: str) -> int:
    """One CSV file of a report, streamed to the driver row by row; gives back how many rows."""
    count = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as file:
        out = csv.writer(file)
        out.writerow(columns)
        for row in rows.select(*columns, order).orderBy(order).toLocalIterator():
            out.writerow([row[c] for c in columns])
            count += 1
    return count


def write_segments(rows: DataFrame, path: str) -> int:
    return write_report(rows, path, SEGMENT_COLUMNS, "index")


def write_clip_index(rows: DataFrame, path: str) -> int:
    return write_report(rows, path, CLIP_COLUMNS, "start_frame")


def json_items(rows: DataFrame) -> DataFrame:
    """``series_id, index, item``: each segment as a JSON object, a row each."""
    return rows.select("series_id", "index", F.to_json(F.struct(*SEGMENT_COLUMNS)).alias("item"))


def segments_json(rows: DataFrame) -> DataFrame:
    """``series_id, payload``: each series' segments as one JSON array, in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*SEGMENT_COLUMNS)))
    return rows.groupBy("series_id").agg(F.to_json(ordered).alias("payload"))


PAGE = Template(
    """<!doctype html>
<html lang="en">
<head><meta charset="utf-8"><title>$title</title>
<style>
body { font: 14px sans-serif; margin: 1rem; }
video { width: 100%; max-height: 60vh; background: #000; }
#strip { position: relative; height: 3rem; background: #eee; margin: 1rem 0; }
#strip button { position: absolute; top: 0; height: 100%; border: 0; cursor: pointer; }
.on { outline: 2px solid #000; }
</style></head>
<body>
<video id="video" controls src="$source"></video>
<input id="zoom" type="range" min="50" max="300" step="20" value="100">
<div style="overflow-x: auto"><div id="strip"></div></div>
<ol id="list"></ol>
<script>
const segments = $payload, total = $total;
const colours = ["#4e79a7", "#f28e2b", "#59a14f", "#e15759", "#76b7b2", "#b07aa1"];
const video = document.getElementById("video"), strip = document.getElementById("strip"), list = document.getElementById("list");
const show = (s) => { video.currentTime = s.start_sec; video.play(); };
const drawn = segments.map((s) => {
  const block = strip.appendChild(document.createElement("button")), item = list.appendChild(document.createElement("li"));
  block.style.left = (total > 0 ? (100 * s.start_sec) / total : 0) + "%";
  block.style.width = Math.max(0.3, total > 0 ? (100 * s.duration_sec) / total : 0) + "%";
  block.style.background = colours[(s.index - 1) % colours.length];
  block.title = item.textContent = s.start_label + " - " + s.end_label + " (" + s.duration_sec.toFixed(2) + " s)";
  block.onclick = item.onclick = () => show(s);
  return block;
});
if (!segments.length) list.textContent = "No segments.";
document.getElementById("zoom").oninput = (e) => { strip.style.width = e.target.value + "%"; };
video.ontimeupdate = () => {
  const at = segments.findIndex((s) => video.currentTime >= s.start_sec && video.currentTime <= s.end_sec);
  drawn.forEach((b, i) => b.classList.toggle("on", i === at));
};
</script></body></html>
"""
)


def viewer_around(total_sec: float, source: str, title: str = "Segments") -> tuple[str, str]:
    """What stands before and after the segments in a page that plays a video beside them; text can't end an attribute."""
    page = PAGE.substitute(title=escape(title), source=escape(source.replace("\\", "/"), quote=True), payload="\0", total=f"{total_sec:.6f}")
    before, _, after = page.partition("\0")
    return before, after


def write_viewer(rows: DataFrame, path: str, total_sec: float, source: str) -> None:
    """The page of one series, whose segments come one by one in their order; without any it says so.

    The page is there only once it is whole. Text from segments can't end its script.
    """
    before, after = viewer_around(total_sec, source)
    part, series, lead = f"{path}.part", [], ""
    try:
        with open(part, "w", encoding="utf-8") as file:
            file.write(before + "[")
            for row in json_items(rows).orderBy("series_id", "index").toLocalIterator():
                series = series or [row["series_id"]]
                if series != [row["series_id"]]:
                    raise ValueError("a viewer shows one series")
                file.write(lead + row["item"].replace("</", "<\\/").replace("<!--", "<\\!--"))
                lead = ","
            file.write("]" + after)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
