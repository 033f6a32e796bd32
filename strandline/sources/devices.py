"""Inventories of devices and encoders, as text that other programs print."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The command that lists devices, and encoders in order of preference.
LIST_DEVICES = ("nvidia-smi", "--query-gpu=index,memory.free", "--format=csv,noheader,nounits")
HARDWARE_ENCODERS = ("h264_nvenc", "h264_qsv", "h264_amf")
SOFTWARE_ENCODERS = ("libx264", "libopenh264", "mpeg4")
#: Options of each encoder.
ENCODER_OPTIONS = {
    "h264_nvenc": ("-preset", "fast"),
    "h264_qsv": ("-preset", "fast"),
    "h264_amf": ("-preset", "fast"),
    "libx264": ("-preset", "fast", "-crf", "18"),
    "libopenh264": ("-b:v", "5M"),
    "mpeg4": ("-q:v", "2"),
}


def run_text(command: Sequence[str], timeout: float = 5.0) -> str:
    """What a command prints on both streams; nothing if it can't be run."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout + done.stderr


def find_program(name: str) -> str | None:
    return shutil.which(name)


def parse_devices(lines: DataFrame) -> DataFrame:
    """``device, free_mb, place`` from lines ``index, MB``; decimals of MB are cut off, blank and malformed lines left out."""
    parts = F.split(F.trim("value"), r"\s*,\s*")
    device, memory = parts.getItem(0).try_cast("int"), F.get(parts, F.lit(1)).try_cast("double").try_cast("int")
    return lines.select(device.alias("device"), memory.alias("free_mb"), "place").where("device IS NOT NULL AND free_mb IS NOT NULL")


def device_lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(text.splitlines())], "value string, place long")


def first_best(df: DataFrame, by: str, order: str) -> DataFrame:
    """The row with the largest ``by``; of equal ones the first by ``order``."""
    return df.orderBy(F.desc_nulls_last(by), order).limit(1)


def best_per_group(df: DataFrame, group: str, by: str, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(by), order))
    return df.withColumn("place_in_group", rank).where("place_in_group = 1").drop("place_in_group")


def choose_encoder(listing: str, hardware: bool = True) -> str:
    """The first preferred encoder that a listing names, in letters of either case; the last of all if it names none."""
    listing = listing.lower()
    order = (*HARDWARE_ENCODERS, *SOFTWARE_ENCODERS) if hardware else SOFTWARE_ENCODERS
    return next((e for e in order if e in listing), order[-1])
