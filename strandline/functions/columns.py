"""Column expressions for scores, times and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PALETTE_SIZE = 6


def log_score(score: Column) -> Column:
    """log10 of a score, of 1 where it is below."""
    return F.log10(F.greatest(score, F.lit(1.0)))


def from_log(value: Column) -> Column:
    return F.pow(F.lit(10.0), value)


def clean(score: Column) -> Column:
    """The score as double, NaN as null: aggregates skip nulls, not NaN."""
    score = score.cast("double")
    return F.when(~F.isnan(score), score)


def fps_or_default(fps: Column) -> Column:
    """A rate of 0 or less, or none, is 30."""
    return F.when(fps > 0, fps).otherwise(30.0)


def frame_time(frame: Column, fps: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide(frame.cast("double"), fps), digits)


def seconds(frames: Column, fps: Column | float) -> Column:
    return frames / (fps if isinstance(fps, Column) else F.lit(float(fps)))


def hundredths(sec: Column) -> Column:
    """``sec`` (0 to 64) in hundredths, rounded as C and Python print it: by the double's exact value, exact halves to even.

    A double under 64 is a whole number of 2^-47 and a rest; all comparisons are of whole numbers.
    """
    unit, fine = 1 << 47, 1 << 30
    whole = F.floor(sec * float(unit))
    rest = F.floor((sec * float(unit) - whole) * float(fine))
    low = F.floor(sec * 100)
    # Twice the hundredths against the half above ``low``, in units and then in parts of them.
    apart = (2 * low + 1) * unit - whole * 200
    left = F.when(apart <= 0, apart).when(apart >= 200, apart).otherwise(apart * fine - rest * 200)
    above = (left < 0) | ((left == 0) & ((apart != 0) | (rest == 0)) & (low % 2 == 1)) | ((apart == 0) & (rest > 0))
    return F.when(above, low + 1).otherwise(low)


def clock_label(sec: Column) -> Column:
    """``MM:SS.ss``; minutes go on past an hour."""
    minutes = F.floor(sec / 60)
    parts = hundredths(sec - minutes * 60)
    return F.format_string("%02d:%02d.%02d", minutes, F.floor(parts / 100), parts % 100)


def two_digits(sec: Column) -> Column:
    """``S.ss``, rounded as a label is."""
    minutes = F.floor(sec / 60)
    parts = hundredths(sec - minutes * 60)
    return F.format_string("%d.%02d", minutes * 60 + F.floor(parts / 100), parts % 100)


def clip_name(number: Column) -> Column:
    return F.format_string("clip_%04d.mp4", number)


def middle_frame(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2)


def percent(part: Column, total: Column) -> Column:
    return F.try_divide(part * 100.0, total)


def block_left(start_sec: Column, total_sec: Column) -> Column:
    return F.when(total_sec <= 0, 0.0).otherwise(F.try_divide(start_sec, total_sec) * 100)


def block_width(duration_sec: Column, total_sec: Column, least: float = 0.3) -> Column:
    """In percent, wide enough to be clicked."""
    return F.greatest(F.when(total_sec <= 0, 0.0).otherwise(F.try_divide(duration_sec, total_sec) * 100), F.lit(least))


def block_colour(number: Column) -> Column:
    return F.pmod(number - 1, F.lit(PALETTE_SIZE))


def zoom(percent_: Column, least: int = 50, most: int = 300) -> Column:
    return F.least(F.greatest(percent_, F.lit(least)), F.lit(most))


def web_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    """The file's name without folders or its last extension."""
    return F.regexp_replace(F.regexp_extract(web_path(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def pearson(x: Column, y: Column) -> Column:
    """The correlation of two arrays of one length; null where one is constant."""
    n = F.size(x)

    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda acc, v: acc + v)

    x, y = F.transform(x, lambda v: v.cast("double")), F.transform(y, lambda v: v.cast("double"))
    sx, sy = total(x), total(y)
    sxy = total(F.zip_with(x, y, lambda a, b: a * b))
    sxx, syy = total(F.transform(x, lambda v: v * v)), total(F.transform(y, lambda v: v * v))
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.when(spread > 0, (n * sxy - sx * sy) / spread)
