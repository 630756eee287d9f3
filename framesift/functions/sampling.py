"""Frame times of segments, in integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest segments (ms) that get one frame, and two.
SHORT_MS, MEDIUM_MS = 2000, 5000
#: Smallest share of a second between frames when the rate is low or high.
SECOND = 1000.0


def _long(value: Column | int | str) -> Column:
    return (F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value).cast("long")


def half_even(value: Column) -> Column:
    """The nearest integer, ties to even (Spark's round takes ties away from zero)."""
    return F.rint(value).cast("long")


def step_ms(fps: Column | float) -> Column:
    """Milliseconds between frames at ``fps``, at least 1."""
    rate = F.lit(float(fps)) if isinstance(fps, (int, float)) else fps
    return F.greatest(F.lit(1).cast("long"), half_even(F.lit(SECOND) / rate))


def div(a: Column, b: Column | int) -> Column:
    """Whole quotient of two integers."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def frame_to_ms(frame: Column, fps: Column) -> Column:
    return half_even(frame * F.lit(SECOND) / fps)


def _sample(at: Column, name: Column) -> Column:
    return F.struct(at.cast("long").alias("frame_ms"), name.alias("sample"))


def sample_frame_times(start: Column | str, end: Column | str, fps: Column | float) -> Column:
    """Frames that stand for a segment, an array of (frame_ms, sample): its middle if it is short, its thirds if
    it is medium, else one each 1/fps from half a step in, before its end. Bounds below 0 count as 0, and a
    segment lasts 1 ms at least."""
    s = F.greatest(F.lit(0).cast("long"), _long(start))
    e = F.greatest(s + 1, _long(end))
    length, step = e - s, step_ms(fps)
    first = s + div(step, 2)
    middle = s + div(length, 2)
    # sequence() counts its end in, and refuses one before its start
    grid = F.sequence(first, F.greatest(first, e - 1), step)
    return (
        F.when(length <= SHORT_MS, F.array(_sample(middle, F.lit("mid"))))
        .when(length <= MEDIUM_MS, F.array(_sample(s + div(length, 3), F.lit("third_1")), _sample(s + div(length * 2, 3), F.lit("third_2"))))
        .when(first < e, F.transform(grid, lambda at, i: _sample(at, F.format_string("long_%04d", i))))
        .otherwise(F.array(_sample(middle, F.lit("long_0000"))))
    )


def fine_scan_times(center: Column | str, start: Column | str, end: Column | str, window_ms: int, fps: float) -> Column:
    """Sorted distinct times around ``center`` (drawn into the segment) at ``fps``, within the window and the
    segment, both ends included; the center itself always."""
    s = _long(start)
    e = F.greatest(s, _long(end))
    c = F.greatest(s, F.least(e, _long(center)))
    window = F.lit(int(window_ms)).cast("long")
    low, high = F.greatest(s, c - window), F.least(e, c + window)
    grid = F.transform(F.sequence(-window, window, step_ms(fps)), lambda offset: c + offset)
    return F.array_sort(F.array_distinct(F.concat(F.array(c), F.filter(grid, lambda at: (at >= low) & (at <= high)))))


def fit_within(width: Column, height: Column, most: Column | int) -> Column:
    """(width, height) scaled so that the longer side is ``most``; unchanged if that is 0 or it fits."""
    most = F.lit(most) if isinstance(most, int) else most
    longest = F.greatest(width, height)
    scale = most / longest
    one = F.lit(1).cast("long")
    fits = (most <= 0) | (longest <= most)
    def side(x: Column) -> Column:
        return F.when(fits, x.cast("long")).otherwise(F.greatest(one, half_even(x * scale)))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def unique_ints(values: Column) -> Column:
    """Sorted distinct integers."""
    return F.array_sort(F.array_distinct(F.transform(values, lambda x: x.cast("long"))))
