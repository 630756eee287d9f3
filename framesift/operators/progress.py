"""Progress of runs from samples (group, at, completed): rolling rate, time left, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.text import progress_line


def rolling_rate(samples: DataFrame, window: int, key: str = "run", at: str = "at", done: str = "completed") -> DataFrame:
    """``rate`` over the last ``window`` intervals; null if time or progress stood still. The first sample of a
    run is its start. Progress that goes back is an error."""
    if window < 1:
        raise ValueError("window must be positive")
    order = Window.partitionBy(key).orderBy(at, done)
    frame = order.rowsBetween(-window, 0)
    before = F.lag(done).over(Window.partitionBy(key).orderBy(at))
    dt, dn = F.col(at) - F.first(at).over(frame), F.col(done) - F.first(done).over(frame)
    fault = F.raise_error(F.lit("progress cannot go back")).cast("double")
    rate = F.when(F.coalesce(before > F.col(done), F.lit(False)), fault).when((dt > 0) & (dn > 0), dn / dt)
    return samples.withColumn("rate", rate)


def snapshot(rated: DataFrame, total: str = "total", key: str = "run", at: str = "at", done: str = "completed", unit: str = "frames") -> DataFrame:
    """``completed`` drawn into [0, total], percent (100 of nothing), eta_seconds (0 when done, null without a
    rate), elapsed_seconds since the run's first sample, and the line of text."""
    bounded = F.least(F.greatest(F.col(done), F.lit(0).cast("long")), F.col(total))
    out = rated.withColumn(done, bounded)
    left = F.col(total) - F.col(done)
    elapsed = F.greatest(F.col(at) - F.min(at).over(Window.partitionBy(key)), F.lit(0.0))
    out = out.withColumns({
        "percent": F.when(F.col(total) > 0, F.col(done) / F.col(total) * 100).otherwise(F.lit(100.0)),
        "eta_seconds": F.when(left <= 0, F.lit(0.0)).when(F.col("rate").isNotNull(), left / F.col("rate")), "elapsed_seconds": elapsed})
    return out.withColumn("line", progress_line(F.col(done), F.col(total), unit, F.col("percent"), F.col("rate"), F.col("eta_seconds"), F.col("elapsed_seconds")))


def with_start(samples: DataFrame, started_at: float, initial: int, key: str = "run", at: str = "at", done: str = "completed") -> DataFrame:
    """Samples with each run's start as one more."""
    start = samples.select(key).distinct().select(key, F.lit(float(started_at)).alias(at), F.lit(initial).cast("long").alias(done))
    return samples.select(key, at, done).unionByName(start)
