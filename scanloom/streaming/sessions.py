"""Scan sessions over a stream of samples: the batch sessions' analogue with event time and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(samples: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    """Per `by` and session (no gap of `gap` between samples): first and last time, samples, mean. Samples that come
    later than `late` behind the newest are not counted."""
    timed = samples.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = timed.groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(by, F.col("session_window.start").alias("t0"), F.col("session_window.end").alias("t1"), "n", "mean")
