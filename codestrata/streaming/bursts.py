"""Bursts of a live stream of commits: the batch definition with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import constants as C


def streaming_bursts(events: DataFrame, keys: tuple[str, ...] = ("repo_id",), time: str = "ts", gap: str = C.BURST_GAP, least: int = C.BURST_LEAST, delay: str = "1 hour") -> DataFrame:
    """(keys, start, stop, n) of each burst once the watermark has passed its end; state is a row an open session."""
    d = events.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return d.where(F.col("n") >= least).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
