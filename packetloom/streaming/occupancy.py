"""Occupancy and quality flags on streams: the batch expressions under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.bins import GridSpec
from packetloom.operators.grids import with_bins


def dwell_stream(samples: DataFrame, spec: GridSpec, window: str = "1 day", late: str = "1 hour", dt_min: float = 1.0) -> DataFrame:
    """Minutes per time window and cell of a stream of samples (ts, x, y, z); samples later than ``late`` are dropped."""
    b = with_bins(samples.withWatermark("ts", late), spec).filter("in_range")
    g = b.groupBy(F.window("ts", window), "i_r", "i_lat", "i_lt").agg((F.count(F.lit(1)) * F.lit(dt_min)).alias("minutes"))
    return g.select(F.col("window.start").alias("from"), "i_r", "i_lat", "i_lt", "minutes")


def unflagged_stream(samples: DataFrame, flags: DataFrame, late: str = "1 hour") -> DataFrame:
    """Samples of a stream that no interval (start_time, end_time) of a static flag table covers."""
    spans = flags.select("start_time", "end_time", F.explode(F.sequence(F.date_trunc("hour", "start_time"), F.date_trunc("hour", "end_time"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    s = samples.withWatermark("ts", late).withColumn("sample_hour", F.date_trunc("hour", "ts"))
    on = (F.col("sample_hour") == F.col("hour")) & (F.col("ts") >= F.col("start_time")) & (F.col("ts") <= F.col("end_time"))
    return s.join(spans, on, "left_anti").drop("sample_hour")
