"""Streams give what the batch gives."""

import datetime

from pyspark.sql import functions as F

from packetloom.functions.bins import GridSpec
from packetloom.operators.grids import dwell, with_bins
from packetloom.streaming import occupancy

SPEC = GridSpec(n_r=20, n_lat=18, n_lt=24, r=(0.0, 40.0))
T0 = datetime.datetime(2024, 1, 1)


def samples(spark):
    ts = F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int"))
    return spark.range(300).select(ts.alias("ts"), (F.col("id") % 17 + 3.5).cast("double").alias("x"), (F.col("id") % 5 - 2.2).cast("double").alias("y"), F.lit(1.5).alias("z"))


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_dwell(spark, tmp_path):
    df = samples(spark)
    df.write.parquet(str(tmp_path / "s"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    out = drained(occupancy.dwell_stream(live, SPEC), "dwell_out", "complete")
    want = dwell(with_bins(df, SPEC), ["i_r", "i_lat", "i_lt"])
    key = lambda x: sorted(tuple(r) for r in x.groupBy("i_r", "i_lat", "i_lt").agg(F.sum("minutes")).collect())
    assert key(out) == key(want)


def test_unflagged(spark, tmp_path):
    df = samples(spark)
    df.write.parquet(str(tmp_path / "s"))
    flags = spark.createDataFrame([(T0, T0 + datetime.timedelta(minutes=59)), (T0 + datetime.timedelta(minutes=50), T0 + datetime.timedelta(minutes=130))], "start_time timestamp, end_time timestamp")
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    assert drained(occupancy.unflagged_stream(live, flags), "unflagged_out", "append").count() == 300 - 131
