"""Session settings and small helpers that every module relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the engine's fixed settings: UTC, adaptive execution, skew joins."""
    b = SparkSession.builder.master(master).appName("packetloom").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or a ValueError that lists the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean(c: Column) -> Column:
    """NaN is null inside the engine: Spark orders NaN above everything."""
    return F.nanvl(c, F.lit(None).cast("double"))


def seconds(ts: Column) -> Column:
    """POSIX seconds of a timestamp as a double; naive times are UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session of one process makes a temporary folder where none is named; elsewhere the
    executors would each write to a disk of their own, so there it is an error.
    """
    import re
    import tempfile
    import uuid

    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/packetloom-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once into the shared folder and read from there, so that nothing before it runs again."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
