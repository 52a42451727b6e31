"""Registration of queries with their SQL, and the roles that the test tables play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.bands import band_of
from packetloom.session import seconds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The same roles in SQL: positions, events, and events as a catalogue of intervals.
POS = """(SELECT l_orderkey AS id, l_linenumber AS n, l_quantity - 25.5 AS x, l_extendedprice / 4000 - 13.1 AS y, l_tax * 200 - 8.3 AS z,
  epoch_us(l_shipdate) / 1e6 AS t, l_linenumber % 4 AS code, l_discount AS disc FROM lineitem)"""
EV = """(SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""
BAND_SQL = """CASE WHEN {p} < 600 OR {p} >= 43200 THEN NULL WHEN {p} >= 600 AND {p} < 1200 THEN 'QP15' WHEN {p} >= 1200 AND {p} < 2400 THEN 'QP30'
  WHEN {p} >= 2400 AND {p} < 4800 THEN 'QP60' WHEN {p} >= 4800 AND {p} < 9600 THEN 'QP120' END"""
CAT = f"""(SELECT event_id, user_id AS segment_idx, t AS t0, t + round(value * 60) AS t1, value AS period_min, k / 10.0 AS q_factor, k,
  {BAND_SQL.format(p="(value * 60)")} AS band FROM {EV})"""
CROSS = f"(SELECT t AS ct, k % 4 AS code, event_id AS cid FROM {EV} WHERE event_type = 'error')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pos(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") - 25.5).alias("x"), (F.col("l_extendedprice") / 4000 - 13.1).alias("y"),
        (F.col("l_tax") * 200 - 8.3).alias("z"), seconds(F.col("l_shipdate")).alias("t"), (F.col("l_linenumber") % 4).alias("code"), F.col("l_discount").alias("disc"),
    )


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", seconds(F.col("ts")).alias("t"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))


def cat(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    return e.select(
        "event_id", F.col("user_id").alias("segment_idx"), F.col("t").alias("t0"), (F.col("t") + F.round(F.col("value") * 60)).alias("t1"),
        F.col("value").alias("period_min"), (F.col("k") / 10.0).alias("q_factor"), "k", band_of(F.col("value") * 60).alias("band"),
    )


def crossings(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).filter("event_type = 'error'").select(F.col("t").alias("ct"), (F.col("k") % 4).alias("code"), F.col("event_id").alias("cid"))


def r6(c: Column, name: str) -> Column:
    """Rounded to six places, with negative zero made zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def columns(name: str, base: str, keys: str, sql: dict[str, str], make: Callable[[], dict[str, Column]]) -> None:
    """Register a projection: the same named expressions as columns and as SQL, doubles rounded."""
    source = {"pos": (pos, POS), "ev": (ev, EV), "cat": (cat, CAT)}[base]

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = source[0](spark, d)
        made = df.select(*keys.split(), *[c.alias(n) for n, c in make().items()])
        return made.select(*keys.split(), *[r6(F.col(n), n) if dict(made.dtypes)[n] == "double" else F.col(n) for n in make()])

    QUERIES[name] = run
    listed = ", ".join(f"{e} AS {n}" for n, e in sql.items())
    SQL[name] = f"SELECT {', '.join(keys.split())}, {listed} FROM {source[1]}"
