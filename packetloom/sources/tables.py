"""Text formats, catalogues and grids: readers and writers."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.times import has_doy, parse_doy, parse_iso
from packetloom.session import clean, require_columns, seconds, staged


def _layout(names: str, units: str) -> T.StructType:
    fields = [T.StructField("ts", T.TimestampType(), True, {"kind": "time"})]
    for n, u in zip(names.split(), units.split(), strict=True):
        fields.append(T.StructField(n, T.DoubleType(), True, {"units": u, "kind": "field" if n.startswith("b") else "position"}))
    return T.StructType(fields)


class Coords(StrEnum):
    """Coordinate systems of the text tables."""

    KSM = "KSM"
    KSO = "KSO"
    KRTP = "KRTP"


#: Fixed column layouts of the text tables.
LAYOUTS = {
    "KSM": _layout("bx by bz btot x y z", "nT nT nT nT R R R"),
    "KSO": _layout("bx by bz btot x y z", "nT nT nT nT R R R"),
    "KRTP": _layout("br bth bphi btot r th phi lt", "nT nT nT nT R deg deg h"),
}
FLAGS = T.StructType([T.StructField("start_time", T.TimestampType()), T.StructField("end_time", T.TimestampType())] + [T.StructField(n, T.StringType()) for n in ("flag_type", "sensor", "severity", "description")])


def parse_table(lines: DataFrame, coords: str, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Typed rows of whitespace text, with the columns ``keep`` before them; unreadable fields are null, NaN too."""
    keep = keep or []
    parts = F.split(F.trim(F.col(value)), r"\s+")
    layout = LAYOUTS[coords]
    first = F.coalesce(F.try_to_timestamp(F.get(parts, F.lit(0))), parse_doy(F.get(parts, F.lit(0))))
    typed = lines.select(*keep, first.alias("ts"), *[clean(F.get(parts, F.lit(k)).try_cast("double")).alias(f.name) for k, f in enumerate(layout.fields) if k])
    return typed.select(*keep, *[F.col(f.name).alias(f.name, metadata=f.metadata) for f in layout.fields])


def thinned(rows: DataFrame, file: list[str], order: list[str], ts: str, resolution_s: float) -> DataFrame:
    """Every k-th row of each file in order, for the largest k that keeps a step of at most ``resolution_s``.

    A file's own step is that between its first two rows; one without a positive step stays whole.
    """
    w = Window.partitionBy(*file).orderBy(*order)
    x = rows.withColumn("rn", F.row_number().over(w) - 1)
    of = lambda k: F.max(F.when(F.col("rn") == k, seconds(F.col(ts)))).over(Window.partitionBy(*file))
    step = of(1) - of(0)
    x = x.withColumn("k", F.when(step > 0, F.greatest(F.lit(1), F.floor(resolution_s / step))).otherwise(1))
    return x.filter(F.col("rn") % F.col("k") == 0).select(*rows.columns)


def read_table(spark: SparkSession, paths: list[str] | str, coords: str, date_from=None, date_to=None, resolution_s: float | None = None) -> DataFrame:
    """Text tables as typed rows within an inclusive range of times, thinned to a resolution if one is given."""
    lines = spark.read.text(paths)
    if resolution_s is None:
        df = parse_table(lines, coords)
    else:
        df = parse_table(lines.withColumn("file", F.input_file_name()), coords, keep=["file"])
        df = thinned(df, ["file"], ["ts", *[f.name for f in LAYOUTS[coords].fields[1:]]], "ts", resolution_s).drop("file")
    if date_from is not None:
        df = df.filter(F.col("ts") >= F.lit(date_from))
    return df.filter(F.col("ts") <= F.lit(date_to)) if date_to is not None else df


def write_years(samples: DataFrame, path: str, keys: tuple[str, ...] = ()) -> None:
    """One folder per year, so that a range of times opens only its years."""
    samples.withColumn("year", F.year("ts")).write.partitionBy(*keys, "year").parquet(path)


def write_segments(rows: DataFrame, path: str, segment: str, order: list[str]) -> None:
    """Segments one after another, each whole in one file and in order; files are as many as the rows ask for, not the segments.

    A file's statistics tell the range of segments in it, so that one segment opens its file alone.
    """
    rows.repartitionByRange(segment).sortWithinPartitions(segment, *order).write.parquet(path)


def select_data(spark: SparkSession, path: str, date_from: str, date_to: str, margin_s: int = 0, coords: str | None = None, resolution_s: float | None = None) -> DataFrame:
    """Rows within a range, widened by a margin at both ends, of one layout and at a resolution if given; years outside aren't opened.

    ``coords`` is a key of ``write_years``. Resolution thins each year by itself, before the range is cut.
    """
    margin = F.expr(f"INTERVAL {int(margin_s)} SECONDS")
    lo, hi = F.lit(date_from).cast("timestamp") - margin, F.lit(date_to).cast("timestamp") + margin
    df = spark.read.parquet(path)
    df = df.filter(F.col("coords") == coords) if coords is not None else df
    df = df.filter((F.col("year") >= F.year(lo)) & (F.col("year") <= F.year(hi)))
    if resolution_s is not None:
        df = thinned(df, ["year"], ["ts", *[c for c in df.columns if c not in ("ts", "year", "coords")]], "ts", resolution_s)
    return df.filter(F.col("ts").between(lo, hi))


def load_mission(spark: SparkSession, path: str, year_from: int, year_to: int) -> DataFrame:
    """All years of a range as one trajectory, unsorted; ValueError if there are no rows."""
    df = spark.read.parquet(path).filter(F.col("year").between(year_from, year_to))
    if df.isEmpty():
        raise ValueError(f"no rows in the years {year_from} to {year_to}")
    return df


def on_days(samples: DataFrame, days: DataFrame, ts: str = "ts", day: str = "day") -> DataFrame:
    """Samples of the days that a reference table lists, such as days of known events."""
    listed = days.select(F.to_date(F.col(day)).alias("reference_day")).distinct()
    return samples.join(listed, F.to_date(F.col(ts)) == F.col("reference_day"), "left_semi")


def read_segment(df: DataFrame, coords: str) -> tuple[DataFrame, float]:
    """Rows of one segment, angles in radians where the layout has degrees, and the median time step."""
    if df.isEmpty():
        raise ValueError("no data in the range")
    if coords == "KRTP":
        df = df.withColumn("th", F.radians("th")).withColumn("phi", F.radians("phi"))
    step = seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(Window.partitionBy(F.lit(0)).orderBy("ts"))  # one segment
    return df, df.select(step.alias("s")).agg(F.percentile("s", 0.5)).first()[0]


def parse_crossings(lines: DataFrame, value: str = "value") -> DataFrame:
    """Crossing lists: year, day of year, hour, minute, type, direction, x, y, z; shorter lines are dropped."""
    p = F.split(F.trim(F.col(value)), r"\s+")
    g = lambda k, kind: F.get(p, F.lit(k)).try_cast(kind)
    start = F.unix_seconds(F.make_timestamp(g(0, "int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    t = start + (g(1, "bigint") - 1) * 86400 + g(2, "bigint") * 3600 + g(3, "bigint") * 60
    rows = lines.filter(F.size(p) >= 9)
    return rows.select(F.timestamp_seconds(t).alias("t"), F.get(p, F.lit(4)).alias("crossing_type"), F.get(p, F.lit(5)).alias("direction"), *[g(6 + k, "double").alias(n) for k, n in enumerate("xyz")])


def _flag(start: Column, end: Column, kind: str, sensor: Column, severity: Column | str, text: Column) -> list[Column]:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return [start.alias("start_time"), end.alias("end_time"), F.lit(kind).alias("flag_type"), sensor.alias("sensor"), lit(severity).alias("severity"), text.alias("description")]


def _after(ts: Column, s: int) -> Column:
    return ts + F.expr(f"INTERVAL {s} SECONDS")


def parse_timing(lines: DataFrame, value: str = "value") -> DataFrame:
    """``path,start,end,description`` lines."""
    p = F.split(F.trim(F.col(value)), ",", 4)
    part = lambda k: F.get(p, F.lit(k))
    text = F.concat(F.lit("backwards timing: "), F.trim(part(3)))
    out = lines.select(*_flag(parse_iso(part(1)), parse_iso(part(2)), "timing_error", F.lit("FGM"), "negligible", text))
    return out.filter("start_time IS NOT NULL AND end_time IS NOT NULL AND description IS NOT NULL")


def parse_ranges(lines: DataFrame, value: str = "value") -> DataFrame:
    """Range changes: one critical minute each."""
    v = F.trim(F.col(value))
    up = F.upper(v)
    vhm, fgm = up.contains("VHM"), up.contains("FGM")
    sensor = F.when(vhm & fgm, "ALL").when(vhm, "VHM").otherwise("FGM")
    digit = F.regexp_extract(v, r"(?i)range\s+(\d)", 1)
    text = F.concat(sensor, F.lit(" to range "), F.when(digit == "", "?").otherwise(digit))
    ts = parse_doy(v)
    return lines.filter(has_doy(v) & ~v.rlike("^(Each|Time|---)")).select(*_flag(ts, _after(ts, 60), "range_change", sensor, "critical", text))


def parse_spurious(lines: DataFrame, value: str = "value") -> DataFrame:
    ts = parse_doy(F.col(value))
    return lines.filter(has_doy(F.col(value))).select(*_flag(ts, _after(ts, 60), "spurious_range", F.lit("FGM"), "low", F.lit("corrupted range vector")))


#: What a mode change's text says, first match first.
MODE_TEXTS = (
    ("turns off", "instrument off"), ("turns on", "instrument on"), ("sick", "instrument sick"), ("sleep", "sleep mode"), ("muted", "instrument muted"),
    ("unmuted", "instrument unmuted"), ("reset", "instrument reset"), ("no data", "no data"), ("scalar/vector", "VHM→SHM switch"), ("vector/vector", "SHM→VHM switch"),
    ("science packets recommence", "science data resumes"), ("maintenance", "instrument maintenance"),
)
#: Words that make a mode change critical.
CRITICAL = ("turns off", "turns on", "sick", "sleep", "muted", "unmuted", "reset", "no data", "no science")


def parse_modes(lines: DataFrame, order: str, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Mode changes: blocks of free text, each from a line that starts with a time to the next such line.

    ``order`` is the line number within ``keys`` (files); files are short logs.
    """
    keys = keys or []
    x = lines.withColumn("v", F.trim(F.col(value)))
    starts = x["v"].rlike(r"^\d{4}-\d{3}[T ]\d{2}:\d{2}:\d{2}")
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    x = x.withColumn("block", F.sum(starts.cast("int")).over(w)).filter("block > 0")
    b = x.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "v"))).alias("l"))
    # named columns, so that each text is made once and not once for every word that is looked for
    b = b.select(F.col("l")[0]["v"].alias("head"), F.concat_ws(" ", F.transform("l", lambda r: r["v"])).alias("body"))
    b = b.select("body", F.lower("body").alias("low"), F.upper("head").alias("up"), parse_doy(F.col("head")).alias("begins"))
    body, low, up, ts = (F.col(n) for n in ("body", "low", "up", "begins"))
    sensor = F.when(up.contains("ALL"), "ALL").when(up.contains("VHM"), "VHM").when(up.contains("FGM"), "FGM").otherwise("ALL")
    critical = low.rlike("|".join(CRITICAL))
    text = F.lit(None).cast("string")
    for word, says in reversed(MODE_TEXTS):
        text = F.when(low.contains(word), says).otherwise(text)
    switch = F.when(low.contains("scalar/vector"), "scalar/vector").when(low.contains("vector/vector"), "vector/vector")
    to = parse_doy(F.regexp_extract(body, r"to\s+(\d{4}-\d{3}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1))
    end = F.when(critical & (to > ts), to).when(critical, _after(ts, 600)).when(switch.isNotNull(), _after(ts, 120)).otherwise(_after(ts, 300))
    said = F.when(~critical & switch.isNotNull(), F.concat(F.lit("mode switch: "), switch)).otherwise(F.coalesce(text, F.lit("mode change")))
    return b.filter(ts.isNotNull()).select(*_flag(ts, end, "mode_change", sensor, F.when(critical, "critical").otherwise("high"), said))


def parse_calibrations(lines: DataFrame, order: str, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Calibrations: a line that commences ends at the directly following one that ceases, else after an hour."""
    keys = keys or []
    v = F.trim(F.col(value))
    x = lines.filter(has_doy(v)).withColumn("ts", parse_doy(v)).withColumn("low", F.lower(v)).withColumn("up", F.upper(v))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    x = x.withColumn("next_ts", F.lead("ts").over(w)).withColumn("next", F.lead("low").over(w))
    begins, paired = F.col("low").contains("commences"), F.coalesce(F.col("next").contains("ceases"), F.lit(False))
    sensor = F.when(F.col("up").contains("ALL"), "ALL").when(F.col("up").contains("VHM"), "VHM").when(F.col("up").contains("FGM"), "FGM").otherwise("ALL")
    end = F.when(begins & paired, F.col("next_ts")).when(begins, _after(F.col("ts"), 3600)).otherwise(_after(F.col("ts"), 300))
    text = F.when(begins & paired & F.col("low").contains("scas"), "SCAS activity").when(begins & paired, "calibration").when(begins, "calibration (no end time)").otherwise("SCAS event")
    return x.filter(begins | ~F.col("low").contains("ceases")).select(*_flag(F.col("ts"), end, "calibration", sensor, "high", text))


def all_flags(parts: list[DataFrame], t_min=None, t_max=None, ordered: bool = True) -> DataFrame:
    """Union of flag tables that touch a window, by start; as it comes if not ``ordered``.

    A sort reads its input twice, so what the logs give is staged before it and parsed once.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.filter(F.col("end_time") >= F.lit(t_min)) if t_min is not None else out
    out = out.filter(F.col("start_time") < F.lit(t_max)) if t_max is not None else out
    return staged(out, "flags").orderBy("start_time") if ordered else out


def flag_report(flags: DataFrame, mission_hours: float) -> DataFrame:
    """Counts, hours and percent of the mission by type, severity and year and in all, in one pass."""
    hours = (seconds(F.col("end_time")) - seconds(F.col("start_time"))) / 3600
    f = flags.select("flag_type", "severity", F.year("start_time").alias("year"), F.lit("all").alias("total"), hours.alias("h"))
    by = F.explode(F.array(*[F.struct(F.lit(n).alias("by"), F.col(n).cast("string").alias("value")) for n in ("flag_type", "severity", "year", "total")]))
    g = f.select(by.alias("g"), "h").groupBy("g.by", "g.value").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("h"), 6).alias("hours"))
    return g.withColumn("percent", F.round(100.0 * F.col("hours") / mission_hours, 4))


def event_record(detections: DataFrame, extras: dict[str, Column] | None = None) -> DataFrame:
    """Nested detections (struct ``peak``) as flat rows in minutes; ValueError if an extra's name is taken."""
    inner = detections.schema["peak"].dataType.fieldNames()
    flat = [c for c in detections.columns if c != "peak"]
    if taken := set(extras or {}) & {*inner, *flat}:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    minutes = [(F.col(f"peak.{n}") / 60).alias(n[:-4] + "_min") if n.endswith("_sec") else F.col(f"peak.{n}") for n in inner]
    return detections.select(*flat, *minutes, *[c.alias(n) for n, c in (extras or {}).items()])


def write_grid(grid: DataFrame, path: str, **attrs: str) -> None:
    """A long grid by variable, with its attributes beside it."""
    require_columns(grid, "var", "minutes")
    grid.write.option("compression", "zstd").partitionBy("var").parquet(f"{path}/cells")
    if attrs:
        grid.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in attrs.items()]).write.json(f"{path}/attrs")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cells")


def background(spark: SparkSession, path: str) -> DataFrame | None:
    """Regional backgrounds that have segments; None where there is no archive."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path).filter("n_segments > 0")


def manifest_events(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of a JSON manifest, one row per event."""
    return spark.read.option("multiLine", "true").json(path).select("dataset_id", F.explode("events").alias("e")).select("dataset_id", "e.*")


def write_manifest_csv(events: DataFrame, path: str) -> None:
    """Ground truth as one flat table with a header; nulls are empty fields."""
    events.write.option("header", "true").csv(path)


def read_manifest_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def append_score(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("sep", "\t").option("header", "true").csv(path)


def digitised(df: DataFrame, x0: float, x1: float, v0: float, v1: float, y0: float, y1: float, f0: float, f1: float) -> DataFrame:
    """Curve points (mode, px, py) to latitude (linear) and frequency (log10), by their axes' calibration."""
    lat = v0 + (F.col("px") - x0) * ((v1 - v0) / (x1 - x0))
    logf = F.log10(F.lit(f0)) + (F.col("py") - y0) * ((F.log10(F.lit(f1)) - F.log10(F.lit(f0))) / (y1 - y0))
    return df.select("mode", lat.alias("lat"), F.pow(F.lit(10.0), logf).alias("freq"))
