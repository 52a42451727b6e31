"""The event catalogue as files: required columns by schema version, optional and list columns, a sidecar beside the rows.

A catalogue is a folder of generations, a generation a folder of parts, a part the rows of one
write with a sidecar that tells their number, columns, version and attributes. A part or a
generation is written under a provisional name and appears by one rename, so a reader sees all of
a write or nothing, and a writer that dies leaves what was there before. Later versions only add
columns: a table whose parts are of several versions reads as one, with nulls where a part has no
such column.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.session import require_columns

# The columns that every row has, by the version that brought them, and optional ones with their types.
ADDED = {
    "1": (
        "event_id bigint, segment_id bigint, date_from timestamp, date_to timestamp, peak_time timestamp, duration_minutes double, band string, period_min double, period_fwhm_min double, "
        "q_factor double, mva_par_frac double, stokes_d double, b_perp1_amp double, b_perp2_amp double, b_par_amp double"
    ),
    "2": "stokes_i double, stokes_q double, stokes_u double, stokes_v double, ellipticity double, inclination_deg double, polarized_fraction double",
    "3": "",
}
OPTIONAL = {
    "1": "r_distance double, mag_lat double, local_time double, ksm_x double, ksm_y double, ksm_z double, region string, sls5_phase_n double, sls5_phase_s double, dipole_inv_lat double",
    "3": "peer_event_ids array<bigint>, peer_periods_min array<double>, peer_overlap_frac array<double>",
}
VERSION = "3"
PEERS = ("peer_event_ids", "peer_periods_min", "peer_overlap_frac")


def _fields(of: dict[str, str], version: str) -> list[T.StructField]:
    if version not in ADDED:
        raise ValueError(f"unknown schema version {version!r}")
    return [f for v, text in of.items() if v <= version and text for f in T.StructType.fromDDL(text).fields]


def required(version: str = VERSION) -> list[str]:
    return [f.name for f in _fields(ADDED, version)]


def record(detections: DataFrame, extras: dict[str, Column] | None = None, version: str = VERSION) -> DataFrame:
    """Detections with further columns; ValueError if one has the name of a required column."""
    if taken := set(extras or {}) & set(required(version)):
        raise ValueError(f"columns exist already: {sorted(taken)}")
    return detections.withColumns(extras or {})


def conformed(events: DataFrame, version: str = VERSION) -> DataFrame:
    """The columns in the version's order and types, then others as they are; peers of one row are lists of one length, never null.

    ValueError for missing columns, and for some but not all of the peers' columns.
    """
    require_columns(events, *required(version))
    known = _fields(ADDED, version) + [f for f in _fields(OPTIONAL, version) if f.name in events.columns]
    has = [c for c in PEERS if c in events.columns]
    if has and len(has) < len(PEERS):
        raise ValueError(f"peers need all of {', '.join(PEERS)}")
    named = {f.name for f in known}
    one = lambda f: F.coalesce(F.col(f.name), F.array()) if f.name in PEERS else F.col(f.name)
    out = events.select(*[one(f).cast(f.dataType).alias(f.name) for f in known], *[c for c in events.columns if c not in named])
    if has:
        uneven = (F.size(PEERS[0]) != F.size(PEERS[1])) | (F.size(PEERS[0]) != F.size(PEERS[2]))
        first, *_ = PEERS
        out = out.withColumn(first, F.when(~uneven, F.col(first)).otherwise(F.raise_error(F.lit("peers of one event differ in number"))))
    return out


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _put(spark: SparkSession, path: str, text: str) -> None:
    system, at = _files(spark, path)
    out = system.create(at(path), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str:
    system, at = _files(spark, path)
    f = system.open(at(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """One step; an error if the target exists."""
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(jvm.Path(source).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(jvm.Path(source), jvm.Path(target), spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))


def _names(spark: SparkSession, path: str, pattern: str) -> list[str]:
    system, at = _files(spark, path)
    if not system.exists(at(path)):
        return []
    return sorted(n for s in system.listStatus(at(path)) if re.fullmatch(pattern, n := s.getPath().getName()))


def generation(spark: SparkSession, path: str) -> str | None:
    """Folder of the latest generation."""
    found = _names(spark, path, r"generation-\d{8}")
    return f"{path}/{found[-1]}" if found else None


def write_catalogue(events: DataFrame, path: str, version: str = VERSION, replace: bool = False, **attrs: str) -> int:
    """Add rows to a catalogue, or put them in place of all it has; returns their number.

    An empty table is written too: it keeps its columns. Of two writers that replace at once the
    later one gets an error, and nothing of it is seen.
    """
    spark, path = events.sparkSession, path.rstrip("/")
    rows, now = conformed(events, version), generation(spark, path)
    part = f"part-{0 if now is None or replace else len(sidecars(spark, path)):08d}-{uuid.uuid4().hex}"
    provisional = f"{path}/_provisional-{uuid.uuid4().hex}"
    rows.write.parquet(f"{provisional}/{part}/rows")
    n = spark.read.schema(rows.schema).parquet(f"{provisional}/{part}/rows").count()
    side = {"n_rows": n, "columns": rows.columns, "schema": rows.schema.jsonValue(), "attrs": {**attrs, "schema_version": version}}
    _put(spark, f"{provisional}/{part}/sidecar.json", json.dumps(side, indent=1))
    if now is None or replace:
        number = int(now[-8:]) + 1 if now else 0
        _rename(spark, provisional, f"{path}/generation-{number:08d}")
    else:
        _rename(spark, f"{provisional}/{part}", f"{now}/{part}")
        system, at = _files(spark, path)
        system.delete(at(provisional), True)
    return n


def sidecars(spark: SparkSession, path: str) -> dict[str, dict]:
    """Sidecar of each part of the latest generation, by the part's folder, in order of writing; one per write."""
    now = generation(spark, path.rstrip("/"))
    return {f"{now}/{n}": json.loads(_get(spark, f"{now}/{n}/sidecar.json")) for n in _names(spark, now, r"part-\d{8}-[0-9a-f]{32}")} if now else {}


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """All rows of the latest generation and {"n_rows", "columns", "versions", "attrs"} of its sidecars.

    A column that some parts lack is null there. ValueError where there is no catalogue, or where
    parts give one column different types.
    """
    of = sidecars(spark, path)
    if not of:
        raise ValueError(f"no catalogue at {path!r}")
    fields: dict[str, T.StructField] = {}
    order = [f.name for f in _fields(ADDED, VERSION) + _fields(OPTIONAL, VERSION)]
    for side in of.values():
        for f in T.StructType.fromJson(side["schema"]).fields:
            if fields.setdefault(f.name, f).dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name!r} is {fields[f.name].dataType.simpleString()} in one part and {f.dataType.simpleString()} in another")
    names = [n for n in order if n in fields] + sorted(n for n in fields if n not in order)
    schema = T.StructType([T.StructField(n, fields[n].dataType, True) for n in names])
    attrs: dict = {}
    for side in of.values():
        attrs |= {k: v for k, v in side["attrs"].items() if k != "schema_version"}
    about = {"n_rows": sum(s["n_rows"] for s in of.values()), "columns": names, "versions": sorted({s["attrs"]["schema_version"] for s in of.values()}), "attrs": attrs}
    return spark.read.schema(schema).parquet(*[f"{p}/rows" for p in of]), about
