"""Queries of the scalar functions and of the filters over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import bands, bins, coords, times
from packetloom.plans.registry import BAND_SQL, CAT, EV, POS, cat, columns, ev, pos, query, r6



def c(name: str):
    return F.col(name)


def xyz():
    return c("x"), c("y"), c("z")


def triple(names: str, v) -> dict:
    return dict(zip(names.split(), v, strict=True))


R = lambda e: f"round({e}, 6) + 0.0"
RHO = "sqrt(x*x + y*y + z*z)"
ZO = "(z - 0.037)"
RO = f"sqrt(x*x + y*y + {ZO}*{ZO})"
MLAT = f"CASE WHEN {RO} > 0 THEN degrees(asin(greatest(-1.0, least(1.0, {ZO} / {RO})))) ELSE 0.0 END"
LT = "((12 + atan2(y, x) * 12 / pi()) % 24 + 24) % 24"
SHELL = f"({RO} / pow(cos(radians({MLAT})), 2))"

columns("fn_to_unix", "ev", "event_id", {"s": R("t")}, lambda: {"s": c("t")})
columns("fn_from_unix", "ev", "event_id", {"us": "CAST(round(t * 1e6) AS BIGINT)"}, lambda: {"us": F.unix_micros(times.from_unix(c("t")))})
columns("fn_j2000", "ev", "event_id", {"s": R("t - 946728000")}, lambda: {"s": times.j2000(c("t"))})
columns("fn_parse_dt", "ev", "event_id",
        {"s": "CAST(epoch(strptime(strftime(make_timestamp(CAST(t AS BIGINT) * 1000000), '%Y-%jT%H:%M:%S'), '%Y-%jT%H:%M:%S')) AS BIGINT)"},
        lambda: {"s": F.unix_seconds(times.parse_datetime(F.date_format(F.timestamp_seconds(F.rint(c("t")).cast("long")), "yyyy-DDD'T'HH:mm:ss")))})
_LEAPS = " + ".join(f"CAST(u >= {x} AS DOUBLE)" for x in times.LEAP_SECONDS)
_EPOCH = f"CASE k % 4 WHEN 0 THEN u WHEN 1 THEN u + 32.184 WHEN 2 THEN u ELSE u + {_LEAPS} - 1072958367.816 END"
columns("fn_epoch_j2000", "ev", "event_id", {"s": R(_EPOCH.replace("u", "(value * 1.3e7)"))},
        lambda: {"s": times.epoch_to_j2000(c("value") * 1.3e7, F.element_at(F.array(*[F.lit(x) for x in ("j2000", "i2000", "etime", "ctime")]), c("k") % 4 + 1))})
columns("fn_unit_vector", "pos", "id n", {n: R(f"CASE WHEN {RHO} > 0 THEN {n[1]} / {RHO} ELSE {n[1]} END") for n in ("ux", "uy", "uz")}, lambda: triple("ux uy uz", coords.unit_vector(xyz())))
columns("fn_car2sph", "pos", "id n", {"r": R(RHO), "th": R("atan2(sqrt(x*x + y*y), z)"), "ph": R("atan2(y, x)")}, lambda: triple("r th ph", coords.car2sph(xyz())))
columns("fn_sph2car", "pos", "id n", {"a": R("x * sin(y) * cos(z)"), "b": R("x * sin(y) * sin(z)"), "d": R("x * cos(y)")}, lambda: triple("a b d", coords.sph2car(xyz())))
columns("fn_rot_sph2car", "pos", "id n",
        {"r00": R("sin(y)*cos(z)"), "r01": R("cos(y)*cos(z)"), "r02": R("-sin(z)"), "r10": R("sin(y)*sin(z)"), "r11": R("cos(y)*sin(z)"), "r12": R("cos(z)"), "r20": R("cos(y)"), "r21": R("-sin(y)"), "r22": "0.0::DOUBLE"},
        lambda: {f"r{i}{j}": v for i, row in enumerate(coords.rotation_sph2car(c("y"), c("z"))) for j, v in enumerate(row)})
columns("fn_field_car_sph", "pos", "id n",
        {"br": R("x*sin(disc)*cos(z) + y*sin(disc)*sin(z) + z*cos(disc)"), "bth": R("x*cos(disc)*cos(z) + y*cos(disc)*sin(z) - z*sin(disc)"), "bph": R("-x*sin(z) + y*cos(z)"), "back": "true"},
        lambda: triple("br bth bph", coords.field_car2sph(xyz(), c("disc"), c("z"))) | {"back": _returns()})


def _returns():
    there = coords.field_car2sph(xyz(), c("disc"), c("z"))
    back = coords.field_sph2car(there, c("disc"), c("z"))
    return (F.abs(back[0] - c("x")) < 1e-9) & (F.abs(back[1] - c("y")) < 1e-9) & (F.abs(back[2] - c("z")) < 1e-9)


columns("fn_phi2lt", "pos", "id n", {"lt": R("atan2(y, x) / pi() * 12 + 12")}, lambda: {"lt": coords.phi_to_lt(F.atan2("y", "x"))})
columns("fn_lt2phi", "pos", "id n", {"phi": R("(x - 12) / 12 * pi()")}, lambda: {"phi": coords.lt_to_phi(c("x"))})
columns("fn_localtime", "pos", "id n", {"lt": R(LT)}, lambda: {"lt": coords.local_time(c("x"), c("y"))})
columns("fn_maglat", "pos", "id n", {"lat": R(MLAT)}, lambda: {"lat": coords.magnetic_latitude(*xyz())})
columns("fn_invlat", "pos", "id n", {"lat": f"CASE WHEN {SHELL} >= 1 THEN {R(f'(CASE WHEN {ZO} < 0 THEN -1 ELSE 1 END) * degrees(acos(least(1.0, 1 / sqrt({SHELL}))))')} END"}, lambda: {"lat": coords.invariant_latitude(*xyz())})
columns("fn_lshell", "pos", "id n",
        {"l": R(f"{RHO} / pow(cos(radians(y)), 2)"), "lat": R(f"CASE WHEN {RHO} / pow(cos(radians(y)), 2) > 1 THEN 90 - degrees(asin(1 / sqrt({RHO} / pow(cos(radians(y)), 2)))) ELSE 0 END")},
        lambda: {"l": coords.shell(F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")), c("y")), "lat": coords.shell_latitude(coords.shell(F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")), c("y")))})
columns("fn_dipole_field", "pos", "id n",
        {"bx": R(f"380.0*3*x*z / pow({RHO}, 5)"), "by_": R(f"380.0*3*y*z / pow({RHO}, 5)"), "bz": R(f"380.0*(3*z*z - (x*x+y*y+z*z)) / pow({RHO}, 5)")},
        lambda: triple("bx by_ bz", coords.dipole_field(xyz())))
columns("fn_surface_radius", "pos", "id n", {"r": R(f"1 / sqrt((x*x+y*y)/({RHO}*{RHO}) + z*z/({RHO}*{RHO})/pow(1-0.09796, 2))")}, lambda: {"r": coords.surface_radius(xyz())})
columns("fn_ksm_from_sph", "pos", "id n",
        {"a": R("abs(x)*cos(radians(y))*cos((z-12)/12*pi())"), "b": R("abs(x)*cos(radians(y))*sin((z-12)/12*pi())"), "d": R("abs(x)*sin(radians(y)) + 0.037")},
        lambda: triple("a b d", coords.ksm_from_spherical(F.abs("x"), c("y"), c("z"))))
_VA = "(abs(x)*1e-9 / sqrt(1.25663706127e-6 * greatest(greatest(abs(y)*1e6, 1e4), 1e-10) * 2.7e-26))"
columns("fn_alfven", "pos", "id n", {"v": f"round({_VA} / sqrt(1 + pow({_VA}/299792458.0, 2)), 3)"},
        lambda: {"v": F.round(coords.alfven_speed(F.abs("x") * 1e-9, F.abs("y") * 1e6, F.lit(2.7e-26), F.lit(1e4)), 3)})
columns("fn_stokes_geom", "pos", "id n",
        {"ell": R("tan(0.5*asin(greatest(-1.0, least(1.0, z / " + RHO + "))))"), "inc": R("degrees(0.5*atan2(y, x))"), "frac": R(f"{RHO} / (40 + disc)")},
        lambda: triple("ell inc frac", bands.stokes_geometry(40 + c("disc"), *xyz())))
columns("fn_ar1_shape", "pos", "id n", {"s": R("(1 - pow(disc*9,2)) / (1 + pow(disc*9,2) - 2*disc*9*cos(2*pi()*abs(x)*1e-4*60))")}, lambda: {"s": bands.ar1_shape(F.abs("x") * 1e-4, 60.0, c("disc") * 9)})
columns("fn_band", "ev", "event_id", {"band": BAND_SQL.format(p="(value * 60)")}, lambda: {"band": bands.band_of(c("value") * 60)})
columns("fn_band_scheme", "ev", "event_id",
        {"band": "CASE " + " ".join(f"WHEN value >= {lo!r} AND value < {hi!r} THEN '{n}'" for n, lo, hi in bands.fine_edges()) + " END"},
        lambda: {"band": bands.band_lookup(bands.fine_edges())(c("value"))})
columns("fn_region_name", "ev", "event_id", {"region": "CASE k % 11 WHEN 0 THEN 'magnetosphere' WHEN 1 THEN 'magnetosheath' WHEN 2 THEN 'solar_wind' ELSE 'unknown' END"}, lambda: {"region": bands.region_name(c("k") % 11)})
_KIND, _DIR = "CASE k % 3 WHEN 0 THEN 'BS' WHEN 1 THEN 'MP' ELSE 'X' END", "CASE k % 6 WHEN 0 THEN 'I' WHEN 1 THEN 'O' WHEN 2 THEN 'E_SW' WHEN 3 THEN 'E_SH' WHEN 4 THEN 'E_SP' ELSE 'S1' END"
_pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), c("k") % n + 1)
columns("fn_crossing_region", "ev", "event_id",
        {"code": f"CASE ({_KIND}) || ({_DIR}) WHEN 'BSI' THEN 1 WHEN 'BSO' THEN 2 WHEN 'MPI' THEN 0 WHEN 'MPO' THEN 1 ELSE CASE ({_DIR}) WHEN 'E_SW' THEN 2 WHEN 'E_SH' THEN 1 WHEN 'E_SP' THEN 0 WHEN 'E_MP' THEN 0 ELSE 9 END END"},
        lambda: {"code": bands.crossing_region(_pick(3, "BS", "MP", "X"), _pick(6, "I", "O", "E_SW", "E_SH", "E_SP", "S1"))})
columns("fn_bin", "pos", "id n", {"b": "CAST(least(greatest(floor((x + 20) / 40 * 16), 0), 15) AS INTEGER)", "mid": R("-20 + (least(greatest(floor((x + 20) / 40 * 16), 0), 15) + 0.5) * 2.5")},
        lambda: {"b": bins.value_to_bin(c("x"), -20.0, 20.0, 16), "mid": bins.bin_to_value(bins.value_to_bin(c("x"), -20.0, 20.0, 16), -20.0, 20.0, 16)})
_IN = f"({RHO} >= 0 AND {RHO} < 30 AND y >= -13 AND y < 13)"
columns("fn_bin_index", "pos", "id n",
        {"i": f"CASE WHEN {_IN} THEN CAST(least(greatest(floor({RHO} / 30 * 60), 0), 59) AS INTEGER) END", "j": f"CASE WHEN {_IN} THEN CAST(least(greatest(floor((y + 13) / 26 * 52), 0), 51) AS INTEGER) END"},
        lambda: _bin_index())


def _bin_index() -> dict:
    r = F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))
    ok = bins.inside(r, 0.0, 30.0) & bins.inside(c("y"), -13.0, 13.0)
    return {"i": F.when(ok, bins.value_to_bin(r, 0.0, 30.0, 60)), "j": F.when(ok, bins.value_to_bin(c("y"), -13.0, 13.0, 52))}


columns("fn_event_props", "cat", "event_id",
        {"duration_h": R("(t1 - t0) / 3600"), "duration_min": R("(t1 - t0) / 60"), "q": R("period_min / nullif(k * 1.37, 0)"), "significant": "q_factor > 3"},
        lambda: {"duration_h": (c("t1") - c("t0")) / 3600, "duration_min": (c("t1") - c("t0")) / 60, "q": F.try_divide(c("period_min"), F.nullif(c("k") * F.lit(1.37), F.lit(0.0))), "significant": c("q_factor") > 3})
_PH = "((k * 7.5) % 360)"
columns("fn_pol_class", "ev", "event_id",
        {"class": f"CASE WHEN abs({_PH}-90) < 30 OR abs({_PH}-270) < 30 THEN 'circular' WHEN abs({_PH}) < 30 OR abs({_PH}-180) < 30 OR abs({_PH}-360) < 30 THEN 'linear' ELSE 'mixed' END"},
        lambda: {"class": bands.polarization_class(c("k") * F.lit(7.5))})
columns("fn_log2_period_tol", "ev", "event_id", {"close": "CASE WHEN k > 0 AND value > 0 THEN abs(log2(value / k)) < 0.5 END"}, lambda: {"close": F.when((c("k") > 0) & (c("value") > 0), F.abs(F.log2(c("value") / F.nullif(c("k"), F.lit(0)))) < 0.5)})
_EDGE = "greatest(0, least(ceil(sqrt(2.0)*10.0/(2*pi()*(CAST(k + 1 AS DOUBLE)/36000.0))/60.0), floor((2160 - 1)/2)))"
columns("fn_coi", "ev", "event_id", {"ok": f"event_id % 2160 >= {_EDGE} AND event_id % 2160 < 2160 - {_EDGE}"}, lambda: {"ok": bands.outside_coi((c("k") + 1) / 36000.0, c("event_id") % 2160, F.lit(2160), 60.0)})
_BX, _BY, _BZ = "(x*0.7 + 1.3)", "(y - x*0.2)", "(z + 2.1)"
_BN = f"sqrt({_BX}*{_BX} + {_BY}*{_BY} + {_BZ}*{_BZ})"
_P, _Q, _S = f"({_BX}/{_BN})", f"({_BY}/{_BN})", f"({_BZ}/{_BN})"
_F1, _F2 = "(-y/sqrt(x*x+y*y))", "(x/sqrt(x*x+y*y))"
_C = (f"({_F2}*{_S})", f"(-{_F1}*{_S})", f"({_F1}*{_Q} - {_F2}*{_P})")
_CN = f"sqrt({_C[0]}*{_C[0]} + {_C[1]}*{_C[1]} + {_C[2]}*{_C[2]})"
_E = tuple(f"({v}/{_CN})" for v in _C)


def _background():
    return c("x") * 0.7 + 1.3, c("y") - c("x") * 0.2, c("z") + 2.1


columns("fn_mfa", "pos", "id n",
        {"par": R(f"x*{_P} + y*{_Q} + z*{_S}"), "perp1": R(f"x*{_E[0]} + y*{_E[1]} + z*{_E[2]}"),
         "perp2": R(f"x*({_Q}*{_E[2]} - {_S}*{_E[1]}) + y*({_S}*{_E[0]} - {_P}*{_E[2]}) + z*({_P}*{_E[1]} - {_Q}*{_E[0]})")},
        lambda: triple("par perp1 perp2", coords.mfa(xyz(), xyz(), _background())))
columns("fn_mfa_basis", "pos", "id n", {f"e{i}{k}": R(v) for i, row in enumerate(((_P, _Q, _S), _E)) for k, v in enumerate(row)},
        lambda: {f"e{i}{k}": v for i, row in enumerate(coords.mfa_basis(xyz(), _background())[:2]) for k, v in enumerate(row)})


def _series(coef: tuple[float, ...]) -> str:
    w, y = f"(u * {2 * 3.141592653589793 / coords.ORBIT_SECONDS!r})", f"(u / {coords.YEAR_SECONDS!r})"
    basis = [f"{f}({k}*{w})" for k in (1, 2, 3, 4) for f in ("cos", "sin")] + [f"{y}*{y}", y, "1.0"]
    return "(" + " + ".join(f"({a!r})*{b}" for a, b in zip(coef, basis, strict=True)) + ")"


_ORBIT = f"(u / {coords.ORBIT_SECONDS!r} * 360.0)"
_SUN = {
    "sun_lat": f"radians({_series(coords.SUN_LATITUDE)})",
    "sun_lon": f"radians(((({_series(coords.SUN_LONGITUDE)} + {_ORBIT}) % 360.0 - u * {coords.SPIN!r}) % 360.0 + 360.0) % 360.0)",
    "pole_lon": f"radians(((({_series(coords.POLE_LONGITUDE)} + {_ORBIT} + 180.0) % 360.0 - u * {coords.POLE_SPIN!r}) % 360.0 + 360.0) % 360.0)",
}


@query("fn_sun_pos", f"SELECT event_id, round({_SUN['sun_lat']}, 6) AS sun_lat, round(sin({_SUN['sun_lon']}), 5) AS sun_sin, round(cos({_SUN['pole_lon']}), 5) AS pole_cos FROM (SELECT event_id, t - 946728000.0 + 825767955.816 AS u FROM {EV})")
def fn_sun_pos(spark: SparkSession, d: str) -> DataFrame:
    lat, lon, _, pole = coords.sun_position(times.j2000(c("t")))
    return ev(spark, d).select("event_id", r6(lat, "sun_lat"), F.round(F.sin(lon), 5).alias("sun_sin"), F.round(F.cos(pole), 5).alias("pole_cos"))


@query("fn_rotate_vector", f"""SELECT event_id, round(cos(a)*cos(b)*x + (-sin(b))*y + (-sin(a)*cos(b))*z, 4) AS vx, round(cos(a)*sin(b)*x + cos(b)*y - sin(a)*sin(b)*z, 4) AS vy, round(sin(a)*x + cos(a)*z, 4) AS vz
FROM (SELECT event_id, x, y, z, {_SUN['sun_lat']} AS a, {_SUN['sun_lon']} AS b FROM (SELECT event_id, value AS x, k * 0.1 AS y, value - k AS z, t - 946728000.0 + 825767955.816 AS u FROM {EV}))""")
def fn_rotate_vector(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    v = coords.rotate_vector((c("value"), c("k") * F.lit(0.1), c("value") - c("k")), "KSM", "S3C", times.j2000(c("t")))
    return e.select("event_id", *[(F.round(x, 4) + 0.0).alias(n) for x, n in zip(v, ("vx", "vy", "vz"), strict=True)])


@query("fn_band_meta", f"""WITH b(band, lo, hi, mid) AS (VALUES ('QP15', 600.0, 1200.0, 900.0), ('QP30', 1200.0, 2400.0, 1800.0), ('QP60', 2400.0, 4800.0, 3600.0), ('QP120', 4800.0, 9600.0, 7200.0))
SELECT band, count(*) AS n, round(1e6 / CAST(max(hi) AS DOUBLE), 6) AS freq_min_uhz, round(1e6 / CAST(max(lo) AS DOUBLE), 6) AS freq_max_uhz, round(1e6 / CAST(max(mid) AS DOUBLE), 6) AS freq_mid_uhz FROM {CAT} JOIN b USING (band) GROUP BY band""")
def fn_band_meta(spark: SparkSession, d: str) -> DataFrame:
    j = cat(spark, d).join(F.broadcast(bands.band_table(spark)), "band")  # four rows
    f = lambda n, o: F.round(1e6 * F.max(n), 6).alias(o)
    return j.groupBy("band").agg(F.count(F.lit(1)).alias("n"), f("freq_min_hz", "freq_min_uhz"), f("freq_max_hz", "freq_max_uhz"), f("freq_centroid_hz", "freq_mid_uhz"))


@query("fn_event_uid", f"""SELECT event_id, strftime(make_timestamp(CAST(floor(t) AS BIGINT) * 1000000), '%y%m%d%H%M') || chr(CAST(65 + row_number() OVER (PARTITION BY CAST(floor(t / 60) AS BIGINT) ORDER BY t, event_id) - 1 AS INTEGER)) AS uid FROM {EV}""")
def fn_event_uid(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.floor(c("t") / 60)).orderBy("t", "event_id")
    stamp = F.date_format(F.timestamp_seconds(F.floor("t").cast("long")), "yyMMddHHmm")
    return ev(spark, d).select("event_id", F.concat(stamp, F.char(64 + F.row_number().over(w))).alias("uid"))


# Filters
_EVC = "SELECT event_id, value FROM " + EV


def _flt(name: str, where: str, cond, base=ev, sql_base=EV, cols: str = "event_id") -> None:
    query(name, f"SELECT {', '.join(cols.split())} FROM {sql_base} WHERE {where}")(lambda spark, d: base(spark, d).filter(cond()).select(*cols.split()))


_flt("flt_property", "value >= 5 AND value < 20", lambda: (c("value") >= 5) & (c("value") < 20))
_flt("flt_datetime", "t BETWEEN 1704153600 AND 1704412800", lambda: c("t").between(1704153600, 1704412800))
_flt("flt_amp_cap", "greatest(value, k, value - k) <= 10", lambda: F.greatest(c("value"), c("k").cast("double"), c("value") - c("k")) <= 10)
_flt("flt_gates", "q_factor >= 3 AND k / 100.0 <= 0.5 AND 1 - period_min / 100 >= 0.7", lambda: (c("q_factor") >= 3) & (c("k") / 100.0 <= 0.5) & (1 - c("period_min") / 100 >= 0.7), cat, CAT)
_flt("flt_lt_sector", f"{LT} >= 22 OR {LT} < 2", lambda: bins.in_lt_range(coords.local_time(c("x"), c("y")), 0.0, 2.0), pos, POS, "id n")
_flt("flt_weakfield", f"{RHO} < 12", lambda: F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")) < 12, pos, POS, "id n")
_flt("flt_period_window", "(period_min >= 50 AND period_min < 70) OR band = 'QP60'", lambda: ((c("period_min") >= 50) & (c("period_min") < 70)) | (c("band") == "QP60"), cat, CAT)
_flt("flt_event_lookup", "event_id = 4321", lambda: c("event_id") == 4321, cols="event_id user_id value")


def apply_filter(df: DataFrame, text: str | None) -> DataFrame:
    """Rows that a user's predicate keeps; all without one; ValueError if it isn't boolean."""
    if not text:
        return df
    if df.select(F.expr(text).alias("p")).schema[0].dataType.simpleString() != "boolean":
        raise ValueError(f"not a boolean expression: {text!r}")
    return df.filter(F.expr(text))


@query("flt_expr", f"SELECT event_id FROM {CAT} WHERE q_factor > 5 AND band IN ('QP15', 'QP30')")
def flt_expr(spark: SparkSession, d: str) -> DataFrame:
    return apply_filter(cat(spark, d), "q_factor > 5 and band in ('QP15', 'QP30')").select("event_id")


@query("flt_dedup_mva", f"SELECT event_id FROM {CAT} WHERE k % 7 <> 0 AND k / 100.0 <= 0.4")
def flt_dedup_mva(spark: SparkSession, d: str) -> DataFrame:
    return drop_unwanted(cat(spark, d).withColumn("is_duplicate", c("k") % 7 == 0).withColumn("mva_par_frac", c("k") / 100.0), 0.4).select("event_id")


def drop_unwanted(df: DataFrame, cut: float, keep_duplicates: bool = False) -> DataFrame:
    """Without duplicates unless kept; without rows above the cut if it is below one half."""
    df = df if keep_duplicates else df.filter(~c("is_duplicate"))
    return df.filter(~(c("mva_par_frac") > cut)) if cut < 0.5 else df


@query("flt_central", f"""SELECT event_id FROM {CAT} c JOIN (SELECT segment_idx AS s, min(t0) AS a FROM {CAT} GROUP BY 1) g ON c.segment_idx = g.s WHERE (t0 + t1) / 2 >= a + 6 * 3600 AND (t0 + t1) / 2 < a + 30 * 3600""")
def flt_central(spark: SparkSession, d: str) -> DataFrame:
    x = cat(spark, d)
    seg = x.groupBy(c("segment_idx").alias("s")).agg(F.min("t0").alias("a"))
    peak = (c("t0") + c("t1")) / 2
    return x.join(seg, c("segment_idx") == c("s")).filter((peak >= c("a") + 6 * 3600) & (peak < c("a") + 30 * 3600)).select("event_id")


@query("flt_segment_mag", f"SELECT user_id, count(*) AS n FROM {EV} WHERE event_type <> 'error' GROUP BY user_id HAVING count(*) >= 50 AND max(value) < 1e6 AND max(t) - min(t) >= 64800")
def flt_segment_mag(spark: SparkSession, d: str) -> DataFrame:
    g = ev(spark, d).filter("event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"), (F.max("t") - F.min("t")).alias("len"))
    return g.filter("n >= 50 AND v < 1e6 AND len >= 64800").select("user_id", "n")


@query("flt_segment_valid", f"""WITH g AS (SELECT user_id, count(*) AS n, count(value) AS ok, max(t) - min(t) AS len, max(CASE WHEN k = 13 AND event_type = 'error' THEN 1 ELSE 0 END) AS flagged FROM {EV} GROUP BY 1)
SELECT e.event_id, round(coalesce(e.value, 0), 6) AS value FROM {EV} e JOIN g USING (user_id) WHERE n >= 40 AND ok > 0 AND len >= 64800 AND flagged = 0""")
def flt_segment_valid(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    flagged = F.max(F.when((c("k") == 13) & (c("event_type") == "error"), 1).otherwise(0))
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.nanvl("value", F.lit(None).cast("double"))).alias("ok"), (F.max("t") - F.min("t")).alias("len"), flagged.alias("flagged"))
    good = g.filter("n >= 40 AND ok > 0 AND len >= 64800 AND flagged = 0").select("user_id")
    return e.join(good, "user_id", "left_semi").select("event_id", r6(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)), "value"))


@query("flt_event_list", f"SELECT event_id, band, round(period_min, 4) AS period_min, row_number() OVER (ORDER BY q_factor DESC, event_id) AS place FROM {CAT} WHERE band = 'QP15'")
def flt_event_list(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy(F.desc("q_factor"), "event_id")  # a listing of one band of a catalogue
    return cat(spark, d).filter("band = 'QP15'").select("event_id", "band", F.round("period_min", 4).alias("period_min"), F.row_number().over(w).cast("long").alias("place"))


@query("fn_cobands", f"""WITH p AS (SELECT a.event_id, b.band AS pb, a.band AS ab FROM {CAT} a JOIN {CAT} b ON a.segment_idx = b.segment_idx AND a.event_id <> b.event_id AND abs(a.event_id - b.event_id) <= 400)
SELECT event_id, coalesce(string_agg(DISTINCT pb, ',' ORDER BY pb) FILTER (WHERE pb IS DISTINCT FROM ab), '') AS co_bands FROM p GROUP BY event_id""")
def fn_cobands(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("segment_idx").orderBy("event_id").rangeBetween(-400, 400)
    x = cat(spark, d).withColumn("all", F.collect_list("period_min").over(w)).filter(F.size("all") > 1)
    # the event's own period has its own band, which is excluded
    return x.select("event_id", bands.co_bands(c("all"), c("band")).alias("co_bands"))
