"""Coordinates and vectors as column expressions. Lengths in planetary radii, fields in nT."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
DIPOLE_OFFSET_Z = 0.037
DIPOLE_MOMENT = 380.0
FLATTENING = 0.09796
MU0 = 1.25663706127e-6
LIGHT = 299792458.0
#: 45 and 135 degrees as doubles, what these doubles lack, and how near a diagonal counts as about it.
DIAGONALS = ((0.7853981633974483, 3.061616997868383e-17), (2.356194490192345, 9.184850993605148e-17))
ABOUT = 2.0**-20

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Vector) -> Vector:
    """The vector at length one; the zero vector stays."""
    n = norm(a)
    return tuple(F.when(n > 0, F.try_divide(c, n)).otherwise(c) for c in a)


def car2sph(a: Vector) -> Vector:
    """(r, colatitude, azimuth)."""
    return norm(a), F.atan2(F.sqrt(a[0] * a[0] + a[1] * a[1]), a[2]), F.atan2(a[1], a[0])


def sph2car(s: Vector) -> Vector:
    r, th, ph = s
    return r * F.sin(th) * F.cos(ph), r * F.sin(th) * F.sin(ph), r * F.cos(th)


def rotation_sph2car(th: Column, ph: Column) -> tuple[Vector, Vector, Vector]:
    """Rows of the matrix that turns (r, theta, phi) components into Cartesian ones."""
    zero = F.lit(0.0)
    return (
        (F.sin(th) * F.cos(ph), F.cos(th) * F.cos(ph), -F.sin(ph)),
        (F.sin(th) * F.sin(ph), F.cos(th) * F.sin(ph), F.cos(ph)),
        (F.cos(th), -F.sin(th), zero),
    )


def field_sph2car(b: Vector, th: Column, ph: Column) -> Vector:
    return tuple(dot(row, b) for row in rotation_sph2car(th, ph))


def field_car2sph(b: Vector, th: Column, ph: Column) -> Vector:
    rows = rotation_sph2car(th, ph)
    return tuple(rows[0][k] * b[0] + rows[1][k] * b[1] + rows[2][k] * b[2] for k in range(3))


def phi_to_lt(phi: Column) -> Column:
    return phi / pi * 12 + 12


def lt_to_phi(lt: Column) -> Column:
    return (lt - 12.0) / 12.0 * pi


def azimuth(x: Column, y: Column) -> Column:
    """``atan2(y, x)``, about the diagonals rounded correctly.

    There hours of local time begin, so a last digit that Java's function has wrong can put a
    position into another one. The difference of the two lengths is exact there, so the angle from
    the diagonal is a small number of full precision, and only its sum is rounded.
    """
    a, b = F.abs(x), F.abs(y)
    u = F.try_divide(b - a, a + b)
    off = u - u * u * u / 3
    (near, near_rest), (far, far_rest) = DIAGONALS
    size = F.when(x > 0, near + (near_rest + off)).otherwise(far + (far_rest - off))
    return F.when(F.abs(u) < ABOUT, F.when(y < 0, -size).otherwise(size)).otherwise(F.atan2(y, x))


def local_time(x: Column, y: Column) -> Column:
    """Hours in [0, 24), noon along +x.

    A turn is added to all and not to negative ones only, so that a time just short of an hour is
    rounded to it whatever the quadrant.
    """
    return ((12.0 + azimuth(x, y) * 12.0 / pi) % 24.0 + 24.0) % 24.0


def _offset(x: Column, y: Column, z: Column, offset: float) -> tuple[Column, Column]:
    zo = z - offset
    return zo, F.sqrt(x * x + y * y + zo * zo)


def _sine(zo: Column, r: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(zo, r)))


def magnetic_latitude(x: Column, y: Column, z: Column, offset: float = DIPOLE_OFFSET_Z) -> Column:
    """Degrees about the offset dipole; 0 at its centre."""
    zo, r = _offset(x, y, z, offset)
    return F.when(r > 0, F.degrees(F.asin(_sine(zo, r)))).otherwise(0.0)


def invariant_latitude(x: Column, y: Column, z: Column, offset: float = DIPOLE_OFFSET_Z) -> Column:
    """Footpoint latitude in degrees with the hemisphere's sign; null inside the planet."""
    zo, r = _offset(x, y, z, offset)
    lat = F.when(r > 0, F.asin(_sine(zo, r))).otherwise(0.0)
    shell = r / (F.cos(lat) * F.cos(lat))
    size = F.degrees(F.acos(F.least(F.lit(1.0), F.try_divide(F.lit(1.0), F.sqrt(shell)))))
    return F.when(shell >= 1.0, F.when(zo < 0, -size).otherwise(size))


def shell(r: Column, lat_deg: Column) -> Column:
    c = F.cos(F.radians(lat_deg))
    return F.try_divide(r, c * c)


def shell_latitude(l_shell: Column) -> Column:
    """90 - asin(1 / sqrt L) in degrees; 0 up to L = 1."""
    return F.when(l_shell > 1, 90.0 - F.degrees(F.asin(F.try_divide(F.lit(1.0), F.sqrt(l_shell))))).otherwise(0.0)


def mfa_basis(pos: Vector, background: Vector) -> tuple[Vector, Vector, Vector]:
    """Unit vectors along the mean field, across it in the meridian, and completing the triad."""
    phi = unit_vector((-pos[1], pos[0], F.lit(0.0)))
    par = unit_vector(background)
    perp1 = unit_vector(cross(phi, par))
    return par, perp1, cross(par, perp1)


def mfa(pos: Vector, field: Vector, background: Vector, spherical: bool = False) -> Vector:
    """Field components in the mean-field-aligned basis; spherical inputs are turned first."""
    if spherical:
        th, ph = pos[1], pos[2]
        field, background, pos = field_sph2car(field, th, ph), field_sph2car(background, th, ph), sph2car(pos)
    return tuple(dot(field, e) for e in mfa_basis(pos, background))


def dipole_field(p: Vector, moment: float = DIPOLE_MOMENT) -> Vector:
    r2 = dot(p, p)
    r5 = F.pow(F.sqrt(r2), F.lit(5.0))
    by = lambda v: F.try_divide(moment * v, r5)
    return by(3 * p[0] * p[2]), by(3 * p[1] * p[2]), by(3 * p[2] * p[2] - r2)


def surface_radius(p: Vector, flattening: float = FLATTENING) -> Column:
    """Radius of the oblate spheroid below a position."""
    if not flattening:
        return F.lit(1.0)
    polar, r = 1.0 - flattening, norm(p)
    c, s = F.try_divide(F.sqrt(p[0] * p[0] + p[1] * p[1]), r), F.try_divide(F.abs(p[2]), r)
    return F.when(r == 0, polar).otherwise(1.0 / F.sqrt(c * c + s * s / polar**2))


def alfven_speed(b: Column, n: Column, ion_mass: Column, floor: Column | None = None, cap: bool = True) -> Column:
    """m/s from tesla and per cubic metre, with an optional density floor and relativistic cap."""
    dense = F.greatest(n if floor is None else F.greatest(n, floor), F.lit(1e-10))
    v = b / F.sqrt(MU0 * dense * ion_mass)
    v = v / F.sqrt(1.0 + (v / LIGHT) * (v / LIGHT)) if cap else v
    return F.coalesce(F.nanvl(v, F.lit(LIGHT)), F.lit(LIGHT))


def ksm_from_spherical(r: Column, lat_deg: Column, lt: Column, offset: float = DIPOLE_OFFSET_Z) -> Vector:
    """Position from radius and latitude about the offset dipole and local time."""
    lat, phi = F.radians(lat_deg), lt_to_phi(lt)
    return r * F.cos(lat) * F.cos(phi), r * F.cos(lat) * F.sin(phi), r * F.sin(lat) + offset


# Fixed values of the solar direction series and the rotation rates
SUN_LATITUDE = (-26.237934, 3.0525104, -1.3686733, 0.10182726, -0.30897805, 0.089277949, -0.039638771, 0.0097499653, 0.000040974159, 0.0014075684, 1.3505775)
SUN_LONGITUDE = (-0.32108124, 5.8569866, 0.71266272, 3.3244539, 0.047529267, 0.32770362, 0.046935622, 0.10720536, -0.00050594764, 0.029439612, 264.23581)
POLE_LONGITUDE = (-0.0013200649, -0.0018358429, 0.00064658927, 0.0012800487, 0.000017618936, -0.00058790898, 0.000049804081, 0.00042372137, 0.000014744891, 0.025369744, 77.943328)
SIDEREAL_HOURS = 10.65622222
ORBIT_SECONDS = 10759.22 * 86400.0
YEAR_SECONDS = 365.25 * 86400.0
SERIES_START = -825767955.816
POLE_COLATITUDE = 63.271
SPIN = 360.0 / (SIDEREAL_HOURS * 3600.0)
POLE_SPIN = SPIN + 3.880688963e-7


def sun_position(j2000: Column) -> tuple[Column, Column, Column, Column]:
    """(sun latitude, sun longitude, pole colatitude, pole longitude) in radians, rotating frame."""
    t = j2000 - SERIES_START
    w = t * (2 * pi / ORBIT_SECONDS)
    basis = [f(k * w) for k in (1.0, 2.0, 3.0, 4.0) for f in (F.cos, F.sin)] + [(t / YEAR_SECONDS) * (t / YEAR_SECONDS), t / YEAR_SECONDS, F.lit(1.0)]
    series = lambda c: sum((a * b for a, b in zip(c[1:], basis[1:], strict=True)), c[0] * basis[0])
    orbit = t / ORBIT_SECONDS * 360.0
    sun = F.pmod((series(SUN_LONGITUDE) + orbit) % 360.0 - t * SPIN, F.lit(360.0))
    pole = F.pmod((series(POLE_LONGITUDE) + orbit + 180.0) % 360.0 - t * POLE_SPIN, F.lit(360.0))
    return F.radians(series(SUN_LATITUDE)), F.radians(sun), F.radians(F.lit(POLE_COLATITUDE)), F.radians(pole)


def _towards(lat: Column, lon: Column) -> Vector:
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def axes(system: str, sun: tuple[Column, Column, Column, Column]) -> tuple[Vector, Vector, Vector]:
    """Axes of a system in the rotating planetary frame (S3C), from the solar and pole angles."""
    one, zero = F.lit(1.0), F.lit(0.0)
    if system.upper() in ("S3C", "DIP"):
        return (one, zero, zero), (zero, one, zero), (zero, zero, one)
    lat, lon, pole_lat, pole_lon = sun
    sun, dipole = _towards(lat, lon), (zero, zero, one)
    if system.upper() == "KSO":
        z = _towards(pole_lat, pole_lon)
        return sun, cross(z, sun), z
    if system.upper() == "KSM":
        y = unit_vector(cross(dipole, sun))
        return sun, y, cross(sun, y)
    if system.upper() == "DIS":
        y = unit_vector(cross(dipole, sun))
        return cross(y, dipole), y, dipole
    raise ValueError(f"unknown coordinate system: {system}")


def rotate_vector(v: Vector, source: str, target: str, j2000: Column) -> Vector:
    """Components in another system, by way of the rotating planetary frame.

    The angles and the vector are computed once per row and named inside the expression.
    """
    given = F.struct(*[x.alias(n) for x, n in zip((*sun_position(j2000), *v), "abcdxyz", strict=True)])

    def turned(g: Column) -> Column:
        angles, w = tuple(g[n] for n in "abcd"), tuple(g[n] for n in "xyz")
        a, b = axes(source, angles), axes(target, angles)
        fixed = tuple(sum((a[i][k] * w[i] for i in (1, 2)), a[0][k] * w[0]) for k in range(3))
        return F.struct(*[dot(row, fixed).alias(n) for row, n in zip(b, "xyz", strict=True)])

    out = F.element_at(F.transform(F.array(given), turned), 1)
    return out["x"], out["y"], out["z"]
