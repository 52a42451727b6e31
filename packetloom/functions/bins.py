"""Bins of values and grids of positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.coords import local_time, magnetic_latitude


def value_to_bin(v: Column, lo: float, hi: float, n: int) -> Column:
    """Bin of a value, clipped into 0..n-1."""
    k = F.floor((v - lo) / (hi - lo) * n)
    return F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)).cast("int")


def bin_to_value(k: Column, lo: float, hi: float, n: int) -> Column:
    """Centre of a bin."""
    return lo + (k + 0.5) * ((hi - lo) / n)


def bin_edges(lo: float, hi: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: lo + k * ((hi - lo) / n))


def inside(v: Column, lo: float, hi: float) -> Column:
    return (v >= lo) & (v < hi)


def in_lt_range(lt: Column, centre: float, half: float) -> Column:
    """Local time within ``half`` hours of ``centre``, across midnight too."""
    lo, hi = (centre - half) % 24, (centre + half) % 24
    return (lt >= lo) & (lt < hi) if lo < hi else (lt >= lo) | (lt < hi)


@dataclass(frozen=True)
class GridSpec:
    """Axes of an occupancy grid; all bins are half-open."""

    n_r: int = 100
    n_lat: int = 180
    n_lt: int = 96
    r: tuple[float, float] = (0.0, 100.0)
    lat: tuple[float, float] = (-90.0, 90.0)
    lt: tuple[float, float] = (0.0, 24.0)

    def coords(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """Radius about the planet, latitude about the offset dipole, local time."""
        return F.sqrt(x * x + y * y + z * z), magnetic_latitude(x, y, z), local_time(x, y)

    def bins(self, r: Column, lat: Column, lt: Column) -> dict[str, Column]:
        ok = inside(r, *self.r) & inside(lat, *self.lat) & inside(lt, *self.lt)
        return {
            "in_range": F.coalesce(ok, F.lit(False)), "i_r": value_to_bin(r, *self.r, self.n_r),
            "i_lat": value_to_bin(lat, *self.lat, self.n_lat), "i_lt": value_to_bin(lt, *self.lt, self.n_lt),
        }
