"""Field-line tracing as a row-parallel enrichment: all rows of a batch step together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Field = Callable[[np.ndarray], np.ndarray]
#: Ways along a line that are stepped together: enough that calls cost little, few enough for a core.
POOL = 16384


def dipole(p: np.ndarray, moment: float = 380.0) -> np.ndarray:
    x, y, z = p.T
    r2 = x * x + y * y + z * z
    r3 = r2 * np.sqrt(r2)
    k = 3 * moment * z / (r2 * r3)
    return np.stack([k * x, k * y, k * z - moment / r3]).T


def _size(v: np.ndarray) -> np.ndarray:
    return np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def trace(start: np.ndarray, field: Field = dipole, step: float = 0.15, r_stop: float = 1.0, r_max: float = 100.0, most: int = 4000) -> pd.DataFrame:
    """Footpoint latitudes of both ends, equatorial distance and whether the line is closed.

    Fourth-order steps along the field's direction, shorter near the planet; a line ends at the
    stopping radius, where the last chord gives its latitude, or far out, where it has none.
    Components are kept apart, each in a row of its own. Both ways of all lines are one row of
    work, of which ``POOL`` are stepped together; those that have ended make room for others.
    """
    n = len(start)
    first = np.ascontiguousarray(start.T, dtype=float)
    size = _size(first)
    out = np.flatnonzero(size > r_stop)
    queue, signs = np.concatenate([out, out + n]), np.repeat([1.0, -1.0], n)  # the way back is numbered from n
    lat, top = np.full(2 * n, np.nan), np.concatenate([size, size])
    k, x, r0, age, done = queue[:0], first[:, :0], size[:0], queue[:0], 0
    while True:
        if len(k) <= POOL // 2 and done < len(queue):
            more = queue[done : done + POOL - len(k)]
            done += len(more)
            k, x, r0 = np.concatenate([k, more]), np.concatenate([x, first[:, more % n]], axis=1), np.concatenate([r0, size[more % n]])
            age = np.concatenate([age, np.zeros(len(more), dtype=age.dtype)])
        if not len(k):
            break
        sign = signs[k]

        def way(x: np.ndarray, sign: np.ndarray = sign) -> np.ndarray:
            b = field(x.T).T
            return b * (sign / np.maximum(_size(b), 1e-300))

        h = step * np.clip(r0 / 5, 0.05, 4.0)
        half = h / 2
        k1 = way(x)
        k2 = way(x + half * k1)
        k3 = way(x + half * k2)
        y = x + h / 6 * (k1 + 2 * (k2 + k3) + way(x + h * k3))
        r1 = _size(y)
        top[k] = np.maximum(top[k], r1)
        age = age + 1
        on = (r1 > r_stop) & (r1 < r_max) & (age < most)
        if not on.all():
            foot = np.flatnonzero(r1 <= r_stop)
            u = (r0[foot] - r_stop) / np.maximum(r0[foot] - r1[foot], 1e-12)
            at = x[:, foot] + u * (y[:, foot] - x[:, foot])
            lat[k[foot]] = np.degrees(np.arcsin(np.clip(at[2] / _size(at), -1, 1)))
            on = np.flatnonzero(on)
            k, y, r1, age = k[on], y.take(on, axis=1), r1[on], age[on]
        x, r0 = y, r1
    ends, top = [lat[:n], lat[n:]], np.maximum(top[:n], top[n:])
    closed = ~np.isnan(ends[0]) & ~np.isnan(ends[1])
    north, south = np.fmax(ends[0], ends[1]), np.fmin(ends[0], ends[1])
    return pd.DataFrame({"lat_north": np.where(closed | (north > 0), north, np.nan), "lat_south": np.where(closed | (south < 0), south, np.nan), "apex": top, "closed": closed})


def enrich(df: DataFrame, x: str = "x", y: str = "y", z: str = "z", field: Field = dipole, batch: int = 100_000) -> DataFrame:
    """Rows with lat_north, lat_south, apex and closed of the line through each position; rows inside the planet get nulls.

    Tracing costs far more than moving a row, so rows are first dealt evenly over all cores. A
    task traces ``batch`` rows or a few more at once, since the longest lines of each batch end alone.
    """
    def traced(part: pd.DataFrame) -> pd.DataFrame:
        p = part[[x, y, z]].to_numpy(float)
        ok = np.isfinite(p).all(axis=1) & (np.linalg.norm(p, axis=1) > 1)
        out = pd.DataFrame({"lat_north": np.nan, "lat_south": np.nan, "apex": np.nan, "closed": False}, index=part.index)
        if ok.any():
            out.loc[ok, :] = trace(p[ok], field).set_index(np.flatnonzero(ok))
        out["closed"] = out["closed"].astype(bool)
        return pd.concat([part, out], axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= batch:
                yield traced(pd.concat(held, ignore_index=True))
                held = []
        if held:
            yield traced(pd.concat(held, ignore_index=True))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks).mapInPandas(run, f"{schema}, lat_north double, lat_south double, apex double, closed boolean")
